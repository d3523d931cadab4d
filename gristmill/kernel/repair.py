"""Repairs of almost-JSON text, and the search over them.

Each repair takes a text and returns it changed, or None if it has nothing to
do.  Most are one substitution whose pattern also matches whole strings, which
are handed back as they are: what is left lies outside strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from . import jsontext

STRING = r'"(?:[^"\\]|\\.)*(?:"|\Z)'
#: Repairs that may be tried on one text.
ATTEMPTS = 10


_KEYS = re.compile(r"([{,]\s*)([^\W\d]\w*)\s*(?=:)")
_TRAILING = re.compile(r",(?=\s*[}\]])")
_QUOTES = re.compile(r"""\\.?|["']""", re.S)
_TOKENS = re.compile(rf"{STRING}|[{{}}\[\]]", re.S)
_WHOLE = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_SPACE = re.compile(r"\s*")
_COMMENT = re.compile(rf"\\.|{STRING}|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_STRING = re.compile(STRING, re.S)
_HEX = re.compile(r"0[xX]([0-9a-fA-F]+)")
_VALUE = r'(?P<colon>:\s*)(?P<value>(?![\s"{\[tfn,}\]])[^,}\]\n]+)'
_patterns: dict[str, re.Pattern] = {}


def outside(pattern: str, change: Callable[[re.Match], str], text: str) -> str | None:
    """Changes what matches outside strings; None if nothing did."""
    if pattern not in _patterns:
        _patterns[pattern] = re.compile(rf"(?P<string>{STRING})|{pattern}", re.S)
    hit = False

    def one(m: re.Match) -> str:
        nonlocal hit
        if m["string"] is not None:
            return m[0]
        new = change(m)
        hit |= new != m[0]
        return new

    new = _patterns[pattern].sub(one, text)
    return new if hit else None


def changed(old: str, new: str) -> str | None:
    return None if old == new else new


def unquoted_keys(text: str) -> str | None:
    return changed(text, _KEYS.sub(r'\1"\2"', text))


def trailing_commas(text: str) -> str | None:
    return changed(text, _TRAILING.sub("", text))


def single_quotes(text: str) -> str | None:
    """A quote opens a string after one of : [ { , or before one of } ] , : — else it is an apostrophe."""
    if "'" not in text:
        return None
    out, inside, last = [], "", 0
    for m in _QUOTES.finditer(text):
        at, mark = m.start(), m[0]
        if mark[0] == "\\" and not inside:
            # outside strings a backslash is an ordinary character
            mark = mark[1:]
            at += 1
        if mark == '"' and inside != "'":
            inside = "" if inside else '"'
        elif mark == "'" and inside != '"':
            before = text[:at].rstrip()[-1:]
            opens = before and before in ":[{," or text[at + 1 : at + 2] and text[at + 1] in "}],:"
            if inside or opens:
                out += [text[last:at], '"']
                last, inside = at + 1, "" if inside else "'"
    return "".join(out) + text[last:] if out else None


def missing_commas(text: str) -> str | None:
    out, last, depth = [], 0, 0
    for m in _TOKENS.finditer(text):
        mark = m[0]
        depth += 1 if mark in "{[" else -1 if mark in "}]" else 0
        closed = mark in "}]" or mark[0] == '"' and len(mark) > 1 and mark[-1] == '"'
        rest = _SPACE.match(text, m.end()).end()
        if closed and depth > 0 and text[rest : rest + 1] in ('"', "{", "["):
            out += [text[last:rest], ","]
            last = rest
    return "".join(out) + text[last:] if out else None


def unclosed(text: str) -> str | None:
    """Closes an open string, then all brackets, then all braces."""
    level, opened = {"{": 0, "[": 0}, False
    for m in _TOKENS.finditer(text):
        mark = m[0]
        if mark[0] == '"':
            opened = not _WHOLE.fullmatch(mark)
        elif mark in level:
            level[mark] += 1
        else:
            level["{" if mark == "}" else "["] -= 1
    if level["{"] <= 0 and level["["] <= 0:
        return None
    return text + '"' * opened + "]" * max(0, level["["]) + "}" * max(0, level["{"])


def comments(text: str) -> str | None:
    if "/" not in text:
        return None
    hit = False

    def one(m: re.Match) -> str:
        nonlocal hit
        if m[0].startswith(("//", "/*")):
            hit = True
            return ""
        return m[0]

    new = _COMMENT.sub(one, text)
    return new if hit else None


# Typographic quotes and what they stand for.
SMART = str.maketrans({"\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"', "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'"})


def smart_quotes(text: str) -> str | None:
    return text.translate(SMART) if re.search("[\u201c\u201d\u2018\u2019\u201b\u201f]", text) else None


def field_names(text: str) -> str | None:
    """Names are matched at coercion; this one never applies."""
    return None


def double_escaped(text: str) -> str | None:
    text = text.strip()
    if len(text) < 4 or not re.fullmatch(r'"[{\[].*[}\]]"', text, re.S):
        return None
    try:
        inner = jsontext.read(text)
    except ValueError:
        return None
    return inner if jsontext.readable(inner) else None


def template_literals(text: str) -> str | None:
    if "`" not in text:
        return None
    bare = text.strip()
    if len(bare) > 2 and bare[0] == bare[-1] == "`" and jsontext.readable(bare[1:-1]):
        return bare[1:-1]
    new = text.replace("`", '"')
    return new if jsontext.readable(new) else None


def hex_numbers(text: str) -> str | None:
    def one(m: re.Match) -> str:
        value = int(m[1], 16)
        return str(value) if value < 1 << 64 else m[0]

    return changed(text, _HEX.sub(one, text))


def raw_newlines(text: str) -> str | None:
    if "\n" not in text and "\r" not in text:
        return None
    return changed(text, _STRING.sub(lambda m: m[0].replace("\n", "\\n").replace("\r", "\\r"), text))


def functions(text: str) -> str | None:
    """Drops lines that have the word `function` outside double quotes."""
    if "function" not in text:
        return None
    lines = re.split(r"\r?\n", text[:-1] if text.endswith("\n") else text)
    keep = [line for line in lines if not any("function" in part for part in line.split('"')[::2])]
    if len(keep) == len(lines):
        return None
    return "\n".join(keep).replace(",\n    }", "\n    }").replace(",\n}", "\n}")


ESCAPES = str.maketrans({"\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\"})


def triple_quotes(text: str) -> str | None:
    if '"""' not in text:
        return None
    out, at, hit, inside = [], 0, False, False
    while at < len(text):
        if text[at] == "\\":
            out.append(text[at : at + 2])
            at += 2
        elif not inside and text.startswith('"""', at):
            end = text.find('"""', at + 3)
            content = text[at + 3 : end if end >= 0 else None].translate(ESCAPES)
            hit |= end >= 0
            out.append(f'"{content}"' if end >= 0 else f'"""{content}')
            at = end + 3 if end >= 0 else len(text)
        else:
            # an empty string's first quote does not open it
            if text[at] == '"' and (inside or text[at + 1 : at + 2] != '"'):
                inside = not inside
            out.append(text[at])
            at += 1
    return "".join(out) if hit else None


def unquoted_values(text: str) -> str | None:
    def one(m: re.Match) -> str:
        value = m["value"].strip()
        return f'{m["colon"]}"{value}"' if value and not m["value"][0].isnumeric() else m[0]

    return outside(_VALUE, one, text)


#: code: (repair, penalty, description). Codes, penalties and descriptions.
FIXES: dict[str, tuple[Callable[[str], str | None], int, str]] = {
    "UnquotedKeys": (unquoted_keys, 2, "added quotes around object keys"),
    "TrailingCommas": (trailing_commas, 1, "removed trailing commas"),
    "SingleQuotes": (single_quotes, 2, "converted single quotes to double quotes"),
    "MissingCommas": (missing_commas, 3, "added missing commas"),
    "UnclosedBraces": (unclosed, 3, "closed unclosed braces/brackets"),
    "Comments": (comments, 1, "removed comments"),
    "SmartQuotes": (smart_quotes, 1, "normalized smart/curly quotes"),
    "FieldNormalization": (field_names, 4, "normalized field names to snake_case"),
    "DoubleEscaped": (double_escaped, 1, "unescaped double-escaped JSON"),
    "TemplateLiterals": (template_literals, 1, "converted template literals (backticks) to quotes"),
    "HexNumbers": (hex_numbers, 2, "converted hex numbers to decimal"),
    "UnescapedNewlines": (raw_newlines, 1, "escaped unescaped newlines in strings"),
    "JavaScriptFunctions": (functions, 1, "removed JavaScript function definitions"),
    "TripleQuotedStrings": (triple_quotes, 2, "converted triple-quoted strings to regular quotes"),
    "UnquotedValues": (unquoted_values, 5, "added quotes around unquoted values"),
}

# The order in which repairs are tried alone, together, and in sequence.
ALONE = "DoubleEscaped JavaScriptFunctions TemplateLiterals UnescapedNewlines HexNumbers SmartQuotes TrailingCommas SingleQuotes UnquotedKeys TripleQuotedStrings UnquotedValues Comments UnclosedBraces MissingCommas FieldNormalization".split()
TOGETHER = [
    ("SmartQuotes", "SingleQuotes"),
    ("TrailingCommas", "SingleQuotes"),
    ("UnquotedKeys", "TrailingCommas"),
    ("Comments", "TrailingCommas"),
    ("MissingCommas", "UnquotedKeys"),
    ("UnquotedKeys", "UnquotedValues"),
    ("UnquotedKeys", "SingleQuotes"),
    ("SmartQuotes", "UnquotedKeys", "TrailingCommas"),
]
SEQUENCE = "JavaScriptFunctions DoubleEscaped FieldNormalization SmartQuotes TemplateLiterals Comments UnescapedNewlines HexNumbers UnquotedKeys SingleQuotes MissingCommas UnclosedBraces TrailingCommas".split()


def repair(text: str, attempts: int = ATTEMPTS) -> list[tuple[Any, list[str]]]:
    """(value, repairs) of every set of repairs that makes text JSON, in the order tried.

    Sets share members, so what a repair makes of a text, and what a text reads as,
    is worked out once."""
    made: dict[tuple[str, str], str | None] = {}
    values: dict[str, Any] = {}
    found = []
    left = attempts
    for codes in [*((c,) for c in ALONE), *TOGETHER, SEQUENCE]:
        if left <= 0 or codes is SEQUENCE and found:
            break
        new, used = text, []
        for code in codes:
            key = code, new
            if key not in made:
                made[key] = FIXES[code][0](new)
            if made[key] is not None:
                new = made[key]
                used.append(code)
        if not used:
            continue
        left -= 1
        if new not in values:
            try:
                values[new] = (jsontext.read(new),)
            except ValueError:
                values[new] = None
        if values[new]:
            found.append((values[new][0], used))
    return found
