"""Readings of a messy text as JSON values, each with where it came from."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from . import jsontext
from .repair import FIXES, STRING, outside, repair, double_escaped, trailing_commas

NESTING = 50
LARGEST = 1 << 20
SPANS = 20
RAW_BYTES = 1000
# Characters that are removed everywhere.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\ufeff\u202a\u202b\u202c\u202d\u202e"
_DROP = dict.fromkeys(map(ord, INVISIBLE))


@dataclass
class Candidate:
    value: Any
    source: str  # Direct, Markdown, Fixed, MultiJson, MultiJsonArray, Heuristic, Yaml
    lang: str | None = None
    fixes: list[str] = field(default_factory=list)
    index: int | None = None
    pattern: str | None = None
    confidence: float = 1.0
    transformations: list[dict] = field(default_factory=list)
    max_depth: int = 0


def remove_invisible(text: str) -> str:
    return text.translate(_DROP)


def flatten_nesting(text: str, most: int = NESTING) -> str:
    """The innermost object or array behind a run of more than `most` openers; else the text."""
    bare = text.strip()
    if bare[:1] not in ("{", "[") or bare.count("{") + bare.count("[") <= most:
        return text
    level, top = {"{": 0, "[": 0}, 0
    for m in re.finditer(rf"{STRING}|[{{}}\[\]]", bare, re.S):
        if m[0] in level:
            level[m[0]] += 1
            top = max(top, level[m[0]])
        elif m[0] in ("}", "]"):
            pair = "{" if m[0] == "}" else "["
            level[pair] = max(0, level[pair] - 1)
    if top <= most:
        return text
    inner = re.fullmatch(r"[\[{\s]*(?P<core>[\[{]\s*[^\s\[\]{}].*?[^\s\[\]{}]\s*[\]}]|[\[{]\s*[^\s\[\]{}]\s*[\]}])[\]}\s]*", bare, re.S)
    core = inner["core"] if inner else ""
    return core if core[:1] + core[-1:] in ("{}", "[]") else text


def plain_quotes(text: str) -> str:
    """Backslash-quote outside strings is a quote, unless an odd number of backslashes stands before."""
    if "\\" not in text:
        return text
    return outside(r'(?P<odd>(?:\\\\)*\\")|(?:\\\\)+', lambda m: m[0][:-2] + '"' if m["odd"] else m[0], text) or text


def preclean(text: str) -> str:
    return plain_quotes(remove_invisible(flatten_nesting(text)))


def spans(text: str, opener: str, quotes: str) -> list[tuple[int, int]]:
    """Balanced spans, left to right: strings (any of the quotes starts and ends one) are skipped inside."""
    closer = {"{": "}", "[": "]"}[opener]
    found, at = [], text.find(opener)
    if at < 0:
        return found
    tokens = re.compile(rf"(?P<escape>\\.)|(?P<quote>[{quotes}])|[\{opener}\{closer}]", re.S)
    while at >= 0:
        level, inside, end, place = 0, False, -1, at
        while m := tokens.search(text, place):
            place = m.end()
            if m["escape"]:
                if not inside:
                    place = m.start() + 1
            elif m["quote"]:
                inside = not inside
            elif not inside:
                level += 1 if m[0] == opener else -1
                if not level:
                    end = m.end()
                    break
        if end < 0:
            at = text.find(opener, at + 1)
        else:
            found.append((at, end))
            at = text.find(opener, end)
    return found


def multiple_objects(text: str) -> list[Candidate]:
    """All JSON values of a text that has two or more, as one array."""
    own, at = [], 0
    if text.count("{") + text.count("[") < 2:
        return []
    while m := re.compile(r"[{\[]").search(text, at):
        end = span_end(text, m.start(), m[0])
        if end < 0:
            at = m.end()
            continue
        try:
            own.append(jsontext.read(text[m.start() : end]))
        except ValueError:
            pass
        at = end
    return [Candidate(own, "MultiJsonArray")] if len(own) > 1 else []


def span_end(text: str, at: int, opener: str) -> int:
    """The end of the balanced span that starts at `at`; -1 if it has none."""
    level = 0
    for m in re.compile(rf"{STRING}|[\{opener}\{'}' if opener == '{' else ']'}]", re.S).finditer(text, at):
        if m[0][0] != '"':
            level += 1 if m[0] == opener else -1
            if not level:
                return m.end()
    return -1


def direct_json(text: str) -> list[Candidate]:
    bare = text.strip()
    if not re.match(r'[{\["\d-]|true|false|null', bare):
        return []
    try:
        return [Candidate(jsontext.read(bare), "Direct")]
    except ValueError:
        return []


# Fixed value: a fenced block.
FENCE = re.compile(r"```(\w*)\n(.*?)```", re.S)
JSON_TAGS = {"json", "jsonc", "json5"}
# Words before a block and what they are worth.
WORTH = {
    "real": 20, "actual": 20, "result": 15, "answer": 15, "final": 15, "correct": 15, "here is": 10, "here's": 10, "output": 10, "response": 8,
    "example": -25, "sample": -20, "demo": -20, "test": -15, "illustration": -15, "for instance": -15, "like this": -10, "such as": -10,
}


def block_score(text: str, content: str, index: int, blocks: int) -> int:
    at = text.find(content)
    lines = text[:at].splitlines() if at >= 0 else []
    context = " ".join(lines[-5:][::-1]).lower()
    score = 50 + sum(worth for word, worth in WORTH.items() if word in context)
    if blocks > 1:
        score += index * 30 // (blocks - 1)
    return score + 10 * (content.count(":") > 5)


def markdown(text: str) -> list[Candidate]:
    if "```" not in text:
        return []
    blocks = [(i, m[1] or None, m[2]) for i, m in enumerate(FENCE.finditer(text))]
    tagged = [b for b in blocks if b[1] and b[1].lower() in JSON_TAGS]
    bare = [(i, lang, c.strip()) for i, lang, c in blocks if lang is None]
    chosen = tagged or [b for b in bare if b[2][:1] in ("{", "[")]
    total = len(tagged) or len(bare)
    scored = []
    for i, lang, content in chosen:
        clean = trailing_commas(content) or content
        try:
            values = [jsontext.read(clean)]
        except ValueError:
            values = [v for v, _ in repair(clean)]
        worth = block_score(text, content, i, total)
        scored += [(worth, Candidate(v, "Markdown", lang=lang)) for v in values]
    return [c for _, c in sorted(scored, key=lambda x: -x[0])]


def fixed(value: Any, fixes: list[str]) -> Candidate:
    return Candidate(value, "Fixed", fixes=fixes, confidence=0.9)


def json_fixer(text: str) -> list[Candidate]:
    return [fixed(v, f) for v, f in repair(text)]


def looks_like_yaml(text: str) -> bool:
    bare = text.strip()
    if bare[:1] in ("{", "["):
        return False
    lines = (line.strip() for line in bare.splitlines())
    return sum(":" in line and not line.startswith(("#", "-")) for line in lines) > 1


def _yaml_loader():
    """A YAML loader with the core scalars only: no dates, no yes and no, no base 60."""
    try:
        import yaml
    except ImportError:
        return None

    class Core(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    for tag, pattern, first in (
        ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
        ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
        ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
        ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+.0123456789")),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(rf"^(?:{pattern})$"), first)
    Core.add_constructor("tag:yaml.org,2002:int", lambda loader, node: _yaml_int(loader.construct_scalar(node)))
    Core.add_constructor("tag:yaml.org,2002:float", lambda loader, node: _yaml_float(loader.construct_scalar(node)))
    return lambda text: next(iter(yaml.load_all(text, Core)), None)


def _yaml_int(text: str) -> int:
    base = {"0o": 8, "0x": 16}.get(text[:2], 10)
    return int(text[2:] if base != 10 else text, base)


def _yaml_float(text: str) -> float:
    return float(text.lower().replace(".inf", "inf").replace(".nan", "nan"))


def yaml_value(value: Any) -> Any:
    """A YAML value as JSON: keys become text, those that are no scalars go; no infinities."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else jsontext.write(k): yaml_value(v) for k, v in value.items() if k is None or isinstance(k, (str, bool, int, float))}
    if isinstance(value, list):
        return [yaml_value(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


_load = None


def yaml_text(text: str) -> list[Candidate]:
    global _load
    if not looks_like_yaml(text):
        return []
    if _load is None:
        _load = _yaml_loader()
        if _load is None:
            raise ModuleNotFoundError("texts that look like YAML need PyYAML; yaml=False leaves that reading out")
    try:
        value = _load(text)
    except Exception:
        return []  # not YAML
    return [] if value is None else [Candidate(yaml_value(value), "Yaml")]


def embedded(text: str) -> list[tuple[int, int, str]]:
    """Spans of objects and arrays that do not overlap, the earlier and longer first."""
    if len(text.encode("utf-8", "surrogatepass")) > LARGEST:
        return []
    every = [(a, b, "object") for a, b in spans(text, "{", "\"'")] + [(a, b, "array") for a, b in spans(text, "[", "\"'")]
    chosen: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(every, key=lambda s: (s[0], -s[1])):
        if not chosen or a >= chosen[-1][1]:
            chosen.append((a, b, kind))
    return chosen[:SPANS]


def heuristic(text: str) -> list[Candidate]:
    found = []
    for a, b, kind in embedded(text):
        try:
            found.append(Candidate(jsontext.read(text[a:b]), "Heuristic", pattern=kind))
        except ValueError:
            pass
    return found


FLOAT = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)", re.I)
INTEGER = re.compile(r"[+-]?[0-9]+")


def to_float(text: str) -> float | None:
    return float(text) if FLOAT.fullmatch(text) else None


def raw_bool(text: str) -> bool | None:
    low = text.lower()
    if low.strip() in ("true", "false"):
        return low.strip() == "true"
    yes, no = low.count("true"), low.count("false")
    return True if (yes, no) == (1, 0) else False if (yes, no) == (0, 1) else None


def raw_number(text: str) -> tuple[float, str] | None:
    bare = text.strip().rstrip(",")
    value = to_float(bare)
    if value is not None and math.isfinite(value):
        return value, "raw_number"
    value = to_float(bare.replace(",", ""))
    return (value, "raw_number_with_commas") if value is not None and math.isfinite(value) else None


def raw_primitive(text: str) -> list[Candidate]:
    bare = text.strip()
    if "{" in bare or "[" in bare or len(bare.encode("utf-8", "surrogatepass")) > RAW_BYTES or bare.startswith('"') and jsontext.readable(bare):
        return []
    found = []
    flag, number = raw_bool(text), raw_number(text)
    if flag is not None:
        found.append(Candidate(flag, "Heuristic", pattern="raw_bool"))
    if number:
        found.append(Candidate(number[0], "Heuristic", pattern=number[1]))
    return [*found, Candidate(text, "Heuristic", pattern="raw_string")]


def state_machine(text: str) -> list[Candidate]:
    """Top-level collections by a stack of open ones; what is still open at the end is closed."""
    stack: list[list[str]] = []
    whole: list[str] = []
    closing = {"{": "}", "[": "]"}

    def close():
        frame = stack.pop()
        done = "".join(frame) + closing[frame[0]]
        stack[-1].append(done) if stack else whole.append(done)

    for m in re.finditer(rf"{STRING}|[{{}}\[\]:]|[^\"{{}}\[\]:]+", text, re.S):
        mark = m[0]
        if mark in closing:
            stack.append([mark])
        elif mark in ("}", "]"):
            if stack and closing[stack[-1][0]] == mark:
                close()
        elif stack and (mark != ":" or stack[-1][0] == "{"):
            stack[-1].append(mark)
    while stack:
        close()
    found = []
    for i, part in enumerate(whole):
        try:
            value = jsontext.read(part)
        except ValueError:
            continue
        found.append(Candidate(value, "MultiJson", index=i) if len(whole) > 1 else Candidate(value, "Direct"))
    return found


Strategy = Callable[[str], list[Candidate]]
#: name: (strategy, priority)
STRATEGIES: dict[str, tuple[Strategy, int]] = {
    "multiple_objects": (multiple_objects, 0),
    "direct_json": (direct_json, 1),
    "markdown": (markdown, 2),
    "json_fixer": (json_fixer, 3),
    "yaml": (yaml_text, 3),
    "heuristic": (heuristic, 4),
    "raw_primitive": (raw_primitive, 5),
    "state_machine": (state_machine, 15),
}


#: Strategies whose candidates all score over BEHIND: the last to be asked, where only the winner is wanted.
LATE, BEHIND = ("json_fixer", "heuristic", "raw_primitive"), 30


def early(text: str, yaml: bool = True) -> dict[str, list[Candidate]]:
    """What the strategies that are not late find, by name, up to one that reads the text directly."""
    text, found = preclean(text), {}
    for name, (strategy, _) in sorted(STRATEGIES.items(), key=lambda s: s[1][1]):
        if name not in LATE and (yaml or name != "yaml"):
            found[name] = strategy(text)
            if any(c.source == "Direct" for c in found[name]):
                break
    return found


# --- when no strategy finds anything: extract, clean, parse or repair


def multiple_commas(text: str) -> str:
    return outside(r",(?:\s*,)+", lambda m: "," + re.sub(r",", "", m[0]), text) or text


def spaces(text: str) -> str:
    return (outside(r"\s+", lambda m: " ", text) or text).strip()


def clean(text: str) -> str:
    text = plain_quotes(remove_invisible(text))
    return spaces(multiple_commas(double_escaped(text) or text))


#: A cleaner makes a piece readable, an extractor finds pieces: (function, priority), the least first.
Cleaner = Callable[[str], str]
Extractor = Callable[[str], list[Candidate]]


def extract(text: str) -> list[Candidate]:
    """Pieces of text that may hold JSON; value is the piece."""
    found = [Candidate(text, "Direct")] if text.strip() else []
    found += [Candidate(text[a:b], "Heuristic", pattern=kind) for a, b, kind in embedded(text)]
    return found + [Candidate(m[2], "Markdown", lang=m[1] or None) for m in FENCE.finditer(text) if m[2].strip()]


def parse_or_repair(piece: Candidate, cleaners: Iterable[Cleaner] = (clean,)) -> list[Candidate]:
    text = piece.value
    for one in cleaners:
        text = one(text)
    try:
        return [Candidate(jsontext.read(text), piece.source, lang=piece.lang, pattern=piece.pattern)]
    except ValueError:
        return json_fixer(text)


def normalise(c: Candidate) -> Candidate:
    """A string that is itself JSON becomes its value; else invisible characters go."""
    if isinstance(c.value, str):
        try:
            return Candidate(jsontext.read(c.value), c.source, c.lang, c.fixes, c.index, c.pattern)
        except ValueError:
            pass
    text = jsontext.write(c.value)
    bare = remove_invisible(text)
    if bare != text:
        return Candidate(jsontext.read(bare), c.source, c.lang, c.fixes, c.index, c.pattern)
    return c


def parse(
    text: str, strategies: Iterable[str | tuple[Strategy, int]] | None = None, cleaners: Iterable[Cleaner] | None = None,
    extractors: Iterable[tuple[Extractor, int]] | None = None, yaml: bool = True, known: dict[str, list[Candidate]] | None = None,
) -> list[Candidate]:
    """All readings of a text, in the order found.

    Where no strategy finds anything, extractors find pieces of the text, and cleaners, one after the
    other, make them readable: by default extract() and clean().  yaml: whether YAML is a reading.
    known: what some strategies, by name, are known to find."""
    text, known = preclean(text), known or {}
    chosen = [(s, *STRATEGIES[s]) if isinstance(s, str) else (None, *s) for s in (STRATEGIES if strategies is None else strategies) if yaml or s != "yaml"]
    found: list[Candidate] = []
    for name, strategy, _ in sorted(chosen, key=lambda s: s[2]):
        own = known[name] if name in known else strategy(text)
        found += own
        if any(c.source == "Direct" for c in own):
            return [normalise(c) for c in found]
    if found:
        return found
    by_priority = sorted([(extract, 0)] if extractors is None else extractors, key=lambda e: e[1])
    pieces = (piece for find, _ in by_priority for piece in find(text))
    return [c for piece in pieces for c in parse_or_repair(piece, (clean,) if cleaners is None else cleaners)]


# --- ranking

# Scores of sources.
BASE = {"Direct": 0, "Markdown": 10, "Yaml": 15, "Fixed": 20, "MultiJsonArray": 25, "MultiJson": 30, "Heuristic": 50}


_lost: dict[float, int] = {}  # hundredths of confidence lost, in single precision


def score(c: Candidate, by_depth: bool = False) -> int:
    total = BASE[c.source] + sum(FIXES[f][1] for f in c.fixes) * (c.source == "Fixed")
    penalties = sum(t["penalty"] for t in c.transformations)
    total += penalties * 10**c.max_depth if by_depth else penalties
    if c.confidence not in _lost:
        _lost[c.confidence] = int((np.float32(1) - np.float32(c.confidence)) * np.float32(100))
    return total + _lost[c.confidence]


def rank(found: list[Candidate]) -> list[Candidate]:
    return sorted(found, key=score)


def transform(c: Candidate, t: dict, at_depth: int | None = None) -> None:
    """Notes a transformation: each multiplies the confidence by 0.95."""
    c.transformations.append(t)
    c.confidence = float(np.float32(c.confidence) * np.float32(0.95))
    if at_depth is not None:
        c.max_depth = max(c.max_depth, at_depth)


def explain(c: Candidate) -> dict:
    snake = re.sub(r"(?<!^)(?=[A-Z])", "_", c.source).lower()
    source: dict[str, Any] = {"type": snake}
    if c.source == "Markdown":
        source["language"] = c.lang
    elif c.source == "Fixed":
        source["fixes"] = [FIXES[f][2] for f in c.fixes]
    elif c.source == "MultiJson":
        source["index"] = c.index
    elif c.source == "Heuristic":
        source["pattern"] = c.pattern
    return {
        "source": source,
        "confidence": c.confidence,
        "score": score(c),
        "transformations": c.transformations,
        "transformation_count": len(c.transformations),
        "max_transformation_depth": c.max_depth,
    }
