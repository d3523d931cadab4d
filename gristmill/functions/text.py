"""Text and number functions as plain column expressions.

Each one stays inside whole-stage code generation; a null gives a null.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.candidates import INVISIBLE, NESTING, RAW_BYTES
from ..kernel.names import LIGATURES
from ..kernel.repair import SMART

#: Numbers as text: digits with an optional point and exponent.
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
#: A sign, a dollar sign, digits in groups or not, or a bare decimal part; an exponent; a percent sign.
ANY_NUMBER = r"(?U)[+-]?\$?(?:\d+(?:,\d+)*(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?%?"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_invisible(c: Column | str) -> Column:
    """Without zero-width and direction characters."""
    return F.translate(col(c), INVISIBLE, "")


def smart_quotes(c: Column | str) -> Column:
    """Typographic quotes made plain."""
    return F.translate(col(c), "".join(map(chr, SMART)), "".join(map(str, SMART.values())))


def trailing_commas(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U),(?=\s*[}\]])", "")


def quoted_keys(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)([{,]\s*)([\p{L}_][\p{L}\p{N}_]*)\s*(?=:)", '$1"$2"')


def js_functions(c: Column | str) -> Column:
    """Without the lines that have the word function outside double quotes."""
    outside = lambda line: F.array_join(F.filter(F.split(line, '"'), lambda part, i: i % 2 == 0), '"')
    lines = F.filter(F.split(col(c), "\r?\n"), lambda line: ~F.contains(outside(line), F.lit("function")))
    joined = F.replace(F.replace(F.array_join(lines, "\n"), F.lit(",\n    }"), F.lit("\n    }")), F.lit(",\n}"), F.lit("\n}"))
    return F.when(F.contains(col(c), F.lit("function")), joined).otherwise(col(c))


def openers(c: Column | str) -> Column:
    return F.length(col(c)) - F.length(F.translate(col(c), "{[", ""))


def is_json(c: Column | str) -> Column:
    """Whether the whole text is one strict JSON value.

    from_json ignores what follows a value; so the text is put into an array
    before a sentinel that it cannot contain by chance."""
    c = col(c)
    key = F.sha2(c, 256)
    parsed = F.from_json(F.concat(F.lit("["), c, F.lit(',"'), key, F.lit('"]')), "array<string>", STRICT)
    return F.coalesce((F.size(parsed) == 2) & (F.element_at(parsed, 2) == key), F.lit(False))


def is_clean(c: Column | str) -> Column:
    """Whether the only reading of a text is itself: one strict JSON object or array, not nested deeply."""
    c = strip_invisible(c)
    return c.rlike(r"(?U)^[\s\x1c-\x1f]*[{\[]") & (openers(c) <= NESTING) & is_json(c)


def raw_bool(c: Column | str) -> Column:
    """true or false if the text says exactly one of them, once."""
    low = F.lower(col(c))
    yes, no = F.regexp_count(low, F.lit("true")), F.regexp_count(low, F.lit("false"))
    return F.when((yes == 1) & (no == 0), True).when((yes == 0) & (no == 1), False)


def raw_number(c: Column | str) -> Column:
    bare = F.regexp_replace(trimmed(c), ",+$", "")
    no_commas = F.replace(bare, F.lit(","), F.lit(""))
    return F.when(bare.rlike(FLOAT), bare.try_cast("double")).when(no_commas.rlike(FLOAT), no_commas.try_cast("double"))


def raw_kind(c: Column | str) -> Column:
    """bool, number or string: what a text without JSON is read as first; null if it may hold JSON."""
    c = col(c)
    bare = trimmed(c)
    skipped = bare.rlike(r"[{\[]") | (F.octet_length(bare) > RAW_BYTES) | (bare.startswith('"') & is_json(bare))
    return F.when(skipped, None).when(raw_bool(c).isNotNull(), "bool").when(raw_number(c).isNotNull(), "number").otherwise("string")


def fraction(c: Column | str) -> Column:
    parts = F.split(col(c), "/", 2)
    top, low = trimmed(F.get(parts, F.lit(0))), trimmed(F.get(parts, F.lit(1)))
    both = top.rlike(FLOAT) & low.rlike(FLOAT)
    return F.when(both, F.try_divide(top.try_cast("double"), low.try_cast("double")))


def only_number(c: Column | str) -> Column:
    """The number of a text that holds exactly one; thousands, currency and percent signs go."""
    c = col(c)
    found = F.regexp_extract(c, ANY_NUMBER, 0)
    digits = F.regexp_replace(F.regexp_replace(found, r"[,\p{Sc}]", ""), "%+$", "")
    return F.when((F.regexp_count(c, F.lit(ANY_NUMBER)) == 1) & digits.rlike(FLOAT), digits.try_cast("double"))


def half_away(c: Column) -> Column:
    """A double as BIGINT, halves away from zero, NaN as 0, saturated."""
    top = F.lit((1 << 63) - 1)
    rounded = F.signum(c) * F.floor(F.abs(c) + 0.5)
    return F.when(F.isnan(c), F.lit(0).cast("bigint")).when(c >= 9.223372036854775e18, top).when(c <= -9.223372036854775e18, -top - 1).otherwise(rounded.try_cast("bigint"))


def to_double(c: Column | str, mode: str = "fuzzy") -> Column:
    """Text as a number: fuzzy trims and knows fractions."""
    c = col(c)
    bare = F.regexp_replace(trimmed(c), ",+$", "") if mode == "fuzzy" else c
    ways = [F.when(bare.rlike(FLOAT), bare.try_cast("double"))]
    ways += [fraction(bare)] if mode == "fuzzy" else []
    return F.coalesce(*ways, only_number(bare))


def to_bigint(c: Column | str, mode: str = "fuzzy") -> Column:
    """Text as an integer: exact if it is one, else rounded."""
    c = col(c)
    bare = F.regexp_replace(trimmed(c), ",+$", "") if mode == "fuzzy" else c
    whole = F.when(bare.rlike(INTEGER), bare.try_cast("bigint"))
    return F.coalesce(whole, half_away(to_double(c, mode)) if mode == "fuzzy" else half_away(only_number(c)))


def double_to_bigint(c: Column | str, mode: str = "fuzzy") -> Column:
    """A JSON number as an integer: fuzzy rounds, basic cuts."""
    c = col(c)
    return half_away(c) if mode == "fuzzy" else F.when(F.isnan(c), F.lit(0).cast("bigint")).otherwise(F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).try_cast("bigint"))


def to_bool(c: Column | str, mode: str = "basic") -> Column:
    """Text as a boolean: basic also knows yes, no, 1 and 0."""
    low = F.lower(col(c))
    yes, no = (["true", "yes", "1"], ["false", "no", "0"]) if mode == "basic" else (["true"], ["false"])
    return F.when(low.isin(yes), True).when(low.isin(no), False)


def snake_case(c: Column | str) -> Column:
    return F.translate(F.lower(F.regexp_replace(col(c), r"(?<!^)(?=\p{Lu})", "_")), "-.", "__")


def camel_case(c: Column | str) -> Column:
    parts = F.filter(F.split(col(c), "_"), lambda p: p != "")
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))


def bare(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_-]", "")


@cache
def accents() -> tuple[str, str]:
    """(letters, their bare forms) of the basic plane, as the kernel takes accents off; letters beyond the forms are marks, which go."""
    from unicodedata import combining

    from ..kernel.names import unaccented as plain

    single, bare_ones, marks = [], [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue  # surrogates, and syllables that no variant is written in
        own = plain(c)
        if combining(c) or not own:
            marks.append(c)
        elif len(own) == 1 and own != c:
            single.append(c)
            bare_ones.append(own)
    return "".join(single + marks), "".join(bare_ones)


def unaccented(c: Column | str) -> Column:
    """Letters without their accents; ligatures are taken apart."""
    letters, bare_ones = accents()
    c = col(c)
    plain = c
    for one, more in LIGATURES.items():
        plain = F.replace(plain, F.lit(one), F.lit(more))
    plain = F.translate(plain, letters, bare_ones)
    return F.when(c.rlike(r"[^\x00-\x7f]"), plain).otherwise(c)


def enum_match(c: Column | str, variants: list[str | tuple[str, str]]) -> Column:
    """The variant that a text means: exact, without accents, bare, in any case, inside, around, or near by edits."""
    c = trimmed(c)
    strings = [(s, n) for v in variants for n, about in [(v, None) if isinstance(v, str) else v] for s in ([n] if about is None else [n, about, f"{n}: {about}"])]
    low = F.lower(bare(c))
    from ..kernel.names import bare as plain
    from ..kernel.names import unaccented as unaccented_text

    lows = [(plain(s).lower(), n) for s, n in strings]
    chain = lambda mine, own: F.coalesce(*(F.when(mine == s, n) for s, n in own))
    longest = sorted(lows, key=lambda s: -len(s[0].encode()))
    shortest = sorted(lows, key=lambda s: len(s[0].encode()))
    inside = F.coalesce(*(F.when(F.contains(low, F.lit(s)), n) for s, n in longest))
    around = F.coalesce(*(F.when(F.contains(F.lit(s), low), n) for s, n in shortest))
    edits = [F.struct(F.levenshtein(low, F.lit(s)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (s, n) in enumerate(lows)]
    nearest = F.array_min(F.array(*edits))
    near = F.when(nearest["d"] <= F.floor(F.octet_length(low) / 3), nearest["n"])
    folded = chain(unaccented(c), [(unaccented_text(s), n) for s, n in strings])
    return F.coalesce(chain(c, strings), folded, chain(bare(c), [(plain(s), n) for s, n in strings]), chain(low, lows), inside, around, near)


def fence_blocks(c: Column | str) -> Column:
    """ARRAY<STRUCT<lang, content>> of fenced code blocks."""
    pattern = F.lit("(?s)```(\\w*)\\n(.*?)```")
    return F.arrays_zip(F.regexp_extract_all(col(c), pattern, F.lit(1)).alias("lang"), F.regexp_extract_all(col(c), pattern, F.lit(2)).alias("content"))
