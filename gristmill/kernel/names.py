"""Fuzzy names: object keys against field names, texts against enum variants."""

from __future__ import annotations

import unicodedata

# Letters that decomposition does not take apart.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE"}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    while rest and not head:
        head, *rest = rest
    joined = head + "".join(part[:1].upper() + part[1:] for part in rest)
    return joined[:1].lower() + joined[1:] if joined[:1].isascii() else joined


def snake(name: str) -> str:
    out = []
    for i, c in enumerate(name):
        out.append("_" * (i > 0) + c.lower() if c.isupper() else "_" if c in "-." else c)
    return "".join(out)


def unaccented(text: str) -> str:
    text = "".join(LIGATURES.get(c, c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def bare(text: str) -> str:
    """Letters, digits, hyphens and underscores."""
    return "".join(c for c in text if c.isalnum() or c in "-_")


_forms: dict[str, tuple[str, str, str, str, str]] = {}


def forms(name: str) -> tuple[str, str, str, str, str]:
    if name not in _forms:
        if len(_forms) > 10_000:
            _forms.clear()
        stripped = bare(name)
        _forms[name] = camel(name), snake(name), unaccented(name), stripped, stripped.lower()
    return _forms[name]


def find_key(keys: list[str], name: str, substrings: bool = False) -> str | None:
    """The key that serves a field: exact, another case style, without accents,
    without punctuation, in any case, and, if asked for, one inside the other.
    keys must be sorted: within a step the first one wins."""
    if name in keys:
        return name
    mine = forms(name)
    cases = {mine[0], mine[1]}

    def restyled(key: str) -> bool:
        own = forms(key)
        return key in cases or name in own[:2] or own[0] == mine[0] or own[1] == mine[1]

    steps = [restyled, lambda k: forms(k)[2] == mine[2], lambda k: forms(k)[3] == mine[3], lambda k: forms(k)[4] == mine[4]]
    if substrings:
        steps.append(lambda k: k in name or name in k)
    return next((key for fits in steps for key in keys if fits(key)), None)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def find_variant(text: str, variants: list[tuple[str, str | None]]) -> str | None:
    """The variant (name, description) that text means, or None.

    Exact, without accents, without punctuation, in any case; then the longest
    variant inside the text, the shortest around it; then the nearest one, if
    no more than a third of the text's bytes are edits."""
    text = text.strip()
    strings = [(s, name) for name, about in variants for s in ([name] if about is None else [name, about, f"{name}: {about}"])]
    for form in (lambda s: s, unaccented, bare, lambda s: bare(s).lower()):
        mine = form(text)
        for s, name in strings:
            if form(s) == mine:
                return name
    low = bare(text).lower()
    stripped = [(bare(s).lower(), name) for s, name in strings]
    size = lambda s: len(s[0].encode())
    inside = [s for s in stripped if s[0] in low]
    if inside:
        return max(inside, key=size)[1]
    around = [s for s in stripped if low in s[0]]
    if around:
        return min(around, key=size)[1]
    nearest = min(((edit_distance(low, s), name) for s, name in stripped), key=lambda x: x[0], default=None)
    return nearest[1] if nearest and nearest[0] <= len(low.encode()) // 3 else None
