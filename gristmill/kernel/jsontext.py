"""Strict JSON reading and canonical writing.

Integers are exact within -2**63 .. 2**64-1, other numbers are doubles; an
infinite double, a lone surrogate, NaN and nesting over 128 are errors.
Writing sorts keys and uses no spaces.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

DEEPEST = 128
LEAST, MOST = -(1 << 63), 1 << 64
_OPENERS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.S)
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _number(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("number out of range")
    return value


def _integer(text: str) -> int | float:
    if text == "-0":
        return -0.0
    if len(text) > 20:
        return _number(text)
    value = int(text)
    return value if LEAST <= value < MOST else float(value)


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


class _Decoder(json.JSONDecoder):
    def __init__(self):
        super().__init__(parse_float=_number, parse_int=_integer, parse_constant=_constant)

    def __reduce__(self):  # its scanner can't be pickled
        return _Decoder, ()


_DECODER = _Decoder()


def depth(text: str) -> int:
    now = most = 0
    for m in _OPENERS.finditer(text):
        if m[0] in "[{":
            now += 1
            most = max(most, now)
        elif m[0] in "]}":
            now -= 1
    return most


def read(text: str) -> Any:
    """The value of text; ValueError if it isn't JSON as a whole."""
    text = text.strip(" \t\n\r")
    if text.count("[") + text.count("{") > DEEPEST and depth(text) >= DEEPEST:
        raise ValueError("nested too deeply")
    try:
        value = _DECODER.decode(text)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    if _SURROGATE.search(text):
        try:
            json.dumps(value, ensure_ascii=False).encode()
        except UnicodeEncodeError:
            raise ValueError("lone surrogate") from None
    return value


def readable(text: str) -> bool:
    try:
        read(text)
    except ValueError:
        return False
    return True


def number_text(value: int | float) -> str:
    """Shortest digits; plain notation for exponents from -5 to 15."""
    if isinstance(value, int):
        return str(value)
    digits, _, exponent = next(f"{value:.{p}e}" for p in range(18) if float(f"{value:.{p}e}") == value).partition("e")
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    digits, e = digits.replace(".", ""), int(exponent)
    digits = digits.rstrip("0") or "0"
    if value == 0:
        return f"{sign}0.0"
    if 0 <= e < 16:
        whole, rest = digits[: e + 1].ljust(e + 1, "0"), digits[e + 1 :]
        return f"{sign}{whole}.{rest or 0}"
    if -5 <= e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{e}"


def write(value: Any) -> str:
    """Canonical text of a JSON value."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(write, value)) + "]"
    if isinstance(value, float):
        return number_text(value)
    return json.dumps(value, ensure_ascii=False)


def kind(value: Any) -> str:
    if value is None:
        return "null"
    return {bool: "bool", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(value)]
