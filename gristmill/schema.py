"""Target schemas: a Spark type, with field metadata for what it cannot say.

Metadata keys of a field:
  enum      list of names or of {"name", "description"}: the field is a STRING from this domain
  union     list of alternatives' field names: the field is a STRUCT<tag STRING, v1 T1, v2 T2, ...>
  scored    true: of a union, the alternative with the least penalties is taken, not the first that fits
  coerce    name of one of the coercers that are given with the schema: a user's own reading of the value
  payload   true: a STRUCT with one field per variant, for enums whose variants carry values;
            a variant without a value is a BOOLEAN field
  tuple     true: a STRUCT that is read by position
  json      true: a STRING that takes any value, as canonical JSON
  char      true: a STRING of one character
  unsigned  true: the integer may not be negative
  required  true/false: overrides nullable, which Spark does not always keep
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Bits of the integer types.
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


@dataclass(frozen=True)
class Coercer:
    """A user's reading of JSON values for fields with this name as `coerce`: `coerce` returns a value of
    the field's type or raises; `strict`, if given, accepts only values that need no change."""

    name: str
    coerce: Callable
    strict: Callable | None = None


@dataclass(frozen=True)
class Shape:
    """What a value is coerced to; plain data, so that it travels to the workers."""

    kind: str
    low: int = 0
    high: int = 0
    single: bool = False
    item: Shape | None = None
    key: Shape | None = None
    fields: tuple[tuple[str, Shape, bool], ...] = ()  # name, shape, optional
    variants: tuple[tuple[str, str | None], ...] = field(default=())
    own: Coercer | None = None
    substrings: bool = False  # whether a key that holds a field's name, or is held by it, may serve


def of(kind: T.DataType, metadata: dict | None = None, coercers: Iterable[Coercer] = (), substrings: bool = False) -> Shape:
    """The shape of a Spark type."""
    m, named = metadata or {}, {c.name: c for c in coercers}
    inner = lambda kind, m=None: of(kind, m, coercers, substrings)
    if m.get("coerce"):
        if m["coerce"] not in named:
            raise KeyError(f"no coercer is named {m['coerce']!r}")
        return Shape("custom", own=named[m["coerce"]])
    if m.get("enum"):
        return Shape("enum", variants=tuple((v, None) if isinstance(v, str) else (v["name"], v.get("description")) for v in m["enum"]))
    if isinstance(kind, T.StringType):
        return Shape("json" if m.get("json") else "char" if m.get("char") else "string")
    if type(kind) in BITS:
        n = BITS[type(kind)]
        return Shape("int", 0 if m.get("unsigned") else -(1 << (n - 1)), (1 << (n - 1)) - 1)
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return Shape("decimal", 0 if m.get("unsigned") else 1 - 10**kind.precision, min(10**kind.precision - 1, (1 << 64) - 1 if m.get("unsigned") else 10**38))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return Shape("float", single=isinstance(kind, T.FloatType))
    if isinstance(kind, T.BooleanType):
        return Shape("bool")
    if isinstance(kind, T.NullType):
        return Shape("unit")
    if isinstance(kind, T.ArrayType):
        return Shape("list", item=inner(kind.elementType, m.get("items")))
    if isinstance(kind, T.MapType):
        return Shape("map", key=inner(kind.keyType), item=inner(kind.valueType, m.get("items")))
    if isinstance(kind, T.StructType):
        fields = tuple((f.name, inner(f.dataType, f.metadata), _optional(f)) for f in kind.fields)
        if m.get("union"):
            return Shape("scored" if m.get("scored") else "union", fields=tuple(f for f in fields if f[0] != "tag"))
        return Shape("payload" if m.get("payload") else "tuple" if m.get("tuple") else "struct", fields=fields, substrings=substrings)
    raise TypeError(f"no text can be coerced to {kind.simpleString()}")


def _optional(f: T.StructField) -> bool:
    return not f.metadata["required"] if "required" in f.metadata else f.nullable


def parse(schema: T.DataType | str) -> T.DataType:
    return T.DataType.fromDDL(schema) if isinstance(schema, str) else schema


def required(name: str, kind: T.DataType | str, **metadata) -> T.StructField:
    return T.StructField(name, parse(kind), False, metadata)


def optional(name: str, kind: T.DataType | str, **metadata) -> T.StructField:
    return T.StructField(name, parse(kind), True, metadata)


def enum(name: str, *variants, optional: bool = False) -> T.StructField:
    """A field from a closed domain; a variant is a name or (name, description)."""
    own = [v if isinstance(v, str) else {"name": v[0], "description": v[1]} for v in variants]
    return T.StructField(name, T.StringType(), optional, {"enum": own})


def union(name: str, *alternatives: T.StructField, optional: bool = False, scored: bool = False) -> T.StructField:
    """A field of the first alternative that fits, or with scored of the cheapest: STRUCT<tag STRING, ...alternatives>."""
    inner = T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(a.name, a.dataType, True, a.metadata) for a in alternatives)])
    return T.StructField(name, inner, optional, {"union": [a.name for a in alternatives]} | ({"scored": True} if scored else {}))
