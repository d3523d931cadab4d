"""Messy text columns into typed columns.

Clean rows of flat schemas of numbers, booleans and strings never reach Python:
from_json reads them, column functions make numbers of their texts, and the
kernel gets a null in their place.  All other rows go to the kernel in Arrow
batches.  Nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import schema as S
from ..functions.text import STRICT, col, double_to_bigint, is_clean, openers, strip_invisible, to_bigint, to_bool, to_double
from ..kernel import candidates as C
from ..kernel import jsontext
from ..kernel.coerce import from_text
from .constraints import ASSERT, CHECK, FAILED, Constraint, results

NOTE = T.StructType().add("type", T.StringType()).add("penalty", T.IntegerType()).add("payload", T.StringType())
CANDIDATE = (
    T.StructType().add("value", T.StringType()).add("source", T.StringType()).add("lang", T.StringType()).add("fixes", T.ArrayType(T.StringType())).add("index", T.IntegerType())
    .add("pattern", T.StringType()).add("confidence", T.FloatType()).add("score", T.IntegerType()).add("transformations", T.ArrayType(NOTE)).add("max_depth", T.IntegerType())
)
ERROR = T.StructType().add("code", T.StringType()).add("message", T.StringType()).add("path", T.StringType())
#: Scalar types that column functions read exactly as the kernel does.
PLAIN = (T.LongType, T.BooleanType, T.DoubleType, T.StringType)
#: Integers up to here are read by column functions; larger ones are left to the kernel.
EXACT = 9e18


def candidate_row(c: C.Candidate) -> dict:
    notes = [{"type": t["type"], "penalty": t["penalty"], "payload": jsontext.write({k: v for k, v in t.items() if k not in ("type", "penalty")})} for t in c.transformations]
    return {
        "value": jsontext.write(c.value), "source": c.source, "lang": c.lang, "fixes": c.fixes, "index": c.index, "pattern": c.pattern,
        "confidence": c.confidence, "score": C.score(c), "transformations": notes, "max_depth": c.max_depth,
    }


def _to_arrow(rows: list, kind: T.DataType) -> pa.Array:
    return pa.array(rows, to_arrow_type(kind))


def result_type(schema: T.DataType, with_candidates: bool, provenance: bool = True) -> T.StructType:
    fields = [T.StructField("value", _nullable(schema)), T.StructField("error", ERROR)]
    fields += [T.StructField("winner", CANDIDATE)] * provenance
    return T.StructType(fields + [T.StructField("candidates", T.ArrayType(CANDIDATE))] * with_candidates)


def _nullable(kind: T.DataType) -> T.DataType:
    """The type without metadata and with all parts nullable: any of them may fail."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _nullable(kind.valueType), True)
    return kind


def parser(
    schema: T.DataType | str, mode: str = "fuzzy", strategies: Iterable | None = None, with_candidates: bool = False, full_provenance: bool = False, provenance: bool = True,
    coercers: Iterable[S.Coercer] = (), substrings: bool = False, cleaners: Iterable | None = None, extractors: Iterable | None = None, yaml: bool = True,
):
    """The Arrow function of one text column behind from_messy_json(); without
    provenance the winner is not written out."""
    schema = S.parse(schema)
    shape = S.of(schema, None, tuple(coercers), substrings)
    reading = {"cleaners": cleaners and list(cleaners), "extractors": extractors and list(extractors), "yaml": yaml}
    out = result_type(schema, with_candidates, provenance)
    chosen = None if strategies is None else list(strategies)

    @F.arrow_udf(out)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for one in texts.to_pylist():
            if one is None:
                rows.append(None)
                continue
            value, winner, ranked, error = from_text(one, shape, mode, chosen, full_provenance, with_candidates, **reading)
            row = {"value": value, "error": error and {"code": error.code, "message": str(error), "path": error.scope}}
            if provenance:
                row["winner"] = winner and candidate_row(winner)
            if with_candidates:
                row["candidates"] = [candidate_row(c) for c in ranked]
            rows.append(row)
        return _to_arrow(rows, out)

    # deterministic, but a filter on the result must not run it a second time
    return run.asNondeterministic()


def from_messy_json(text: Column | str, schema: T.DataType | str, mode: str = "fuzzy", strategies: Iterable | None = None, with_candidates: bool = False, full_provenance: bool = False, constraints: Iterable[Constraint] = (), **options) -> Column:
    """STRUCT<value, error, winner[, candidates][, constraints]>: text coerced to schema.

    mode `basic` takes exact field names, `fuzzy` near ones; strategies are names
    or (function, priority) pairs.  Exactly one of value and error is null, but
    for a null text, which gives a null.  An error tells its code, message and path from <root>.

    Further options: coercers (schema.Coercer, for fields with that name as metadata `coerce`), substrings
    (whether a key inside a field's name, or around it, may serve), cleaners and extractors (in the place of
    the usual ones where no strategy finds anything), yaml (False leaves that reading out).

    constraints are checked on value, each predicate a function of it: the results are listed, and each is a
    transformation of the winner, whose confidence and score it changes."""
    found = parser(schema, mode, strategies, with_candidates, full_provenance, **options)(col(text))
    constraints = list(constraints)
    return F.get(F.transform(F.array(found), lambda m: checked(m, constraints)), F.lit(0)) if constraints else found


def checked(parsed: Column, constraints: list[Constraint]) -> Column:
    """The struct of from_messy_json() with the results of constraints on its value, and a note of each at the winner."""
    from .ranking import decayed, score

    of = results([c.on(parsed["value"]) for c in constraints])
    of = F.when(parsed["value"].isNotNull(), of)
    cost = lambda r: F.when(r["passed"], 0).when(r["level"] == ASSERT, FAILED[ASSERT]).otherwise(FAILED[CHECK])
    payload = lambda r: F.to_json(F.struct((r["level"] == ASSERT).alias("is_assert"), r["name"].alias("name"), r["passed"].alias("passed")))
    notes = F.transform(of, lambda r: F.struct(F.lit("constraint_checked").alias("type"), cost(r).alias("penalty"), payload(r).alias("payload")))
    won = parsed["winner"]
    confidence = (won["confidence"] * decayed(F.lit(len(constraints)))).cast("float")
    won = won.withField("transformations", F.concat(won["transformations"], notes)).withField("confidence", confidence)
    won = won.withField("score", score(won))
    kept = parsed.withField("winner", F.when(parsed["value"].isNotNull(), won).otherwise(parsed["winner"]))
    return F.when(parsed.isNotNull(), kept.withField("constraints", of))


def is_plain(schema: T.DataType) -> bool:
    return isinstance(schema, T.StructType) and len(schema) > 0 and all(type(f.dataType) in PLAIN and not f.metadata and not set('"\\') & set(f.name) for f in schema.fields)


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with signs added until df has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _plain_fields(clean: Column, typed: Column, raw: Column, schema: T.StructType, mode: str) -> list[Column]:
    """The fields of a clean text of one flat object, each null where the kernel is to read it.

    clean: the text; typed: read by from_json in the fields' own types; raw: as strings.  A field must be in
    the text once; whether its value is a string shows after its name."""
    out = []
    for f in schema.fields:
        key = rf'(?<!\\)"\Q{f.name}\E"\s*:'
        quoted, text, own = clean.rlike(key + r'\s*"'), strip_invisible(raw.getField(f.name)), typed.getField(f.name)
        if isinstance(f.dataType, T.StringType):
            value = F.when(quoted, text)
        elif isinstance(f.dataType, T.BooleanType):
            value = F.when(quoted, to_bool(text, mode)).otherwise(own)
        elif isinstance(f.dataType, T.DoubleType):
            value = F.when(quoted, to_double(text, mode)).otherwise(own)
            value = F.when(F.abs(value) < float("inf"), value)
        else:
            value = F.when(quoted, to_bigint(text, mode)).otherwise(F.coalesce(own, double_to_bigint(text.try_cast("double"), mode)))
            value = F.when(F.abs(value.cast("double")) < EXACT, value)
        out.append(F.when(F.regexp_count(clean, F.lit(key)) == 1, value).alias(f.name))
    return out


def parse_column(df: DataFrame, text: str, schema: T.DataType | str, out: str = "parsed", mode: str = "fuzzy", fast: bool = True, constraints: Iterable[Constraint] = (), **options) -> DataFrame:
    """df with the typed value as `out`, the error as `out`_error and, for constraints on the value, their results as `out`_constraints.

    With fast, rows that are clean JSON and hold every field in its own type, or as a text of it, are
    read by column functions, and the kernel sees nulls instead of them."""
    schema, constraints = S.parse(schema), list(constraints)
    messy, clean, plain = _fresh(df, "_messy", "_clean", "_plain")
    kernel = parser(schema, mode, provenance=False, **options)
    if not fast or not is_plain(schema) or options:
        parsed = df.withColumn(messy, kernel(F.col(text)))
        parsed = parsed.withColumn(out, F.col(messy)["value"])
    else:
        kinds = _nullable(schema)
        strings = T.StructType([T.StructField(f.name, T.StringType()) for f in kinds])
        flat = is_clean(text) & (openers(text) == 1) & (F.octet_length(text) <= C.LARGEST)
        parsed = df.withColumn(clean, F.when(flat, strip_invisible(text)))
        typed, raw = (F.from_json(clean, kind, STRICT) for kind in (kinds, strings))
        parsed = parsed.withColumn(plain, F.struct(*_plain_fields(F.col(clean), typed, raw, kinds, mode)))
        whole = reduce(Column.__and__, (F.col(plain).getField(f.name).isNotNull() for f in kinds))
        parsed = parsed.withColumn(plain, F.when(whole, F.col(plain)))
        masked = F.when(F.col(plain).isNull(), F.col(text))
        parsed = parsed.withColumn(messy, kernel(masked))
        parsed = parsed.withColumn(out, F.coalesce(plain, F.col(messy)["value"]))
    parsed = parsed.withColumn(f"{out}_error", F.col(messy)["error"]).drop(messy, clean, plain)
    if constraints:
        of = results([c.on(F.col(out)) for c in constraints])
        parsed = parsed.withColumn(f"{out}_constraints", F.when(F.col(out).isNotNull(), of))
    return parsed


def parse_candidates(text: Column | str, strategies: Iterable | None = None, ranked: bool = False) -> Column:
    """ARRAY<STRUCT<value (canonical JSON), source, ...>>: all readings of a text, without a schema."""
    chosen = None if strategies is None else list(strategies)
    out = T.ArrayType(CANDIDATE)

    @F.arrow_udf(out)
    def run(texts: pa.Array) -> pa.Array:
        order = C.rank if ranked else lambda found: found
        return _to_arrow([None if t is None else [candidate_row(c) for c in order(C.parse(t, chosen))] for t in texts.to_pylist()], out)

    return run.asNondeterministic()(col(text))


def repaired(text: Column | str) -> Column:
    """ARRAY<STRUCT<value, fixes>>: every set of repairs that makes a text JSON."""
    out = T.ArrayType(T.StructType().add("value", T.StringType()).add("fixes", T.ArrayType(T.StringType())))

    @F.arrow_udf(out)
    def run(texts: pa.Array) -> pa.Array:
        from ..kernel.repair import repair

        return _to_arrow([None if t is None else [{"value": jsontext.write(v), "fixes": f} for v, f in repair(t)] for t in texts.to_pylist()], out)

    return run.asNondeterministic()(col(text))


def text_udf(function: Callable[[str], str | None]) -> Callable[[Column | str], Column]:
    """A kernel function from text to text as a column function."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    return lambda c: run(col(c))


def explanation(candidate: Column | str) -> Column:
    """The JSON account of a candidate: source, confidence, score, transformations."""
    from .ranking import fix_description

    c = F.col(candidate) if isinstance(candidate, str) else candidate
    kind = F.lower(F.regexp_replace(c["source"], r"(?<!^)(?=[A-Z])", "_"))
    quoted = lambda x: F.coalesce(F.get(F.split(F.to_json(F.array(x)), r"^\[|\]$"), F.lit(1)), F.lit("null"))
    detail = (
        F.when(c["source"] == "Markdown", F.concat(F.lit(',"language":'), F.when(c["lang"].isNull(), "null").otherwise(quoted(c["lang"]))))
        .when(c["source"] == "Fixed", F.concat(F.lit(',"fixes":'), F.to_json(F.transform(c["fixes"], fix_description))))
        .when(c["source"] == "MultiJson", F.concat(F.lit(',"index":'), c["index"].cast("string")))
        .when(c["source"] == "Heuristic", F.concat(F.lit(',"pattern":'), quoted(c["pattern"])))
        .otherwise("")
    )
    note = lambda t: F.concat(F.lit('{"type":"'), t["type"], F.lit('","penalty":'), t["penalty"].cast("string"), F.when(t["payload"] == "{}", "}").otherwise(F.concat(F.lit(","), F.substr(t["payload"], F.lit(2)))))
    notes = F.array_join(F.transform(c["transformations"], note), ",")
    return F.concat(
        F.lit('{"source":{"type":"'), kind, F.lit('"'), detail, F.lit('},"confidence":'), c["confidence"].cast("string"),
        F.lit(',"score":'), c["score"].cast("string"), F.lit(',"transformations":['), notes,
        F.lit('],"transformation_count":'), F.size(c["transformations"]).cast("string"),
        F.lit(',"max_transformation_depth":'), c["max_depth"].cast("string"), F.lit("}"),
    )


def register_parser(spark: SparkSession, name: str, schema: T.DataType | str, **options) -> None:
    """A SQL function name(text) for one schema; it gives what from_messy_json() does."""
    spark.udf.register(name, parser(schema, **options))


def register(spark: SparkSession) -> None:
    """SQL names: clean_json(text) is the best reading as canonical JSON;
    messy_candidates(text) is a table function of all readings, for LATERAL."""

    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array) -> pa.Array:
        ranked = (None if t is None else C.rank(C.parse(t)) for t in texts.to_pylist())
        return pa.array([jsontext.write(r[0].value) if r else None for r in ranked], pa.string())

    @F.udtf(returnType="ordinal int, value string, source string, fixes array<string>, score int")
    class Candidates:
        def eval(self, text: str):
            for i, c in enumerate(C.parse(text) if text is not None else []):
                yield i, jsontext.write(c.value), c.source, c.fixes, C.score(c)

    spark.udf.register("clean_json", clean)
    spark.udtf.register("messy_candidates", Candidates)
