"""Scores and ranks of candidates as column expressions.

A candidate is a STRUCT with at least source STRING, fixes ARRAY<STRING>,
confidence FLOAT, transformations ARRAY<STRUCT<..., penalty INT>> and
max_depth INT, as parse_candidates() returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernel.candidates import BASE
from ..kernel.coerce import PENALTY
from ..kernel.repair import FIXES


def literal_map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def fix_penalty(code: Column) -> Column:
    return F.element_at(literal_map({k: v[1] for k, v in FIXES.items()}), code)


def fix_description(code: Column) -> Column:
    return F.element_at(literal_map({k: v[2] for k, v in FIXES.items()}), code)


def transformation_penalty(kind: Column) -> Column:
    """For kinds whose penalty does not depend on what they carry."""
    return F.element_at(literal_map(PENALTY), kind)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def base_score(source: Column, fixes: Column) -> Column:
    base = F.element_at(literal_map(BASE), source)
    return base + F.when(source == "Fixed", F.coalesce(total(F.transform(fixes, fix_penalty)), F.lit(0))).otherwise(0)


def score(candidate: Column | str, by_depth: bool = False) -> Column:
    """Lower is better: source, penalties of transformations, lost confidence in hundredths."""
    c = F.col(candidate) if isinstance(candidate, str) else candidate
    penalties = F.coalesce(total(F.transform(c["transformations"], lambda t: t["penalty"])), F.lit(0))
    if by_depth:
        penalties = penalties * F.pow(F.lit(10), c["max_depth"]).cast("int")
    lost = ((F.lit(1).cast("float") - c["confidence"].cast("float")) * F.lit(100).cast("float")).cast("int")
    return base_score(c["source"], c["fixes"]) + penalties + lost


def decayed(transformations: Column) -> Column:
    """Confidence after so many transformations."""
    return F.aggregate(F.sequence(F.lit(1), transformations), F.lit(1.0).cast("float"), lambda a, _: (a * F.lit(0.95).cast("float")).cast("float"))


def rank(candidates: Column | str) -> Column:
    """The array by score; equal scores keep their order."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    keyed = F.transform(c, lambda x, i: F.struct(score(x).alias("score"), i.alias("ordinal"), x.alias("candidate")))
    by = lambda a, b: F.when(a["score"] != b["score"], a["score"] - b["score"]).otherwise(a["ordinal"] - b["ordinal"])
    return F.transform(F.array_sort(keyed, by), lambda x: x["candidate"])


def best(candidates: Column | str) -> Column:
    return F.get(rank(candidates), F.lit(0))


def rank_rows(df: DataFrame, key: str, score: str, ordinal: str) -> DataFrame:
    """df with `rank`, from 1, within each key, for candidates held as rows."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(score, ordinal)))
