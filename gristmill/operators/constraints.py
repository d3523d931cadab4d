"""Constraints: asserts that a row must meet, checks that are only counted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSERT, CHECK = "assert", "check"
# Penalties of failed constraints.
FAILED = {ASSERT: 100, CHECK: 10}


@dataclass
class Constraint:
    level: str
    name: str
    predicate: Column | Callable[[Column], Column]  # of the parsed value, where it is checked within a parse
    description: str = ""

    @classmethod
    def hard(cls, name: str, predicate: Column | Callable[[Column], Column], description: str = "") -> Constraint:
        return cls(ASSERT, name, predicate, description)

    @classmethod
    def soft(cls, name: str, predicate: Column | Callable[[Column], Column], description: str = "") -> Constraint:
        return cls(CHECK, name, predicate, description)

    @property
    def is_assert(self) -> bool:
        return self.level == ASSERT

    @property
    def is_check(self) -> bool:
        return self.level == CHECK

    def on(self, value: Column) -> Constraint:
        """The constraint with its predicate applied to value."""
        return replace(self, predicate=self.predicate(value)) if callable(self.predicate) and not isinstance(self.predicate, Column) else self

    def result(self) -> Column:
        """STRUCT<name, description, level, passed>; a null predicate has not passed."""
        passed = F.coalesce(self.predicate, F.lit(False))
        return F.struct(F.lit(self.name).alias("name"), F.lit(self.description).alias("description"), F.lit(self.level).alias("level"), passed.alias("passed"))


def results(constraints: list[Constraint]) -> Column:
    if not constraints:
        return F.array().cast("array<struct<name:string,description:string,level:string,passed:boolean>>")
    return F.array(*(c.result() for c in constraints))


def asserts_passed(r: Column | str) -> Column:
    return F.forall(r, lambda x: x["passed"] | (x["level"] != ASSERT))


def failing_asserts(r: Column | str) -> Column:
    return F.filter(r, lambda x: ~x["passed"] & (x["level"] == ASSERT))


def checks(r: Column | str) -> Column:
    return F.filter(r, lambda x: x["level"] == CHECK)


def penalty(r: Column | str) -> Column:
    """What failed constraints add to a score."""
    cost = lambda x: F.when(x["passed"], 0).when(x["level"] == ASSERT, FAILED[ASSERT]).otherwise(FAILED[CHECK])
    return F.aggregate(F.transform(r, cost), F.lit(0), lambda a, x: a + x)


def describe(r: Column | str) -> Column:
    """One line for each constraint."""
    line = lambda x: F.concat(x["level"], F.lit(" '"), x["name"], F.when(x["passed"], "': passed").otherwise("': failed"))
    return F.array_join(F.transform(r, line), "\n")


def split(df: DataFrame, constraints: list[Constraint]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all asserts, rows that do not), both with a `constraints` column. No shuffle."""
    with_results = df.withColumn("constraints", results(constraints))
    passed = asserts_passed("constraints")
    return with_results.where(passed), with_results.where(~passed)


def rates(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """name, level, rows, passed: one row per constraint, by one pre-aggregated pass."""
    one = df.select(F.inline(results(constraints)))
    return one.groupBy("name", "level").agg(F.count("*").alias("rows"), F.count_if("passed").alias("passed"))
