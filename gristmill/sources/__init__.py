"""Messy text from files and streams, and typed results to files.

Any Spark reader that gives a STRING column is a source; these are the forms
that messy text usually comes in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """path, text: one row per file, or per line."""
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def jsonl_texts(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The string field of each line of JSON lines; other fields are not read."""
    return spark.read.schema(f"`{field}` STRING").json(path).select(F.col(field).alias("text"))


def csv_texts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A column of CSV files with a header; quoted fields may span lines."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select(F.col(column).alias("text"))


def table_texts(spark: SparkSession, path: str, column: str, format: str = "parquet", keep: list[str] | None = None) -> DataFrame:
    """A text column of a columnar table, with the columns to keep; only these are scanned."""
    return spark.read.format(format).load(path).select(*(keep or []), F.col(column).alias("text"))


def write_split(df: DataFrame, path: str, error: str = "parsed_error", format: str = "parquet") -> None:
    """Typed rows below path/good, the others with their errors below path/quarantine; one
    pass over the input, partitioned by outcome."""
    outcome = F.when(F.col(error).isNull(), "good").otherwise("quarantine")
    df.withColumn("outcome", outcome).write.partitionBy("outcome").format(format).save(path)


def write_explanations(df: DataFrame, candidate: str, path: str) -> None:
    """One line of JSON for each row: how its value came about."""
    from ..operators.parse import explanation

    df.select(explanation(candidate).alias("value")).write.text(path)
