"""Messy text in Structured Streaming.

Parsing keeps no state between rows, so the column functions work in a stream
as they are; these helpers add the usual ends of a pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.constraints import Constraint, asserts_passed, results
from ..operators.parse import parse_column


def parsed(stream: DataFrame, text: str, schema, constraints: list[Constraint] | None = None, **options) -> DataFrame:
    """stream with `parsed`, `parsed_error` and, for constraints on parsed, `constraints` and `ok`."""
    out = parse_column(stream, text, schema, **options)
    out = out.withColumn("constraints", results([c.on(F.col("parsed")) for c in constraints or []]))
    return out.withColumn("ok", F.col("parsed_error").isNull() & F.col("parsed").isNotNull() & asserts_passed("constraints"))


def error_rates(stream: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and failures by window of event time, for the output of parsed()."""
    by = F.window(time, window)
    return stream.withWatermark(time, late).groupBy(by).agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("failed"))


def once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived, partitioned by `ok`, and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy("ok").trigger(availableNow=True).start()
