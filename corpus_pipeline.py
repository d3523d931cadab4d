"""A training-data pipeline: each stage works on all that its predecessor kept.

Documents without a known language go; of equal texts one stays; of each group
of near copies one stays; documents that hold a benchmark item go; the rest is
packed into sequences.  Every stage takes null texts and ids, equal rows, empty
tables and other columns as its operator does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from gristmill.llm.common import bounded_batches, in_fold, remove, shared_dir, table
from gristmill.llm.queries import RANKS, VOCABULARY


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return language_id.keep_known(docs, language_id.train(docs, ~in_fold(3, 1)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return ngram_join.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack_documents(docs, VOCABULARY, RANKS)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("decontaminate", without_leaks),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """Applies STAGES to documents; what each returns is written below the shared folder and read again.

    A stage's files go when the next one's are whole.  resume names a folder for them; a run that is given
    the folder of one that failed goes on after the last stage that was whole."""
    docs = table(spark, sf_dir, "documents")
    base = resume or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    paths = [f"{base}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    whole = [k for k, path in enumerate(paths) if exists(spark, f"{path}/_SUCCESS")]
    for k, (_, stage) in enumerate(STAGES):
        if k > max(whole, default=-1):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        if k >= max(whole, default=-1):
            docs = spark.read.parquet(paths[k])
            if k:
                remove(spark, paths[k - 1])
    return docs


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
