"""Bounded labelled samples, logistic regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, scratch, store


#: Bytes of texts that a sample brings to the driver.
BYTES = 1 << 26


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, n: int, most: int = BYTES) -> pd.DataFrame:
    """(text, y) of at most n labelled documents where allowed holds for doc_id, by hash order: as many as hold `most` bytes.

    The ids are picked from labels alone; only their texts are read. A document
    with several labels counts with their maximum."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & allowed)
    picked = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = docs.sparkSession.createDataFrame(picked.toPandas(), "doc_id bigint, y int")
    found = id_and_text(docs).join(F.broadcast(picked), "doc_id")
    with scratch(docs.sparkSession):
        found = store(found.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))), "sample")
        sizes = found.select("doc_id", "size", F.xxhash64("doc_id").alias("hash")).toPandas().drop_duplicates("doc_id").sort_values(["hash", "doc_id"])
        last = sizes["hash"][sizes["size"].cumsum() <= most].max() if len(sizes) else 0
        found = found.where(F.xxhash64("doc_id") <= int(last if last == last else -(1 << 63))).drop("size").toPandas()
    return found.drop_duplicates("doc_id").sort_values("doc_id")[["text", "y"]].reset_index(drop=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last, of ridge logistic regression by Newton steps; y may be fractions."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
