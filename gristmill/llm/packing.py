"""Best-fit packing of token sequences by large-item matching.

Documents become token ids, and pieces of at most `capacity` ids.  Packing
works on the histogram of piece lengths, which has `capacity` entries at any
input size: pieces above a third of the capacity are matched greedily, the
longest with the longest that still fits, at most two in a bin; shorter ones,
longest first, go to the tightest gap they fit in, and open a bin only where
none is left.  Bins of one make are a class with a count, so the plan is a
bounded table.  Each piece then takes the place that its rank among pieces of
its length gives it; ranks come from windows of WINDOW_ROWS pieces or so, so a
very common length is not one task's work.

Defined results: a null or empty text is one piece of the closing id alone;
repeated rows are packed each; a null doc_id is carried along.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, kept, resolved, scratch, small_batches, store

CAPACITY = 2048
#: Rows that one ranking window should hold.
WINDOW_ROWS = 2000


class Encoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    Texts that may hold a special token are left to the tokenizer itself, which
    is read when the first of them comes."""

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.path = path
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        ids = array("I", self.whole.encode(text, add_special_tokens=False).ids if "<|" in text else self.fast.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than capacity if there are several."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, path: str | Callable[[], str], ranks: str | Callable[[], str], capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for): the pieces of every document; deal: a
    number that tells equal rows of one task apart."""
    names = ["deal", "doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "deal bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches):
        name = f"encoder {path}"
        encoder = kept(name, lambda: Encoder(resolved(path), resolved(ranks)), heavy=True)
        dealt = 0
        for batch in small_batches(batches, heavy=name):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview((encoder.encode(text) if text else b"") + b"\0\0\0\0")
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((dealt, doc_id, k, start, n, zlib.crc32(own), *([bytes(own)] * with_ids)))
                    dealt += 1
            columns = list(zip(*rows)) if rows else [()] * (6 + with_ids)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names + ["ids"] * with_ids)

    return id_and_text(docs).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Classes of bins, (count, lengths in each), that hold the whole histogram."""
    left = {n: c for n, c in histogram.items() if c}
    bins: list[list] = []  # [count, gap, lengths]
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        k = bisect_left(large, capacity - n + 1) - 1
        mate = large[k] if k >= 0 else None
        if mate == n and left[n] == 1:  # the last of its length: the next shorter one
            mate = large[k - 1] if k > 0 else None
        if mate is None:
            bins.append([left[n], capacity - n, [n]])
            left[n] = 0
        elif mate == n:
            bins.append([left[n] // 2, capacity - 2 * n, [n, n]])
            left[n] %= 2
        else:
            c = min(left[n], left[mate])
            bins.append([c, capacity - n - mate, [n, mate]])
            left[n] -= c
            left[mate] -= c
        large = [x for x in large if left[x]] if not left[n] or (mate and not left[mate]) else large
    gaps: dict[int, list[list]] = {}
    for b in bins:
        gaps.setdefault(b[1], []).append(b)
    order = sorted(gaps)

    def put(b: list) -> None:
        if b[1] not in gaps:
            gaps[b[1]] = []
            insort(order, b[1])
        gaps[b[1]].append(b)

    for n in sorted((x for x in left if left[x]), reverse=True):
        c = left[n]
        while c:
            at = bisect_left(order, n)
            if at == len(order):
                b = [-(-c // (capacity // n)), capacity, []]
            else:
                b = gaps[order[at]].pop()
                if not gaps[order[at]]:
                    del gaps[order.pop(at)]
            each = min(b[1] // n, c)
            used = min(b[0], c // each)
            if used < b[0] and b[2]:
                put([b[0] - used, b[1], b[2]])
            put([used, b[1] - each * n, b[2] + [n] * each])
            c -= used * each
    return [(b[0], b[2]) for g in gaps.values() for b in g if b[2]]


def places(classes: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: count places from each."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in classes:
        offset = 0
        for n in lengths:
            rows.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + count
            offset += n
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, as pieces() gives them, with sequence_id and offset; cut_up must be a stored table."""
    spark = cut_up.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    salts = [-(-histogram.get(n, 1) // WINDOW_ROWS) for n in range(1, capacity + 1)]
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "deal"), F.element_at(F.lit(salts), F.col("length").cast("int"))))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "deal")) - 1
    ranked = salted.withColumn("rank", rank).join(counts.select("length", "salt", before.alias("before")), ["length", "salt"])
    columns = [c for c in cut_up.columns if c != "deal"]
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).cast("bigint").alias("rank"))

    def run(batches):
        places = table.value
        key = places[:, 0] << 44 | places[:, 1]
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, n << 44 | rank, side="right") - 1
            found = places[at] if len(places) else np.zeros((0, 4), dtype=np.int64)
            own = [c for c in batch.schema.names if c != "rank"]
            arrays = [batch.column(c) for c in own] + [pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3].copy())]
            yield pa.RecordBatch.from_arrays(arrays, own + ["sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema if f.name in columns)
    return ranked.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | Callable[[], str], ranks: str | Callable[[], str], capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    with scratch(docs.sparkSession):
        return store(pack(store(pieces(docs, path, ranks, capacity, with_ids), "pieces"), capacity), "packed", lasting=True)
