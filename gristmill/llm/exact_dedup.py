"""Exact dedup by an extendible-hash index on shared files.

The key of a text is its SHA-256 (or a prefix of it, `key_hex` hex digits).
Keys that occur once need no more work.  The others are entries of an index: a
directory of 2**depth slots maps leading key bits to buckets; a bucket whose
texts take more than `capacity` bytes splits, and the directory doubles when
the bucket's own depth passes the global one.  Each bucket, a range of keys,
belongs to one owner task.  Copies meet before they travel, so an owner gets
each different text of a key once, compares their bytes, and chains them: a
key's chain has a link for each different text, with its rows' number and the
one that stays.  A key whose chain has several links (a collision) is settled
by text, any other by key.

Defined results: a null text equals the empty text; of equal rows (same
doc_id and text) exactly one stays; a null doc_id stays only if its group has
no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_ids, fresh, id_and_text, parts, pick, scratch, store

#: Leading bits the directory may use: at most 2**DEPTH sums reach the driver.
DEPTH = 16
#: Bytes of texts that one bucket may hold, and that an entry takes besides its text.
CAPACITY, ENTRY = 1 << 25, 64
#: Entries that are broadcast to their rows; more are joined by a shuffle.
BROADCAST_ENTRIES = 200_000
NO_ID = -(1 << 63)


def build_directory(loads: dict[int, int], capacity: int) -> tuple[int, list[int]]:
    """(global depth, slots): loads[prefix of DEPTH bits] is what the keys with this prefix weigh.

    A bucket is not split where one prefix has all its load, as that would not lighten it."""
    total = np.zeros((1 << DEPTH) + 1, dtype=np.int64)
    for prefix, n in loads.items():
        total[prefix + 1] = n
    several = np.cumsum(total > 0)
    total = np.cumsum(total)
    depth, slots = 0, [0]
    buckets = [(0, 0)]  # local depth, leading bits
    work = [0]
    while work:
        b = work.pop()
        local, bits = buckets[b]
        width = 1 << (DEPTH - local)
        low, high = bits * width, (bits + 1) * width
        if total[high] - total[low] <= capacity or several[high] - several[low] <= 1:
            continue
        if local == depth:
            slots = [s for s in slots for _ in (0, 1)]
            depth += 1
        buckets[b] = (local + 1, bits << 1)
        buckets.append((local + 1, bits << 1 | 1))
        span = depth - local - 1
        start = (bits << 1 | 1) << span
        slots[start : start + (1 << span)] = [len(buckets) - 1] * (1 << span)
        work += [b, len(buckets) - 1]
    return depth, slots


def index_copies(rows: DataFrame, keys: DataFrame, capacity: int | None = None) -> DataFrame:
    """key, bucket, n_links, size, keep (the greatest doc_id): the chains of the keys (key, bytes) that occur twice or more in rows (doc_id, text, key)."""
    spark = rows.sparkSession
    prefix = F.conv(F.substring("key", 1, DEPTH // 4), 16, 10).cast("int")
    loads = {r["prefix"]: r["n"] for r in keys.groupBy(prefix.alias("prefix")).agg(F.sum(F.col("bytes") + ENTRY).alias("n")).collect()}
    depth, slots = build_directory(loads, capacity or min(CAPACITY, 1 + sum(loads.values()) // (4 * parts(spark))))
    # from Arrow: of a list, executors would start Python workers of another kind, which stay beside those of the operators
    directory = spark.createDataFrame(pa.table({"slot": pa.array(range(len(slots)), pa.int32()), "bucket": pa.array(slots, pa.int32())}))
    index = keys.select("key", F.shiftright(prefix, DEPTH - depth).alias("slot")).join(F.broadcast(directory), "slot").select("key", "bucket")
    found = rows.join(F.broadcast(index) if keys.count() <= BROADCAST_ENTRIES else index, "key")
    # copies meet before they travel; then all links of a bucket come to its owner, which lays their chains
    links = found.groupBy("bucket", "key", "text").agg(F.count("*").alias("size"), F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("keep"))
    owned = links.repartition(parts(spark), "bucket").groupBy("bucket", "key")
    return store(owned.agg(F.count("*").alias("n_links"), F.sum("size").alias("size"), F.max("keep").alias("keep")), "dedup-chains")


def find_copies(docs: DataFrame, key_hex: int = 64, capacity: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket: one row per row of docs (bucket: null for a key that occurs once)."""
    with scratch(docs.sparkSession):
        return store(_copies(id_and_text(docs), key_hex, capacity), "dedup-found", lasting=True)


def _copies(docs: DataFrame, key_hex: int, capacity: int | None) -> DataFrame:
    text, key = F.coalesce("text", F.lit("")), F.substring("sha", 1, key_hex)
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("sha")).withColumn("key", key)
    entries = store(rows.select("doc_id", "sha", F.octet_length("text").alias("bytes")).withColumn("row", F.monotonically_increasing_id()), "dedup-entries").withColumn("key", key)
    several = entries.groupBy("key").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes")).where("n > 1")
    chains = index_copies(rows.select("doc_id", "text", "key"), store(several.select("key", "bytes"), "dedup-keys"), capacity)
    few = chains.count() <= BROADCAST_ENTRIES

    def small(df):
        return F.broadcast(df) if few else df

    own = F.coalesce("doc_id", F.lit(NO_ID))
    placed = entries.join(small(chains), "key", "left")
    settled = placed.where("n_links is null or n_links = 1")
    settled = settled.withColumns({"size": F.coalesce("size", F.lit(1)), "keep": F.coalesce("keep", own)})
    # of rows that share text and the greatest doc_id, one stays
    last = settled.where((own == F.col("keep")) & (F.col("size") > 1)).groupBy("key").agg(F.max("row").alias("last"))
    settled = settled.join(small(last), "key", "left").withColumn("kept", (own == F.col("keep")) & F.coalesce(F.col("row") == F.col("last"), F.lit(True)))
    columns = ["doc_id", "sha", "size", "keep", "kept", "bucket"]
    settled = settled.select(columns)
    split = chains.where("n_links > 1").select("key", "bucket")
    if split.limit(1).count():  # keys that collide: each text is a link of its own
        chained = store(rows.join(small(split), "key").withColumn("row", F.monotonically_increasing_id()), "dedup-chained")
        top = F.max(F.struct(own.alias("id"), "row"))
        links = chained.groupBy("key", "text").agg(top.alias("top"), F.count("*").alias("size"))
        chained = chained.join(links, ["key", "text"]).withColumn("keep", F.col("top.id"))
        settled = settled.unionByName(chained.withColumn("kept", (own == F.col("keep")) & (F.col("row") == F.col("top.row"))).select(columns))
    keep_id = F.when(F.col("keep") != NO_ID, F.col("keep"))
    return settled.select("doc_id", keep_id.alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"), "bucket")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows are matched by doc_id or, where ids repeat, by doc_id and text; of rows
    that are equal in both one stays."""
    found = find_copies(docs).select("doc_id", "kept", "text_sha256")
    if distinct_ids(found):
        return pick(docs, found.where("not kept"), keep=False)
    key, own_id, own_sha = fresh(docs, "key"), fresh(docs, "id"), fresh(docs, "sha")
    stays = found.where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha))
    with_sha = docs.withColumn(key, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_sha))
    return with_sha.join(stays, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
