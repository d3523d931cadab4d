"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of K-word
shingles is at least NUMERATOR / DENOMINATOR.  Documents with equal sets are
one class, and the join works on classes.

Shingles have one global order: by frequency class, the rare ones first, then
by hash.  If two sets of sizes n and m link, they share t >= 3/4 max(n, m)
shingles, and so their prefixes of n - t + l and m - t + l shingles share at
least l.  Every class chooses its own l, by the estimated cost of its prefix:
longer prefixes cost postings, but each candidate must match l times before it
is verified.  A pair is held to the smaller l of its two.

A pair's first common shingle bounds its overlap by what follows it in either
set, so only pairs whose first match leaves room for t are verified.

Lists of postings up to SHORT long give all their pairs.  A longer list gives
the pairs of each member with a hub of about its size, and then
with the nearest member of another component, by 256-bit parity maps.  After
these have been verified, members of one component need no more pairs, and all
pairs across components that can link are made, counted and verified.  So a
large group of near copies costs pairs in proportion to its size, and no link
between components is lost.  A list is stored in blocks of BLOCK members in
order of size; members outside its largest component meet it block by block,
so no list is the work of one task, and blocks that differ too much in size,
or whose shingle comes too late, do not meet.

Shingles are compared by 64-bit hashes, classes by 64-bit hashes of sets.

Defined results: null, empty and blank texts have no shingle, link with
nothing, and are their own component; repeated rows are rows of one class; a
row with a null doc_id links like any other, but never names a component
unless all its rows have none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, distinct_ids, drop, id_and_text, lean, parts, pick, scratch, small_batches, store
from .textkernel import set_key, shingle_sets

K = 5
NUMERATOR, DENOMINATOR = 3, 4
#: Prefix extensions to choose from.
LEVELS = (1, 2, 3, 4, 6, 8)
#: A shingle in more documents than this has its frequency told to all tasks ...
FREQUENT = 16
#: ... but of the most frequent ones this many at most: 16 bytes each.
MOST_FREQUENT = 1 << 20
#: Cost of verifying one candidate, in postings, and matches expected of a rare shingle.
VERIFY_COST, RARE_MATCHES = 20.0, 0.1
SHORT = 8
#: Postings of one frequent shingle that one group holds.
SALTED = 50_000
#: Members of a long list that meet others as one block, and among which each member's nearest is sought.
BLOCK, NEAREST = 512, 2048
#: Comparisons left over for which another round of nearest members is worth its while.
PATIENCE = 10_000_000_000
#: Long lists whose numbers a member carries along.
LISTS = 128
#: Members that one verification group holds, beside its hub.
GROUP = 256
#: Bytes of sets that a worker hands over at once.
SETS = 1 << 21
#: Places in verification groups (16 bytes each) that are broadcast to pick documents out; more are joined by a shuffle.
BROADCAST_PLACES = 250_000
#: Bytes of input for each range of the hash space, and ranges at most.
RANGE_BYTES, MOST_RANGES = 1 << 22, 1 << 18
#: Shingles a task holds before it writes them out.
HELD = 500_000
BITS = 40
SQL_NAMES = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean"}

#: pos: the shingle's place in its set, in the global order.
POSTING = np.dtype([("at", "<u4"), ("cid", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("level", "u1")])


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def planes(values: np.ndarray) -> bytes:
    """The bytes of values, most significant ones together, so that they compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def n_buckets(docs: DataFrame) -> int:
    """Ranges of the hash space, a power of two: 256 at least, and more for a larger input, by Spark's estimate of its size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(4 * parts(docs.sparkSession), min(-(-size // RANGE_BYTES), MOST_RANGES), 256)
    return 1 << (wanted - 1).bit_length()


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text, and key: the doc_id, or without one a hash of the text, by which a row is found again."""
    return id_and_text(docs).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))


def spill(found: list[np.ndarray], buckets: int):
    """(bucket, bytes) of the sorted 40-bit hashes in found: gaps between neighbours, as numbers of four bytes."""
    t = np.sort(np.concatenate(found))
    width = (1 << BITS) // buckets
    edges = np.searchsorted(t, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width))
    for b in range(buckets):
        own = t[edges[b] : edges[b + 1]]
        if len(own):
            yield b, planes(np.diff(own, prepend=np.uint64(b * width)).astype("<u4"))


def describe(docs: DataFrame, k: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Reads docs once: (doc_id, key, n, cid, bits) of each row, and the shingles' hashes by bucket."""
    names = ["doc_id", "key", "n", "cid", "bits", "bucket", "blob"]

    def run(batches):
        held, count = [], 0
        for batch in small_batches(batches):
            ns, cids, bits = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), k):
                ns.append(len(s))
                bits.append(np.packbits(np.bincount(s & np.uint64(255), minlength=256).astype(np.uint8) & 1).tobytes())
                cids.append(set_key(s))
                held.append(s >> np.uint64(64 - BITS))
                count += len(s)
            none = [pa.nulls(len(ns), kind) for kind in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(ns, pa.int64()), pa.array(signed(np.array(cids, dtype=np.uint64))), pa.array(bits, pa.binary()), *none], names)
            if count >= HELD:
                yield from blobs(held)
                held, count = [], 0
        if count:
            yield from blobs(held)

    def blobs(held):
        got = list(spill(held, buckets))
        none = [pa.nulls(len(got), kind) for kind in (*[pa.int64()] * 4, pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([b for b, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names)

    # rows and blobs have columns of their own, so that each is read alone
    found = store(docs.mapInArrow(run, "doc_id bigint, key bigint, n bigint, cid bigint, bits binary, bucket int, blob binary"), "join-rows")
    return found.where("bucket is null").select("doc_id", "key", "n", "cid", "bits"), found.where("bucket is not null").select("bucket", "blob")


def frequent(blobs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, df), by token, of the shingles in more than FREQUENT documents, the most frequent MOST_FREQUENT at most."""
    width = (1 << BITS) // buckets

    def count(key, rows):
        lean()
        base = np.uint64(key[0].as_py() * width)
        t = np.concatenate([base + np.cumsum(unplanes(b.as_buffer(), "<u4"), dtype=np.uint64) for b in rows["blob"]])
        t.sort()
        cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        df = np.diff(np.append(cut, len(t)))
        keep = df > FREQUENT
        return pa.table({"token": signed(t[cut][keep]), "df": df[keep]})

    found = blobs.groupBy("bucket").applyInArrow(count, "token bigint, df bigint")
    found = found.orderBy(F.desc("df"), "token").limit(MOST_FREQUENT).toArrow().sort_by("token")
    return found["token"].to_numpy().astype(np.uint64), found["df"].to_numpy()


def choose(n: int, heavy: np.ndarray) -> tuple[int, int]:
    """(level, prefix length) for a set of n shingles, of which the last len(heavy) in the
    global order are frequent, with these document frequencies."""
    need = -(-NUMERATOR * n // DENOMINATOR)
    base, cold = n - need, n - len(heavy)
    cost = np.concatenate([[0], np.cumsum(heavy, dtype=float)])
    best = None
    for level in LEVELS:
        if level > need:
            break
        p = base + level
        matches = RARE_MATCHES * min(p, cold) + cost[max(0, p - cold)]
        total = p + matches + VERIFY_COST * matches / level
        if best is None or total < best[0]:
            best = total, level, p
    return best[1], best[2]


def postings(docs: DataFrame, k: int, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(bucket, salt, blob): each class's prefix, once for each task that reads it."""
    tables = docs.sparkSession.sparkContext.broadcast(hot)
    width = (1 << BITS) // buckets

    def run(batches):
        tokens, dfs = tables.value
        seen: set[int] = set()
        held, ats, count = [], [], 0

        def flush():
            got = np.concatenate(held)
            where = np.concatenate(ats)
            order = np.argsort(where, kind="stable")
            got, where = got[order], where[order]
            cut = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(where))):
                yield int(where[a] >> 32), int(where[a] & 0xFFFFFFFF), got[a:b].tobytes()

        def out():
            rows = list(flush())
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "salt", "blob"])

        for batch in small_batches(batches):
            for s in shingle_sets(batch.column("text").to_pylist(), k):
                if not len(s) or (cid := set_key(s)) in seen:
                    continue
                seen.add(cid)
                t = s >> np.uint64(64 - BITS)
                salt = np.zeros(len(t), dtype=np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, t), len(tokens) - 1)
                    is_hot = tokens[at] == t
                    df = np.where(is_hot, dfs[at], 0)
                    warm = np.flatnonzero(is_hot)
                else:
                    warm = np.empty(0, dtype=np.int64)
                if len(warm):
                    warm = warm[np.lexsort((s[warm], df[warm]))]
                    level, p = choose(len(s), df[warm])
                    t = np.concatenate([t[~is_hot], t[warm]])[:p]
                    df = np.concatenate([np.zeros(len(s) - len(warm), dtype=np.int64), df[warm]])[:p]
                    salt = np.where(df > SALTED, 1 + (cid >> 1) % np.maximum(1, df // SALTED), 0)
                else:
                    level, p = choose(len(s), warm)
                    t, salt = t[:p], salt[:p]
                bucket = (t // np.uint64(width)).astype(np.int64)
                row = np.empty(p, dtype=POSTING)
                row["at"] = (t - bucket.astype(np.uint64) * np.uint64(width)).astype(np.uint32)
                row["cid"] = signed(np.array([cid], dtype=np.uint64))[0]
                row["n"] = len(s)
                row["pos"] = np.arange(p)
                row["level"] = level
                held.append(row)
                ats.append(bucket << 32 | salt)
                count += p
                if count >= HELD // 2:
                    yield out()
                    held, ats, count = [], [], 0
        if count:
            yield out()

    return docs.mapInArrow(run, "bucket int, salt bigint, blob binary")


def prefix(n, level):
    """Length of the prefix with this extension of a set of n elements."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + level


def near_size(n, m):
    """Whether sets of n and m elements can link at all."""
    return DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m)


def leaves_room(n, n_pos, m, m_pos):
    """Whether sets whose first common element has these places can still link."""
    return (NUMERATOR + DENOMINATOR) * np.minimum(n - n_pos, m - m_pos) >= NUMERATOR * (n + m)


MATCHES = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("matches", pa.int64()), ("need", pa.int32()), ("sure", pa.bool_()), ("room", pa.bool_()), ("token", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("level", pa.int32())])


def matches(key, postings):
    """Of the posting lists of one bucket: pairs of short lists with their number of matches and whether
    one of them leaves room, pairs of long lists' members with hubs (sure), and the long lists' postings (y null).
    A part of a salted list is long whatever its length: its members may link with those of other parts."""
    lean()
    bucket, salt = key[0].as_py(), key[1].as_py()
    short = 0 if salt else SHORT
    p = np.concatenate([np.frombuffer(b.as_buffer(), dtype=POSTING) for b in postings["blob"]])
    p = p[np.lexsort((p["cid"], p["n"], p["at"]))]
    fresh = np.append(True, (p["at"][1:] != p["at"][:-1]) | (p["cid"][1:] != p["cid"][:-1]))
    p = p[fresh]
    cut = np.flatnonzero(np.append(True, p["at"][1:] != p["at"][:-1]))
    size = np.diff(np.append(cut, len(p)))
    left, right = [], []
    for m in range(2, short + 1):
        own = cut[size == m]
        if len(own):
            a, b = np.triu_indices(m, 1)
            left.append((own[:, None] + a).ravel())
            right.append((own[:, None] + b).ravel())
    hub_left, hub_right, long, places = [], [], [], []
    for a, m in zip(cut[size > short].tolist(), size[size > short].tolist()):
        ns = p["n"][a : a + m]
        at = 0
        while at < m:  # members are sorted by size; a hub serves those it could link with
            end = int(np.searchsorted(ns, DENOMINATOR * int(ns[at]) // NUMERATOR, side="right"))
            hub_left.append(np.full(end - at - 1, a + at))
            hub_right.append(np.arange(a + at + 1, a + end))
            at = end
        long.append(np.arange(a, a + m))
        places.append(np.arange(m) // BLOCK)
    tables = []

    def pairs(i, j, sure):
        i, j = np.concatenate(i), np.concatenate(j)
        a, b = p[i], p[j]
        need = np.minimum(a["level"], b["level"]).astype(np.int64)
        n, m, n_pos, m_pos = (c.astype(np.int64) for c in (a["n"], b["n"], a["pos"], b["pos"]))
        ok = near_size(n, m)
        if not sure:
            ok &= (n_pos < prefix(n, need)) & (m_pos < prefix(m, need))
        room = leaves_room(n, n_pos, m, m_pos)[ok].astype(np.int8)
        x, y = np.minimum(a["cid"], b["cid"])[ok], np.maximum(a["cid"], b["cid"])[ok]
        met = pa.table({"x": x, "y": y, "need": need[ok].astype(np.int32), "room": room}).group_by(["x", "y", "need"]).aggregate([([], "count_all"), ("room", "max")])
        met = met.rename_columns(["x", "y", "need", "matches", "room"])
        met = met.set_column(4, "room", met["room"].cast(pa.bool_()))
        tables.append(met.append_column("sure", pa.repeat(sure, len(met))))

    if left:
        pairs(left, right, False)
    if hub_left:
        pairs(hub_left, hub_right, True)
    if long:
        own = p[np.concatenate(long)]
        token = (bucket << 32) + own["at"].astype(np.int64)
        tables.append(pa.table({"x": own["cid"].copy(), "token": token, "block": (salt << 32) + np.concatenate(places), "n": own["n"].astype(np.int64), "pos": own["pos"].astype(np.int64), "level": own["level"].astype(np.int32)}))
    return pa.concat_tables([MATCHES.empty_table(), *(t.select([n for n in MATCHES.names if n in t.column_names]) for t in tables)], promote_options="permissive").cast(MATCHES)


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs (x, y) of classes that link. classes: cid, key of one member.

    Each pair belongs to the group of its end with more pairs, split by GROUP;
    a set goes once to each group that has it."""
    spark = docs.sparkSession
    ends = pairs.select("x", "y").union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    degree = ends.groupBy("x").count()
    with_degree = pairs.join(degree.select("x", F.col("count").alias("dx")), "x").join(degree.select(F.col("x").alias("y"), F.col("count").alias("dy")), "y")
    at_x = F.col("dx") >= F.col("dy")
    hub, other = F.when(at_x, F.col("x")).otherwise(F.col("y")), F.when(at_x, F.col("y")).otherwise(F.col("x"))
    salts = F.greatest(F.col("dx"), F.col("dy")) / GROUP
    stars = with_degree.select(hub.alias("hub"), other.alias("cid"), F.pmod(F.xxhash64(other), F.ceil(salts)).alias("salt"))
    members = stars.union(stars.select("hub", F.col("hub").alias("cid"), "salt")).distinct()
    wanted = members.groupBy("cid").agg(F.collect_list(F.struct("hub", "salt")).alias("groups"))
    wanted = store(wanted.join(classes.select("cid", "key"), "cid").select("key", "cid", "groups"), "join-wanted")
    few = 2 * pairs.count() <= BROADCAST_PLACES  # a pair has a place for its hub at most, and one for the other
    texts = docs.join(F.broadcast(wanted) if few else wanted, "key")

    def sets(batches):
        sent = set()
        for batch in small_batches(batches):
            rows, held = [], 0
            for i, (cid, s) in enumerate(zip(batch.column("cid").to_pylist(), shingle_sets(batch.column("text").to_pylist(), k))):
                if cid in sent or int(signed(np.array([set_key(s)], dtype=np.uint64))[0]) != cid:
                    continue  # a copy, or another row with this doc_id
                sent.add(cid)
                blob = s.tobytes()
                for g in batch.column("groups")[i].as_py():
                    rows.append((g["hub"], g["salt"], cid, blob))
                    held += len(blob)
                    if held > SETS:
                        yield grouped(rows)
                        rows, held = [], 0
            if rows:
                yield grouped(rows)

    def grouped(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["hub", "salt", "cid", "blob"])

    def compare(key, rows):
        lean()
        own = {c: np.frombuffer(b.as_buffer(), dtype=np.uint64) for c, b in zip(rows["cid"].to_pylist(), rows["blob"])}
        at = key[0].as_py()
        hub = own.pop(at)
        found = []
        for cid, s in own.items():
            if near_size(len(s), len(hub)):
                both = np.concatenate([s, hub])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                if DENOMINATOR * same >= NUMERATOR * (len(s) + len(hub) - same):
                    found.append(cid)
        found = np.array(found, dtype=np.int64)
        return pa.table({"x": np.minimum(found, at), "y": np.maximum(found, at)})

    moved = texts.select("text", "cid", "groups").mapInArrow(sets, "hub bigint, salt bigint, cid bigint, blob binary")
    return store(moved.groupBy("hub", "salt").applyInArrow(compare, "x bigint, y bigint"), "join-links")


MAP = ["w0", "w1", "w2", "w3"]


def split_lists(long: DataFrame, label: DataFrame) -> DataFrame:
    """The long lists that have members of several components: each member's component as root, whether that is the
    list's largest (in_big), and the number of the list's members (total)."""
    rows = long.join(label.select(F.col("id").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    held = rows.groupBy("token", "block", "root").agg(F.count("*").alias("members"))
    by_root = held.groupBy("token", "root").agg(F.sum("members").alias("members"))
    split = by_root.groupBy("token").agg(F.count("*").alias("roots"), F.sum("members").alias("total"), F.max(F.struct("members", "root")).alias("big")).where("roots > 1")
    # rows meet what is known of their list by block, so that a long list is many tasks' work
    blocks = held.select("token", "block").distinct().join(split.select("token", "total", F.col("big.root").alias("big")), "token")
    return store(rows.join(blocks, ["token", "block"]).withColumn("in_big", F.col("root") == F.col("big")).drop("big"), "join-long")


def near_maps(a: dict, b: dict, left: slice) -> np.ndarray:
    """Bits in which the 256-bit maps of set parities differ: no more than the elements in only one of the sets."""
    bits = np.zeros((len(a["n"][left]), len(b["n"])), dtype=np.int64)
    for c in MAP:
        bits += np.bitwise_count(a[c][left, None] ^ b[c])
    return bits


def arrays(rows: pa.Table) -> dict:
    """The fixed-width columns; the maps as unsigned numbers."""
    out = {c: rows[c].to_numpy() for c in rows.column_names}
    return out | {c: out[c].view(np.uint64) for c in MAP}


def nearest(key, rows):
    """For each member of a block of a list, the member of another component with the nearest parity map, if the two can link."""
    lean()
    own = arrays(rows)
    x, n, root = own["x"], own["n"], own["root"]
    xs, ys = [], []
    for a in range(0, len(x), 256):
        at = slice(a, a + 256)
        bits, total = near_maps(own, own, at), n[at, None] + n
        ok = near_size(n[at, None], n) & (root[at, None] != root) & (bits * (NUMERATOR + DENOMINATOR) <= total * (DENOMINATOR - NUMERATOR))
        share = np.where(ok, bits / total, 2.0)
        best = share.argmin(axis=1)
        hit = share[np.arange(len(best)), best] < 2
        xs.append(x[at][hit])
        ys.append(x[best[hit]])
    p, q = np.concatenate(xs), np.concatenate(ys)
    return pa.table({"x": np.minimum(p, q), "y": np.maximum(p, q)})


def meet_blocks(key, left, right):
    """Pairs of a list's members, left ones outside its largest component, that can link if this is their first long
    list in common, and the matches they need."""
    lean()
    a, b = arrays(left), arrays(right)
    ps, qs = [], []
    for first in range(0, len(a["x"]), 256):
        at = slice(first, first + 256)
        n, m = a["n"][at, None], b["n"]
        ok = near_size(n, m) & leaves_room(n, a["pos"][at, None], m, b["pos"]) & (a["root"][at, None] != b["root"])
        ok &= b["in_big"] | (a["x"][at, None] < b["x"])
        if ok.any():
            # sets that link differ in no more than a seventh of their elements
            ok &= near_maps(a, b, at) * (NUMERATOR + DENOMINATOR) <= (n + m) * (DENOMINATOR - NUMERATOR)
        i, j = np.nonzero(ok)
        ps.append(i + first)
        qs.append(j)
    i, j = np.concatenate(ps), np.concatenate(qs)
    x, y = a["x"][i], b["x"][j]
    return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y), "need": np.minimum(a["level"][i], b["level"][j]).astype(np.int64)})


def across(rows: DataFrame, counted: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs of long lists' members in different components, with enough matches, not yet verified.

    The lists that two members have in common count as matches; a member of more than LISTS counts as having all."""
    lists = rows.groupBy("x").agg(F.count("*").alias("n_lists"), F.when(F.count("*") <= LISTS, F.collect_list("token")).alias("lists"))
    lists = store(lists, "join-lists")
    blocks = rows.groupBy("token", "block").agg(F.count_if(~F.col("in_big")).alias("small"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    before = F.sum("small").over(Window.partitionBy("token").orderBy("block")) - F.col("small")
    blocks = blocks.withColumn("part", F.floor(before / BLOCK))
    small = blocks.where("small > 0")
    parts_of = small.groupBy("token", "part").agg(F.min("lo").alias("p_lo"), F.max("hi").alias("p_hi"), F.max("rest").alias("p_rest"))
    can = F.least("p_hi", "hi") * DENOMINATOR >= F.greatest("p_lo", "lo") * NUMERATOR
    can &= F.least("p_rest", "rest") * (NUMERATOR + DENOMINATOR) >= (F.col("p_lo") + F.col("lo")) * NUMERATOR
    units = parts_of.join(blocks.drop("part", "small"), "token").where(can).select("token", "part", F.col("block").alias("other"))
    own = ["x", "n", "pos", "level", "root", "in_big", *MAP]
    left = rows.where(~F.col("in_big")).join(small.select("token", "block", "part"), ["token", "block"]).join(units, ["token", "part"])
    right = rows.withColumnRenamed("block", "other").join(units, ["token", "other"])
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # attributes of its own
    keys = ["token", "part", "other"]
    met = left.select(*keys, *own).groupBy(*keys).cogroup(right.select(*keys, *own).groupBy(*keys)).applyInArrow(meet_blocks, "x bigint, y bigint, need bigint")
    met = met.groupBy("x", "y").agg(F.max("need").alias("need"))
    for end in ("x", "y"):
        met = met.join(lists.select(F.col("x").alias(end), F.col("lists").alias(f"{end}_lists")), end)
    met = met.withColumn("long", F.size(F.array_intersect("x_lists", "y_lists")))
    known = counted.groupBy("x", "y").agg(F.sum("matches").alias("matches"), F.max("done").alias("done"))
    met = met.join(known, ["x", "y"], "left").where(~F.coalesce("done", F.lit(False)))
    unknown = F.col("x_lists").isNull() | F.col("y_lists").isNull()
    met = met.where(unknown | (F.col("long") + F.coalesce("matches", F.lit(0)) >= F.col("need"))).select("x", "y")
    # pairs whose first match was in a short list may have others in long ones
    late = counted.where("room and not done")
    for end in ("x", "y"):
        at = label.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
        late = late.join(lists.select(F.col("x").alias(end), F.col("n_lists").alias(f"{end}_lists")), end).join(at, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    late = late.where((F.col("x_root") != F.col("y_root")) & (F.col("matches") + F.least("x_lists", "y_lists") >= F.col("need"))).select("x", "y")
    return met.union(late).distinct()


def link(docs: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows, label): doc_id, n, cid of every row; id (a cid), root of every class that links with another."""
    docs = located(docs)
    buckets = n_buckets(docs)
    rows_of, blobs = describe(docs, k, buckets)
    hot = frequent(blobs, buckets)
    classes = rows_of.where("n > 0").groupBy("cid").agg(F.min("key").alias("key"), F.first("bits").alias("bits"))

    columns = ", ".join(f"{f.name} {SQL_NAMES[f.type]}" for f in MATCHES)
    found = store(postings(docs, k, buckets, hot).groupBy("bucket", "salt").applyInArrow(matches, columns), "join-matches")
    long = found.where("y is null").select("token", "block", "x", "n", "pos", "level")
    counted = found.where("y is not null").groupBy("x", "y").agg(F.sum(F.when(F.col("sure"), 0).otherwise(F.col("matches"))).alias("matches"), F.max("need").alias("need"), F.max("sure").alias("sure"), F.max("room").alias("room"))
    counted = store(counted.withColumn("done", F.col("sure") | (F.col("room") & (F.col("matches") >= F.col("need")))).drop("sure"), "join-counted")
    links = verify(docs, classes, counted.where("done").select("x", "y"), k).select(F.col("x").alias("a"), F.col("y").alias("b"))
    label = components(links)
    words = [F.conv(F.hex(F.substring("bits", 1 + 8 * i, 8)), 16, -10).cast("bigint").alias(w) for i, w in enumerate(MAP)]
    mapped = store(long.join(classes.select(F.col("cid").alias("x"), *words), "x"), "join-maps")
    drop(found)
    left_over = None
    while True:  # components grow towards their nearest members before all that is left is compared
        rows = split_lists(mapped, label)
        sides = rows.groupBy("token").agg(F.count_if(~F.col("in_big")).alias("small"), F.count("*").alias("n"))
        work = sides.agg(F.sum(F.col("small").cast("double") * F.col("n"))).first()[0] or 0
        if not work or (left_over is not None and (work < PATIENCE or work > 0.9 * left_over)):
            break
        left_over = work
        mixed = rows.withColumn("block", F.pmod(F.xxhash64("x"), F.ceil(F.col("total") / NEAREST)))
        tried = mixed.groupBy("token", "block").applyInArrow(nearest, "x bigint, y bigint").distinct()
        tried = store(tried.join(counted.where("done"), ["x", "y"], "left_anti"), "join-nearest")
        counted = counted.unionByName(tried.select("x", "y", F.lit(0).alias("matches"), F.lit(0).alias("need"), F.lit(True).alias("room"), F.lit(True).alias("done")))
        links = links.union(verify(docs, classes, tried, k))
        label = components(links)
        drop(rows)
    if work:
        last = store(across(rows, counted, label), "join-across")
        label = components(links.union(verify(docs, classes, last, k)))
    for made in (mapped, rows):
        drop(made)
    return rows_of, label


def join(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs."""
    with scratch(docs.sparkSession):
        return store(_join(docs, k), "join-found", lasting=True)


def _join(docs: DataFrame, k: int) -> DataFrame:
    rows, label = link(docs, k)
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    linked = classes.join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(roots, "root").select("cid", "component")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = K) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, with all their columns.

    doc_id names a document: of rows with equal doc_id and text one stays."""
    found = join(docs, k).select("doc_id", "component_id")
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if distinct_ids(found):
        return pick(docs, found.where(~same), keep=False)
    return pick(docs, found.where(same)).dropDuplicates(["doc_id", "text"])
