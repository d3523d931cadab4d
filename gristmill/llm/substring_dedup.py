"""Fuzzy passages that repeat across documents, by collinear chaining.

Seeds are the minimisers of K-word windows: of every W neighbouring windows
the one with the least hash, so an exact run of K + W - 1 words common to two
documents always shares a seed.  Documents with the same words are one class.
Equal seeds meet in one bucket; each occurrence is linked with the seed's
first class and with the class before its own, so a passage in any number of
classes makes links in proportion to its occurrences.  The links of a pair of
classes are chained in order in both, by a tree over the places in the second,
with a cost for gaps; chains are then aligned word by word: seeds are
extended to exact blocks, and what lies between blocks is aligned by edit
distance.  Passages of at least `least` words in both, of which the share
`same` is aligned, are the result.

Different seeds may choose different partners, so a second round works on what
the first left open: text whose seeds other classes share, but that lies in no
passage found.  There all runs of `least` words are linked, each with the first class
that has it whole, and all pairs of shared seeds from NEAR to FAR words apart, each
with the first class that has both.  So every exact run of `least` words that another
class has is found, and a fuzzy passage wherever a pair of its seeds, which may
stand on two sides of an edit, tells its partner from other documents.
A run meets its equals where the least window inside it sends it, so
neighbouring runs travel together, 8 bytes each.

What very many classes share is linked within a task's batch first, and only
its first class travels on, so no bucket holds all occurrences of a common line.

Defined results: null, blank and short texts have no passage; a document with
`least` or more words that has copies repeats as a whole; repeats within one
document alone do not count; repeated rows are copies; a row with a null
doc_id takes part like any other, and as a partner has a null other_id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch, small_batches, store
from .ngram_join import located, n_buckets, signed
from .textkernel import WEIGHT, chunks, mix, windows, words

K, W = 8, 12
LEAST, SAME = 50, 0.8
#: Words beyond a chain's ends that are read for its alignment, and how far its score may drop there.
MARGIN, DROP = 48, 8
#: Bytes of slices, and pairs of them, that a worker holds at once.
SLICES, PAIRS = 1 << 22, 256
#: Words that two neighbouring seeds of a chain may lie apart, and the price of a word of gap.
GAP, PRICE = 64, 0.05
#: Regions of one class that go to it together, and regions that are broadcast (24 bytes each); more are joined by a shuffle.
ASKED, BROADCAST_ASKS = 256, 500_000
#: Classes that are broadcast to be read again, with their shared places (4 bytes each) and covered ranges; more are joined by a shuffle.
BROADCAST_PLACES = 1_000_000
HELD = 1_000_000
#: Occurrences of one seed, pair or run in a batch above which they are linked there.
COMMON = 32
#: Words from one seed to the other of a pair, at least and at most.
NEAR, FAR = 14, 34
#: Classes whose keys are broadcast to pick their texts out before they are shuffled.
BROADCAST_KEYS = 500_000

SEED = np.dtype([("hash", "<u8"), ("cid", "<i8"), ("place", "<u4")])
#: Two seeds of a class, at place and far; open: in no passage found.
PAIR = np.dtype([("hash", "<u8"), ("cid", "<i8"), ("place", "<u4"), ("far", "<u4"), ("open", "u1")])
#: Neighbouring runs of a class that travel together.
PART = np.dtype([("cid", "<i8"), ("place", "<u4"), ("n", "<u4"), ("open", "u1")])
RUN = np.dtype([("hash", "<u8"), ("cid", "<i8"), ("place", "<u4"), ("open", "u1")])
NONE = (0.0, -1)


def word_hashes(texts):
    """Yields the word hashes of each text."""
    for _, parts in chunks(texts):
        h, _, _, bounds = words(parts)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield h[a:b]


def text_key(h: np.ndarray) -> int:
    """A 64-bit hash of a sequence of words."""
    if not len(h):
        return 0
    with np.errstate(over="ignore"):
        place = np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return int(mix(np.array([np.add.reduce(mix(h ^ place))], dtype=np.uint64))[0])


def minimisers(h: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the least k-word window of every w neighbouring ones."""
    g = windows(h, k)
    if not len(g):
        return np.empty(0, dtype=np.int64), g
    if len(g) <= w:
        at = np.array([int(np.argmin(g))])
        return at, g[at]
    # of equal neighbours (a word said over and over) every w-th comes first, so that few are chosen
    new = np.append(True, g[1:] != g[:-1])
    place = np.arange(len(g))
    later = (place - np.maximum.accumulate(np.where(new, place, 0))) % w != 0
    view = np.lib.stride_tricks.sliding_window_view((g & ~np.uint64(1)) | later.astype(np.uint64), w)
    at = np.unique(np.arange(len(view)) + view.argmin(axis=1))
    return at, g[at]


def least_of(g: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    n, size = len(g) - w + 1, 1
    while 2 * size <= w:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[:n], g[w - size : w - size + n])


def long_windows(h: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, least k-word window) of every run of `length` words, length >= k."""
    g = windows(h, k)
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    out = np.full(n, length, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in [*range(0, length - k, k), length - k]:
            out = out * WEIGHT[0] + g[at : at + n]
    return mix(out), least_of(g, length - k + 1)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, key, cid, words."""

    def run(batches):
        for batch in small_batches(batches):
            got = [(signed(np.array([text_key(h)], dtype=np.uint64))[0], len(h)) for h in word_hashes(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32())], ["doc_id", "key", "cid", "words"])

    return docs.mapInArrow(run, "doc_id bigint, key bigint, cid bigint, words int")


#: Links of one pair of classes: how many, the most words of one, and (px, py, words) of each in 12 bytes.
LINK = "x bigint, y bigint, links int, most int, at binary"
#: What a pass over the texts writes, by kind: items that go to buckets (seeds or pairs), runs that do, links made on the spot.
ITEMS, RUNS, LINKS = range(3)
PASS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("hashes", pa.binary()), ("x", pa.int64()), ("y", pa.int64()), ("links", pa.int32()), ("most", pa.int32()), ("at", pa.binary())])


def padded(**columns) -> pa.RecordBatch:
    """A batch of PASS; columns not given are null."""
    n = len(next(iter(columns.values())))
    own = lambda c, kind: c if isinstance(c, pa.Array) else pa.array(c, kind)
    arrays = [own(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in PASS]
    return pa.RecordBatch.from_arrays(arrays, schema=PASS)


def blobs_of(bucket: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    items, bucket = items[order], bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return padded(kind=np.full(len(cut), ITEMS), bucket=bucket[cut], blob=[items[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(items)))])


def links_of(table: pa.Table) -> pa.RecordBatch:
    return padded(kind=np.full(len(table), LINKS), **{c: table[c].combine_chunks() for c in table.column_names})


def combine(p: np.ndarray, with_before: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items that travel on, x, y): items of a batch whose hash is common are linked here, and those of its first class travel on."""
    _, which, times = np.unique(p["hash"], return_inverse=True, return_counts=True)
    common = times[which] > COMMON
    if not common.any():
        return p, p[:0], p[:0]
    own, p = p[common], p[~common]
    return np.concatenate([p, first_class(own)]), *partners(own, with_before)


def write_pass(texts: DataFrame, run, tag: str) -> dict[int, DataFrame]:
    """Writes what run() makes of texts (RecordBatches of PASS), one file for each task, and reads it back by kind:
    kinds have columns of their own, so that each is read alone."""
    found = store(texts.mapInArrow(run, "kind int, bucket int, blob binary, hashes binary, " + LINK), tag)
    columns = {ITEMS: ["bucket", "blob"], RUNS: ["bucket", "blob", "hashes"], LINKS: ["x", "y", "links", "most", "at"]}
    return {kind: found.where(F.col("kind") == kind).select(own) for kind, own in columns.items()}


def cut_items(held: list, shift, with_before: bool, links):
    """The record batches of the items in held; links(x, y): the table of the links made on the spot."""
    p, x, y = combine(np.concatenate(held), with_before)
    if not len(p):
        return
    yield blobs_of((p["hash"] >> shift).astype(np.int64), p)
    if len(x):
        yield links_of(links(x, y))


def seeds(docs: DataFrame, buckets: int, k: int, w: int) -> DataFrame:
    """Links of the seeds of all classes."""
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def run(batches):
        seen: set[int] = set()
        held, count = [], 0
        for batch in small_batches(batches):
            for h in word_hashes(batch.column("text").to_pylist()):
                if len(h) < k or (cid := text_key(h)) in seen:
                    continue
                seen.add(cid)
                at, g = minimisers(h, k, w)
                row = np.empty(len(at), dtype=SEED)
                row["hash"], row["cid"], row["place"] = g, signed(np.array([cid], dtype=np.uint64))[0], at
                held.append(row)
                count += len(row)
                if count >= HELD:
                    yield from cut_items(held, shift, True, lambda x, y: linked(x, y, k))
                    held, count = [], 0
        if count:
            yield from cut_items(held, shift, True, lambda x, y: linked(x, y, k))

    found = write_pass(docs, run, "substring-seeds")
    met = found[ITEMS].groupBy("bucket").applyInArrow(lambda key, blobs: meet(key, blobs, k), LINK)
    return store(met.unionByName(found[LINKS].select(met.columns)), "substring-links")


def covered(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether some range from starts to ends holds all from first to last; first must be ascending."""
    if not len(starts):
        return np.zeros(len(first), dtype=bool)
    order = np.argsort(starts, kind="stable")
    far = np.maximum.accumulate(ends[order])
    at = np.searchsorted(starts[order], first, side="right") - 1
    return (at >= 0) & (far[at] >= last)


def open_runs(h: np.ndarray, at: np.ndarray, shared: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, w: int, length: int):
    """(low, parts without cid, hashes) of the runs of `length` words whose inner seeds (at: places; shared: whether others have them) are all shared."""
    hashes, low = long_windows(h, k, length)
    if not len(hashes):
        return None
    lone = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(lone, at[~shared] + 1, 1)
    lone = np.cumsum(lone)
    i = np.arange(len(hashes))
    # a seed less than w - 1 places from an end of the run may owe its choice to words beyond
    inner = np.minimum(i + w - 1, len(h)), np.minimum(i + length - k - w + 2, len(h))
    keep = (inner[1] <= inner[0]) | (lone[np.maximum(inner[1], inner[0])] - lone[inner[0]] == 0)
    i, hashes, low = i[keep], hashes[keep], low[keep]
    if not len(i):
        return None
    free = ~covered(starts, ends, i, i + length)
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (np.diff(i) != 1) | (free[1:] != free[:-1])))
    p = np.empty(len(first), dtype=PART)
    p["place"], p["n"], p["open"] = i[first], np.diff(np.append(first, len(i))), free[first]
    return low[first], p, hashes


def seed_pairs(at: np.ndarray, g: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """PAIR items, without cid, of the shared seeds g at places at. Of a word or two said over and over, the first seeds count."""
    again = np.zeros(len(g), dtype=bool)
    for d in (1, 2):
        again[d:] |= g[d:] == g[:-d]
    at, g = at[~again], g[~again]
    low, high = np.searchsorted(at, at + NEAR), np.searchsorted(at, at + FAR, side="right")
    n = high - low
    a = np.repeat(np.arange(len(at)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    p = np.empty(len(a), dtype=PAIR)
    with np.errstate(over="ignore"):
        p["hash"] = mix(g[a] * WEIGHT[0] + g[b] * WEIGHT[1])
    p["place"], p["far"] = at[a], at[b]
    p["open"] = ~covered(starts, ends, at[a], at[b] + k)
    return p


def with_texts(docs: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """wanted (key, ...) joined to the texts of its keys; if it is not small enough to be broadcast, its keys may be."""
    if small:
        return docs.join(F.broadcast(wanted), "key")
    keys = wanted.select("key").distinct()
    if keys.count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(keys), "key", "left_semi")
    return docs.join(wanted, "key")


def linked_places(batches):
    """cid, places: the places at which classes have links, once each for what a task reads at a time."""
    lean()
    held, count = [], 0

    def out():
        own = np.unique(np.concatenate(held))
        first = np.flatnonzero(np.append(True, own["cid"][1:] != own["cid"][:-1]))
        blobs = [own["place"][a:b].astype("<i4").tobytes() for a, b in zip(first, np.append(first[1:], len(own)))]
        return pa.RecordBatch.from_arrays([pa.array(own["cid"][first]), pa.array(blobs, pa.binary())], ["cid", "places"])

    for batch in batches:
        at = [np.frombuffer(b.as_buffer(), dtype="<i4").reshape(-1, 3) for b in batch.column("at")]
        if not at:
            continue
        n, at = [len(a) for a in at], np.concatenate(at)
        for c, column in enumerate("xy"):
            own = np.empty(len(at), dtype=[("cid", "<i8"), ("place", "<u4")])
            own["cid"], own["place"] = np.repeat(batch.column(column).to_numpy(), n), at[:, c]
            held.append(np.unique(own))
            count += len(held[-1])
        if count >= HELD:
            yield out()
            held, count = [], 0
    if count:
        yield out()


def second_links(docs: DataFrame, classes: DataFrame, links: DataFrame, found: DataFrame, buckets: int, k: int, w: int, length: int) -> DataFrame:
    """Links of the runs and of the pairs of shared seeds that lie in no passage found."""
    shift = np.uint64(64 - (buckets - 1).bit_length())
    places = links.select("x", "y", "at").mapInArrow(linked_places, "cid bigint, places binary")
    places = places.groupBy("cid").agg(F.collect_list("places").alias("places"))
    ranges = found.groupBy("cid", "start").agg(F.max("end").alias("end")).groupBy("cid").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    wanted = store(places.join(ranges, "cid", "left").join(classes.select("cid", "key"), "cid"), "substring-open")
    size = wanted.agg(F.sum(F.aggregate("places", F.lit(0), lambda n, b: n + F.octet_length(b)) / 4 + 2 * F.coalesce(F.size("starts"), F.lit(0)) + 8)).first()[0] or 0
    texts = with_texts(docs, wanted, size <= BROADCAST_PLACES).select("text", "cid", "places", "starts", "ends")

    def arrays(column, i) -> np.ndarray:
        value = column[i].values
        return np.empty(0, dtype=np.int64) if value is None else value.to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches):
        seen: set[int] = set()
        pairs, parts, count = [], [], 0
        for batch in small_batches(batches):
            cids = batch.column("cid").to_pylist()
            for i, h in enumerate(word_hashes(batch.column("text").to_pylist())):
                cid = text_key(h)
                if cid in seen or int(signed(np.array([cid], dtype=np.uint64))[0]) != cids[i]:
                    continue  # a copy, or another row with this doc_id
                seen.add(cid)
                starts, ends = arrays(batch.column("starts"), i), arrays(batch.column("ends"), i)
                at, g = minimisers(h, k, w)
                shared = np.isin(at, np.frombuffer(b"".join(batch.column("places")[i].as_py()), dtype="<i4"))
                own = seed_pairs(at[shared], g[shared], starts, ends, k)
                own["cid"] = cids[i]
                pairs.append(own)
                count += len(own)
                if (more := open_runs(h, at, shared, starts, ends, k, w, length)) is not None:
                    more[1]["cid"] = cids[i]
                    parts.append(more)
                    count += len(more[2])
                if count >= HELD:
                    yield from out(pairs, parts)
                    pairs, parts, count = [], [], 0
        if count:
            yield from out(pairs, parts)

    def out(pairs, parts):
        yield from cut_items(pairs, shift, False, lambda x, y: linked_pairs(x, y, k))
        if parts:
            yield from cut_runs(parts, shift, length)

    written = write_pass(texts, run, "substring-second")
    by_pairs = written[ITEMS].groupBy("bucket").applyInArrow(lambda key, blobs: meet_pairs(key, blobs, k), LINK)
    by_runs = written[RUNS].groupBy("bucket").applyInArrow(lambda key, blobs: meet_runs(key, blobs, length), LINK)
    return store(by_pairs.unionByName(by_runs).unionByName(written[LINKS].select(by_pairs.columns)), "substring-links")


def cut_runs(parts: list, shift, length: int):
    """The record batches of runs. Parts that are the same in very many classes are linked here, and the first travels on."""
    low, p, hashes = (np.concatenate(c) for c in zip(*parts))
    n = p["n"].astype(np.int64)
    end = np.cumsum(n)
    key = mix(hashes[end - n] ^ mix(hashes[end - 1] ^ n.astype(np.uint64)))
    # least hashes are small: mixed again, they fill the buckets evenly
    bucket = (mix(low) >> shift).astype(np.int64)
    same = np.zeros(len(p), dtype=RUN)
    for c in ("cid", "place", "open"):
        same[c] = p[c]
    same["hash"] = key
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    common = times[which] > COMMON
    stay = ~common
    if common.any():
        own = same[common]
        x, y = partners(own, False)
        free = (x["open"] | y["open"]).astype(bool)
        words_in = dict(zip(key[common].tolist(), n[common].tolist()))
        if free.any():
            lengths = np.array([words_in[k] for k in x["hash"][free].tolist()], dtype=np.int64) + length - 1
            yield links_of(linked(x[free], y[free], lengths))
        ahead = first_class(own)
        stay |= common & np.isin(same[["hash", "cid"]], ahead[["hash", "cid"]])
    begin = end - n
    at = np.flatnonzero(stay)
    at = at[np.argsort(bucket[at], kind="stable")]
    bucket, p, n, begin = bucket[at], p[at], n[at], begin[at]
    if not len(p):
        return
    end = np.cumsum(n)
    hashes = hashes[np.repeat(begin - (end - n), n) + np.arange(end[-1])]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(cut[1:], len(p))
    yield padded(kind=np.full(len(cut), RUNS), bucket=bucket[cut], blob=[p[a:b].tobytes() for a, b in zip(cut, ends)], hashes=[hashes[end[a] - n[a] : end[b - 1]].tobytes() for a, b in zip(cut, ends)])


def _sizes(p: np.ndarray):
    """(per place: places of its seed in its class; sizes, starts of these runs; run of each place)."""
    fresh = np.append(True, (p["hash"][1:] != p["hash"][:-1]) | (p["cid"][1:] != p["cid"][:-1]))
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(p)))
    run = np.cumsum(fresh) - 1
    return sizes[run], sizes, starts, run


def ranked(p: np.ndarray) -> np.ndarray:
    """The items without repeats, by hash, then class: of a hash's classes, those with more of its places come
    first (a run of one word reaches as far as the longest), then by cid."""
    p = p[np.lexsort((p["place"], p["cid"], p["hash"]))]
    p = p[np.append(True, p[1:] != p[:-1])]
    many = _sizes(p)[0]
    return p[np.lexsort((p["place"], p["cid"], -many, p["hash"]))]


def first_class(p: np.ndarray) -> np.ndarray:
    """The items of each hash's first class."""
    p = ranked(p)
    new = np.append(True, p["hash"][1:] != p["hash"][:-1])
    run = _sizes(p)[3]
    return p[run == run[np.flatnonzero(new)[np.cumsum(new) - 1]]]


def partners(p: np.ndarray, with_before: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of occurrences with equal hashes in different classes, x in the class with the greater cid: each occurrence
    has one at least, in the hash's first class or, if it is there, in the second; with_before: and one in the class before its own."""
    p = ranked(p)
    new = np.append(True, p["hash"][1:] != p["hash"][:-1])
    _, sizes, starts, run = _sizes(p)
    first = run[np.flatnonzero(new)[np.cumsum(new) - 1]]  # run of the seed's first class
    own = np.arange(len(p))
    rank = own - starts[run]  # places of a hash that repeats in a class pair up by rank
    to_first = (run != first) & (rank < sizes[first])
    before = run - 1
    to_before = with_before & (run != first) & (before != first) & (rank < sizes[before])
    # only the first class can have places left over: they take the places of the second in turn
    second = np.minimum(first + 1, len(starts) - 1)
    second = np.where(p["hash"][starts[second]] == p["hash"], second, first)
    over = (run == first) & (second != first) & (rank >= sizes[second])
    x = np.concatenate([own[to_first], own[to_before], (starts[second] + rank % sizes[second])[over]])
    y = np.concatenate([(starts[first] + rank)[to_first], (starts[before] + rank)[to_before], own[over]])
    x, y = p[x], p[y]
    swap = x["cid"] < y["cid"]  # a pair of classes is one pair, whichever has more places of a hash
    return np.where(swap, y, x), np.where(swap, x, y)


def linked(x: np.ndarray, y: np.ndarray, n) -> pa.Table:
    """Links by pair of classes; n: words from the places of x and y on that are equal."""
    at = np.empty((len(x), 3), dtype="<i4")
    at[:, 0], at[:, 1], at[:, 2] = x["place"], y["place"], n
    order = np.lexsort((y["cid"], x["cid"]))
    at, cx, cy = at[order], x["cid"][order], y["cid"][order]
    first = np.flatnonzero(np.append(True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]))) if len(x) else np.empty(0, dtype=np.int64)
    links = np.diff(np.append(first, len(x)))
    most = np.maximum.reduceat(at[:, 2], first) if len(x) else at[:, 2]
    blobs = [at[a : a + c].tobytes() for a, c in zip(first.tolist(), links.tolist())]
    columns = (pa.array(cx[first], pa.int64()), pa.array(cy[first], pa.int64()), pa.array(links, pa.int32()), pa.array(most, pa.int32()), pa.array(blobs, pa.binary()))
    return pa.Table.from_arrays(columns, ["x", "y", "links", "most", "at"])


def items_of(blobs, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(b.as_buffer(), dtype=kind) for b in blobs["blob"]])


def meet(key, blobs, k: int):
    """Links of the seeds of one bucket: (x, y, px, py, n)."""
    lean()
    return linked(*partners(items_of(blobs, SEED), True), k)


def linked_pairs(x: np.ndarray, y: np.ndarray, k: int) -> pa.Table:
    """Both seeds of each pair that is open in one class at least, once each."""
    free = (x["open"] | y["open"]).astype(bool)
    x, y = x[free], y[free]
    both = np.empty(2 * len(x), dtype=[("x", "<i8"), ("y", "<i8"), ("px", "<i4"), ("py", "<i4")])
    for part, place in ((both[: len(x)], "place"), (both[len(x) :], "far")):
        part["x"], part["y"], part["px"], part["py"] = x["cid"], y["cid"], x[place], y[place]
    both = np.unique(both)
    ends = [np.empty(len(both), dtype=SEED) for _ in "xy"]
    for end, c in zip(ends, "xy"):
        end["cid"], end["place"] = both[c], both[f"p{c}"]
    return linked(*ends, k)


def meet_pairs(key, blobs, k: int):
    """Links of the pairs of seeds of one bucket."""
    lean()
    return linked_pairs(*partners(items_of(blobs, PAIR), False), k)


def meet_runs(key, blobs, length: int):
    """Links of the exact runs of one bucket: (x, y, px, py, n); runs that continue each other in both are one link."""
    lean()
    parts = items_of(blobs, PART)
    hashes = np.concatenate([np.frombuffer(b.as_buffer(), dtype=np.uint64) for b in blobs["hashes"]])
    n = parts["n"].astype(np.int64)
    order = np.argsort(hashes)
    equal = hashes[order[1:]] == hashes[order[:-1]]
    order = order[np.append(equal, False) | np.append(False, equal)]  # most runs occur once
    part = np.repeat(np.arange(len(parts)), n)[order]
    p = np.empty(len(order), dtype=RUN)
    p["hash"], p["cid"], p["open"], p["place"] = hashes[order], parts["cid"][part], parts["open"][part], parts["place"][part] + order - (np.cumsum(n) - n)[part]
    if not len(p):
        return linked(p, p, length)
    x, y = partners(p, False)
    free = (x["open"] | y["open"]).astype(bool)
    x, y = x[free], y[free]
    if not len(x):
        return linked(x, y, length)
    shift = x["place"].astype(np.int64) - y["place"]
    order = np.lexsort((x["place"], shift, y["cid"], x["cid"]))
    x, y, shift = x[order], y[order], shift[order]
    px = x["place"].astype(np.int64)
    cut = np.append(True, (x["cid"][1:] != x["cid"][:-1]) | (y["cid"][1:] != y["cid"][:-1]) | (np.diff(shift) != 0) | (np.diff(px) > 1))
    begin = np.flatnonzero(cut)
    last = np.append(begin[1:], len(px)) - 1
    return linked(x[begin], y[begin], px[last] - px[begin] + length)


class Ends:
    """Greatest (score, index) over a range of places, of the values put and not yet taken back."""

    def __init__(self, n: int):
        self.n = n
        self.best = [NONE] * (2 * n)
        self.held: list[list] = [[] for _ in range(n)]
        self.gone: set[int] = set()

    def put(self, at: int, value: tuple[float, int]) -> None:
        heappush(self.held[at], (-value[0], -value[1]))
        self._update(at)

    def take(self, at: int, index: int) -> None:
        self.gone.add(index)
        self._update(at)

    def _update(self, at: int) -> None:
        held = self.held[at]
        while held and -held[0][1] in self.gone:
            heappop(held)
        best = self.best
        best[at + self.n] = (-held[0][0], -held[0][1]) if held else NONE
        at = (at + self.n) >> 1
        while at:
            top = max(best[2 * at], best[2 * at + 1])
            if top == best[at]:
                break
            best[at] = top
            at >>= 1

    def between(self, a: int, b: int) -> tuple[float, int]:
        """Over the places from a to b - 1."""
        found, a, b = NONE, a + self.n, b + self.n
        while a < b:
            if a & 1:
                found = max(found, self.best[a])
                a += 1
            if b & 1:
                b -= 1
                found = max(found, self.best[b])
            a, b = a >> 1, b >> 1
        return found


def blocks_of(px: np.ndarray, py: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Links of one diagonal that touch or overlap, as blocks (x, y, length): exact runs."""
    order = np.lexsort((px, px - py))
    px, py, n = px[order], py[order], n[order]
    # places are told apart by diagonal, so that a running maximum of ends starts anew with each
    own = np.cumsum(np.append(False, np.diff(px - py) != 0)) << 40
    end = np.maximum.accumulate(own + px + n)
    first = np.flatnonzero(np.append(True, (own + px)[1:] > end[:-1]))
    last = np.append(first[1:], len(px)) - 1
    got = np.column_stack([px[first], py[first], end[last] - own[last] - px[first]])
    return got[np.lexsort((got[:, 1], got[:, 0]))]


def chains(blocks: np.ndarray) -> list[list[int]]:
    """Chains of blocks in order in both documents; a block is in one chain at most.

    score(i) = length(i) + max(0, score(j) - PRICE * (gap in x + gap in y)) over
    the blocks j that end at most GAP words before i begins, in both; the gap cost
    splits into a part of i and one of j, so the best j is a maximum over a range of
    the ends in y, of the blocks that end in reach in x."""
    n = len(blocks)
    x, y, size = (blocks[:, c].tolist() for c in range(3))
    ends = sorted({y[i] + size[i] for i in range(n)})
    place = {e: r for r, e in enumerate(ends)}
    tree = Ends(len(ends))
    score, before = [0.0] * n, [-1] * n
    by_end = sorted(range(n), key=lambda i: x[i] + size[i])
    done = past = 0
    for i in range(n):
        while done < n and x[by_end[done]] + size[by_end[done]] <= x[i]:
            j = by_end[done]
            tree.put(place[y[j] + size[j]], (score[j] + PRICE * (x[j] + y[j] + 2 * size[j]), j))
            done += 1
        while past < done and x[by_end[past]] + size[by_end[past]] < x[i] - GAP:
            j = by_end[past]
            tree.take(place[y[j] + size[j]], j)
            past += 1
        score[i] = float(size[i])
        top, j = tree.between(bisect_left(ends, y[i] - GAP), bisect_right(ends, y[i]))
        gained = top - PRICE * (x[i] + y[i])
        if j >= 0 and gained > 0:
            score[i] += gained
            before[i] = j
    used, out = set(), []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def candidates(links: DataFrame, k: int, least: int) -> DataFrame:
    """x, y, ax, bx, ay, by: regions of chains that may reach `least` words."""
    groups = links.groupBy("x", "y").agg(F.collect_list("at").alias("at"), F.sum("links").alias("links"), F.max("most").alias("most"))
    groups = groups.where((F.col("links") > 1) | (F.col("most") > k)).select("x", "y", "at")

    def run(batches):
        lean()
        for batch in batches:
            rows = []
            for x, y, at in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "at"))):
                at = np.frombuffer(b"".join(at), dtype="<i4").reshape(-1, 3).astype(np.int64)
                blocks = blocks_of(at[:, 0], at[:, 1], at[:, 2])
                for chain in chains(blocks):
                    a, b = blocks[chain[0]], blocks[chain[-1]]
                    spans = b[0] + b[2] - a[0], b[1] + b[2] - a[1]
                    if min(spans) + 2 * MARGIN >= least and len(chain) + (a[2] > k) > 1:
                        path = blocks[chain].astype("<i4").tobytes()
                        rows.append((x, y, int(a[0]), int(b[0] + b[2]), int(a[1]), int(b[1] + b[2]), path))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["x", "y", "ax", "bx", "ay", "by", "path"])

    return groups.mapInArrow(run, "x bigint, y bigint, ax int, bx int, ay int, by int, path binary")


def gap_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Words that the best alignment of two short gaps pairs (longest common subsequence)."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for word in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == word, row[:-1] + 1, 0)))
    return int(row[-1])


def reach(same: np.ndarray) -> tuple[int, int]:
    """(words, matching ones) that an end grows by: matches count 1, others -3; it stops DROP below the best."""
    if not len(same):
        return 0, 0
    score = np.cumsum(np.where(same, 1, -3))
    low = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    score = score[: low[0]] if len(low) else score
    n = int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0
    return n, int(np.count_nonzero(same[:n]))


def align(path: np.ndarray, a: np.ndarray, b: np.ndarray, fa: int, fb: int) -> tuple[int, int, int, int, int]:
    """(start, end in x, start, end in y, matched words) of a chain; a and b are the
    words of x from fa on and of y from fb on."""
    x, y = path[:, 0] - fa, path[:, 1] - fb
    ex, ey = x + path[:, 2], y + path[:, 2]
    matched = int(path[0, 2])
    # blocks grow towards each other, what is left between them is aligned; the ends grow along their diagonals
    for i in range(1, len(path)):
        n = min(x[i] - ex[i - 1], y[i] - ey[i - 1])
        same = a[ex[i - 1] : ex[i - 1] + n] == b[ey[i - 1] : ey[i - 1] + n]
        right = int(n if same.all() else np.argmin(same))
        ex[i - 1], ey[i - 1] = ex[i - 1] + right, ey[i - 1] + right
        n -= right
        same = (a[x[i] - n : x[i]] == b[y[i] - n : y[i]])[::-1]
        left = int(n if same.all() else np.argmin(same))
        x[i], y[i] = x[i] - left, y[i] - left
        matched += right + left + int(path[i, 2]) + gap_matches(a[ex[i - 1] : x[i]], b[ey[i - 1] : y[i]])
    n = min(x[0], y[0])
    left, more = reach((a[x[0] - n : x[0]] == b[y[0] - n : y[0]])[::-1])
    n = min(len(a) - ex[-1], len(b) - ey[-1])
    right, most = reach(a[ex[-1] : ex[-1] + n] == b[ey[-1] : ey[-1] + n])
    return int(x[0] - left + fa), int(ex[-1] + right + fa), int(y[0] - left + fb), int(ey[-1] + right + fb), matched + more + most


def passages(docs: DataFrame, classes: DataFrame, found: DataFrame, least: int, same: float) -> DataFrame:
    """cid, other, start, end, other_start, other_end, matched: the aligned chains, from both sides."""
    found = store(found.withColumn("no", F.monotonically_increasing_id()), "substring-chains")
    low = lambda c: F.greatest(F.col(c) - MARGIN, F.lit(0))
    asks = found.select(F.col("x").alias("cid"), "no", F.lit(0).alias("side"), low("ax").alias("a"), (F.col("bx") + MARGIN).alias("b"))
    asks = asks.union(found.select(F.col("y").alias("cid"), "no", F.lit(1).alias("side"), low("ay").alias("a"), (F.col("by") + MARGIN).alias("b")))
    # a class that very many pairs ask for is asked in parts
    many = asks.groupBy("cid").count().where(F.col("count") > ASKED)
    asks = asks.join(many, "cid", "left").withColumn("salt", F.pmod("no", F.ceil(F.coalesce("count", F.lit(1)) / ASKED)))
    asks = asks.groupBy("cid", "salt").agg(F.collect_list(F.struct("no", "side", "a", "b")).alias("asks"))
    asks, small = asks.join(classes, "cid").select("key", "cid", "asks"), 2 * found.count() <= BROADCAST_ASKS
    texts = with_texts(docs, asks if small else store(asks, "substring-asks"), small).select("text", "cid", "asks")

    def slices(batches):
        for batch in small_batches(batches):
            rows, held, last, h = [], 0, None, None
            texts = batch.column("text")
            for i, cid in enumerate(batch.column("cid").to_pylist()):
                if cid != last:
                    h, last = next(word_hashes([texts[i].as_py()])), cid
                    mine = int(signed(np.array([text_key(h)], dtype=np.uint64))[0]) == cid
                for q in batch.column("asks")[i].as_py() if mine else ():
                    rows.append((q["no"], q["side"], q["a"], h[q["a"] : q["b"]].tobytes()))
                    held += len(rows[-1][3])
                    if held > SLICES:
                        yield sliced(rows)
                        rows, held = [], 0
            if rows:
                yield sliced(rows)

    def sliced(rows):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["no", "side", "a", "slice"])

    cut = texts.mapInArrow(slices, "no bigint, side int, a int, slice binary").dropDuplicates(["no", "side"])
    left = cut.where("side = 0").select("no", F.col("a").alias("fa"), F.col("slice").alias("left"))
    right = cut.where("side = 1").select("no", F.col("a").alias("fb"), F.col("slice").alias("right"))
    both = found.select("no", "x", "y", "path").join(left, "no").join(right, "no").drop("no")

    def run(batches):
        for batch in batches:
            rows = []
            for r in (r for k in range(0, batch.num_rows, PAIRS) for r in batch.slice(k, PAIRS).to_pylist()):
                a, b = (np.frombuffer(r[c], dtype=np.uint64) for c in ("left", "right"))
                path = np.frombuffer(r["path"], dtype="<i4").reshape(-1, 3).astype(np.int64)
                ax, bx, ay, by, n = align(path, a, b, r["fa"], r["fb"])
                if min(bx - ax, by - ay) >= least and n >= same * max(bx - ax, by - ay):
                    rows.append((r["x"], r["y"], ax, bx, ay, by, n))
                    rows.append((r["y"], r["x"], ay, by, ax, bx, n))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["cid", "other", "start", "end", "other_start", "other_end", "matched"])

    return both.mapInArrow(run, "cid bigint, other bigint, start int, end int, other_start int, other_end int, matched int")


def find_repeats(docs: DataFrame, k: int = K, w: int = W, least: int = LEAST, same: float = SAME) -> DataFrame:
    """doc_id, start, end, other_id, other_start, other_end, matched: for every document
    with a repeated passage, its word ranges, each with one other document that has it."""
    with scratch(docs.sparkSession):
        return store(_repeats(docs, k, w, least, same), "substring-found", lasting=True)


def _repeats(docs: DataFrame, k: int, w: int, least: int, same: float) -> DataFrame:
    docs = located(docs)
    rows = store(describe(docs), "substring-rows").where(F.col("words") >= F.lit(k))
    classes = rows.groupBy("cid").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id"))
    buckets, length = n_buckets(docs), max(k, least)
    links = seeds(docs, buckets, k, w)
    found = store(passages(docs, classes, candidates(links, k, least), least, same), "substring-passages")
    second = second_links(docs, classes, links, found, buckets, k, w, length)
    again = links.join(second.select("x", "y").distinct(), ["x", "y"], "left_semi").unionByName(second)
    found = found.union(passages(docs, classes, candidates(again, k, least), least, same))
    named = classes.select(F.col("cid").alias("other"), F.col("doc_id").alias("other_id"))
    found = found.join(named, "other").groupBy("cid", "start", "end").agg(F.min(F.struct("other_id", "other_start", "other_end", "matched")).alias("o"))
    spans = rows.select("doc_id", "cid").join(found, "cid").select("doc_id", "start", "end", "o.*")
    copies = rows.where(F.col("words") >= least).groupBy("cid").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("n > 1")
    other = F.when(F.col("doc_id") == F.col("least"), F.col("most")).otherwise(F.col("least"))
    whole = rows.join(copies, "cid").select("doc_id", F.lit(0).alias("start"), F.col("words").alias("end"), other.alias("other_id"), F.lit(0).alias("other_start"), F.col("words").alias("other_end"), F.col("words").alias("matched"))
    return spans.unionByName(whole)
