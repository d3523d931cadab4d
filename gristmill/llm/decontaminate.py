"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and their white space collapsed.  An item of m
characters is in a document if some passage of it differs by at most k edits.
Such a passage shares at least m + 1 - (k + 1) q of the item's q-grams, and
they all lie on k + 1 neighbouring diagonals.  So shared q-grams are counted
in bands of 2 (k + 1) diagonals that overlap by half; regions that meet the
bound are kept, and a banded alignment of item and region decides.  Items of
fewer than `min_length` characters are too short for edits: they are searched
exactly, between characters that do not continue a word.

The items are the stated query set: they go to all tasks in blocks of at most
BLOCK characters, one pass over the documents for each block.  The q-grams of
a long document are looked up CHUNK characters at a time.

Defined results: null, empty and blank documents and items match nothing; of
overlapping matches of one item the best counts; equal items are items of
their own; positions are characters of the normalised text; a null doc_id is
carried along, and each row is searched, and kept or dropped, for itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, small_batches, store
from .textkernel import seeded

Q = 8
ERRORS = 0.1
MIN_LENGTH = 24
BLOCK = 1 << 20
#: Characters of a document that are looked up together.
CHUNK = 1 << 19
SIEVE = 1 << 21


def plain(text: str | None) -> str:
    """The lower-cased text with single spaces."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


WEIGHTS = (seeded(64, 5) | np.uint64(1)).astype(np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint32)
        for j in range(q):
            out += codes[j : j + n] * WEIGHTS[j]
        out ^= out >> np.uint32(15)
        return out * np.uint32(0x2C1B3C6D)


def budget(m: int, q: int, errors: float) -> int:
    """Edits allowed: the share `errors` of m, or less so that the q-gram bound is above 0."""
    return max(0, min(int(errors * m), (m - q) // q))


@dataclass
class Index:
    q: int
    ids: list
    codes: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray  # shared q-grams that a region must have
    keys: np.ndarray  # the different q-grams, sorted ...
    first: np.ndarray  # ... and where their occurrences start in
    item: np.ndarray  # items
    place: np.ndarray  # and places in them
    sieve: np.ndarray
    short: dict  # items that are searched exactly: text -> ids

    @staticmethod
    def of(rows: list[tuple[int, str]], q: int, errors: float, min_length: int = 0) -> Index:
        short: dict[str, list] = {}
        for i, text in rows:
            if len(text) < max(min_length, q):
                short.setdefault(text, []).append(i)
        rows = [(i, points(text)) for i, text in rows if len(text) >= max(min_length, q)]
        codes = [c for _, c in rows]
        g = [grams(c, q) for c in codes]
        every = np.concatenate(g) if g else np.empty(0, dtype=np.uint32)
        item = np.repeat(np.arange(len(g), dtype=np.int32), [len(x) for x in g])
        place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in g]) if g else np.empty(0, dtype=np.int32)
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        sieve = np.zeros(SIEVE, dtype=bool)
        sieve[keys & np.uint32(SIEVE - 1)] = True
        lengths = np.array([len(c) for c in codes], dtype=np.int64)
        budgets = np.array([budget(m, q, errors) for m in lengths.tolist()], dtype=np.int64)
        return Index(q, [i for i, _ in rows], codes, budgets, lengths + 1 - (budgets + 1) * q, keys, np.append(first, len(every)), item[order], place[order], sieve, short)

    def automaton(self):
        """Of the short items; None without any."""
        if not self.short:
            return None
        import ahocorasick

        found = ahocorasick.Automaton()
        for text in self.short:
            found.add_word(text, text)
        found.make_automaton()
        return found


FAR = np.int32(1 << 29)


def align(item: np.ndarray, text: np.ndarray, low: int, width: int, k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the passage of text nearest to item, if within k edits and on the diagonals
    (place in text less place in item) from low to low + width - 1.

    Edit distance with free ends in text: a row for each character of item, a column for each diagonal."""
    n, steps = len(text), np.arange(width, dtype=np.int32)
    padded = np.full(len(item) + width, 0xFFFFFFFF, dtype=np.uint32)  # text[low:], beyond its ends none
    a, b = max(0, low), min(n, low + len(padded))
    padded[a - low : max(a, b) - low] = text[a : max(a, b)]
    at = low + steps
    cost = np.where((at >= 0) & (at <= n), 0, FAR).astype(np.int32)
    begin = at.copy()
    for i, c in enumerate(item):
        across = cost + (padded[i : i + width] != c)
        down, down_from = np.append(cost[1:] + 1, FAR), np.append(begin[1:], 0)
        step = np.minimum(across, down)
        came = np.where(across <= down, begin, down_from)
        at = low + i + 1 + steps
        step[(at < 0) | (at > n)] = FAR
        # insertions: the least step[j] - j so far, plus j
        least = np.minimum.accumulate(step - steps)
        first = np.maximum.accumulate(np.where(step - steps == least, steps, 0))
        cost, begin = np.where((at < 0) | (at > n), FAR, least + steps), came[first]
        if cost.min() > k:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(begin[end]), low + len(item) + end) if cost[end] <= k else None


def search(text: str, index: Index, automaton=None) -> list[tuple[object, int, int, int]]:
    """(item id, distance, start, end) of the matches in a normalised document."""
    out = []
    if automaton is not None:
        for last, item in automaton.iter(text):
            a, b = last + 1 - len(item), last + 1
            if not (a and item[0].isalnum() and text[a - 1].isalnum()) and not (b < len(text) and item[-1].isalnum() and text[b].isalnum()):
                out += [(i, 0, a, b) for i in index.short[item]]
    if len(text) < index.q or not index.ids:
        return out
    codes = points(text)
    # chunks overlap by the longest passage, so that each has all its q-grams in one of them
    over = max(len(c) + int(k) for c, k in zip(index.codes, index.budgets)) if len(codes) > CHUNK else 0
    found: dict[int, list[tuple[int, int, int]]] = {}
    for at in range(0, len(codes), CHUNK):
        g = grams(codes[at : at + CHUNK + over], index.q)
        hit = np.flatnonzero(index.sieve[g & np.uint32(SIEVE - 1)])
        for i, first in _regions(g[hit], hit + at, index) if len(hit) else ():
            k, item = int(index.budgets[i]), index.codes[i]
            low, width = first - k, 4 * k + 3
            a = max(0, low)
            same = exact(item, codes[a : max(a, low + width + len(item) + k)])
            got = (0, a + same, a + same + len(item)) if same is not None else align(item, codes, low, width, k)
            if got:
                found.setdefault(i, []).append(got)
    for i, own in found.items():
        taken: list[tuple[int, int]] = []
        for d, a, b in sorted(set(own)):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((index.ids[i], d, a, b))
    return out


def _regions(g: np.ndarray, hit: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """(item number, first diagonal) of the bands of 2 (k + 1) diagonals with enough shared q-grams; g: q-grams at the places hit."""
    at = np.minimum(np.searchsorted(index.keys, g), len(index.keys) - 1)
    real = index.keys[at] == g
    at, hit = at[real], hit[real]
    if not len(hit):
        return []
    low = index.first[at]
    count = index.first[at + 1] - low
    own = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    item, place = index.item[own].astype(np.int64), index.place[own].astype(np.int64)
    band = (np.repeat(hit, count) - place) // (index.budgets[item] + 1)
    # a diagonal is in the band that starts at its own multiple of k + 1, and in the one before
    upper = item << 40 | (band + (1 << 30))
    order = np.argsort(upper, kind="stable")
    upper, place = upper[order], place[order]
    every, start, counts = np.unique(upper, return_index=True, return_counts=True)
    stop = start + counts
    follows = np.append(every[1:] == every[:-1] + 1, False)
    joined = counts + np.where(follows, np.append(counts[1:], 0), 0)
    bound = index.bounds[every >> 40]
    # all matches count here, also those of one place: more than the regions that meet the bound stay
    regions = []
    for r in np.flatnonzero(joined >= bound).tolist():
        end = stop[r + 1] if follows[r] else stop[r]
        if len(np.unique(place[start[r] : end])) >= bound[r]:
            regions.append(int(every[r]))
    for r in np.flatnonzero((counts >= bound) & ~np.append(False, follows[:-1])).tolist():  # the band before, where it has no match of its own
        if len(np.unique(place[start[r] : stop[r]])) >= bound[r]:
            regions.append(int(every[r]) - 1)
    return [(r >> 40, ((r & ((1 << 40) - 1)) - (1 << 30)) * (int(index.budgets[r >> 40]) + 1)) for r in regions]


def exact(item: np.ndarray, text: np.ndarray) -> int | None:
    """Where item stands in text."""
    text, small = text.tobytes(), item.tobytes()
    at = text.find(small)
    while at >= 0 and at % 4:
        at = text.find(small, at + 1)
    return at // 4 if at >= 0 else None


def blocks(benchmark: DataFrame):
    held, n = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        text = plain(row["text"])
        if held and n + len(text) > BLOCK:
            yield held
            held, n = [], 0
        if text:
            held.append((row["item_id"], text))
            n += len(text)
    yield held


LEAKS = "doc_id bigint, item_id bigint, distance int, start int, end int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, errors: float = ERRORS, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, item_id, distance, start, end: one row per passage of an item in a document. No shuffle."""
    spark, docs = docs.sparkSession, id_and_text(docs)
    benchmark = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))

    def over(rows):
        shared = spark.sparkContext.broadcast(Index.of(rows, max(q, 1), errors, min_length))

        def run(batches):
            index = shared.value
            automaton = index.automaton()
            for batch in small_batches(batches):
                found = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    found += [(doc_id, *match) for match in search(plain(text), index, automaton)]
                columns = list(zip(*found)) if found else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "distance", "start", "end"])

        return docs.mapInArrow(run, LEAKS), shared

    queries = blocks(benchmark)
    found, shared = over(next(queries))
    for more in queries:  # one block of items at a time reaches the executors
        found = store(found, "leaks", lasting=True)
        shared.destroy()
        rest, shared = over(more)
        found = found.unionByName(rest)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, errors: float = ERRORS, min_length: int = MIN_LENGTH) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns. No shuffle.

    Items of fewer than `min_length` characters do not condemn a document: a word or two is no leak."""

    def without(docs, rows):
        shared = docs.sparkSession.sparkContext.broadcast(Index.of(rows, max(q, 1), errors))

        def run(batches):
            for batch in small_batches(batches):
                yield batch.filter(pa.array([not search(plain(text), shared.value) for text in batch.column("text").to_pylist()], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    long = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = ([r for r in rows if len(r[1]) >= max(min_length, q)] for rows in blocks(long))
    return reduce(without, parts, docs)
