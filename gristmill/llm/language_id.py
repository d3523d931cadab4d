"""Language identification of mixed-language text.

A word's script, by ranges of code points, narrows its candidate languages to
those that use the script; a naive Bayes model over byte trigrams scores the
word for each candidate; Viterbi over the words of a text, with a penalty for
each switch of language, labels its spans.  The prediction is the language
with the most letters, and its share of letters the score.

The model is trained on at most SAMPLE labelled rows for each language: two
tables, 256 kB for each language.  Every value of lang is learned.

Defined results: `und` with score 0 for a null text or one without letters
(str.isalpha), or if no language was learned; ties go to the language first in
the alphabet; repeated rows are labelled each, and trained on once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, kept, small_batches

SAMPLE = 1500
BUCKETS = 1 << 16
SWITCH = 15.0
#: Log-likelihood that a candidate loses if it does not use the word's script.
FOREIGN = 30.0
#: Bytes of text whose words are labelled together.
GROUP = 1 << 21

# Ranges of code points of the scripts told apart (first, last).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "syriac": [(0x700, 0x74F), (0x860, 0x86F)],
    "thaana": [(0x780, 0x7BF)],
    "nko": [(0x7C0, 0x7FF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)],
    "cherokee": [(0x13A0, 0x13FF), (0xAB70, 0xABBF)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
CODES = 0x110000
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: the bit of its script (0: of none), and whether it is a letter; made once for each process."""

    def make():
        script = np.zeros(CODES, dtype=np.uint32)
        for k, ranges in enumerate(SCRIPTS.values()):
            for first, last in ranges:
                script[first : last + 1] = 1 << k
        return script, np.fromiter((chr(c).isalpha() for c in range(CODES)), dtype=bool, count=CODES)

    return kept("code tables", make)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # BUCKETS x languages, float32
    uses: np.ndarray  # scripts x languages: whether the language uses the script


def trigrams(data: np.ndarray):
    """Bucket of the trigram around each byte; data starts and ends with a space."""
    d = FOLD[data].astype(np.uint32)
    key = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    return (key * np.uint32(2654435761)) >> np.uint32(16)


def spread(texts: list[str]):
    """(bytes, codes, starts, ends, bounds): the joined texts in UTF-8 and as code points, words as offsets in
    the codes, and each text's range of words."""
    joined = " ".join(["", *texts, ""])
    points = codes(joined)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    at = np.ones(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    at[1:] += 1
    return np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8), points, starts, ends, np.searchsorted(starts, at)


def train(docs: DataFrame, allowed: Column | None = None, per_language: int = SAMPLE) -> Model:
    """A model from rows of docs (doc_id, text, lang) where allowed holds, lang and text are not null."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if allowed is None else rows.where(allowed)
    # a cut-off on the hash leaves a language little more than it needs, so that no task ranks a whole language
    share = (2.0 * per_language + 64) / F.col("count")
    wanted = rows.groupBy("lang").count().select("lang", share.alias("share"))
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).join(F.broadcast(wanted), "lang")
    few = hashed.where(F.pmod("hash", F.lit(1 << 32)) < F.col("share") * (1 << 32))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    ids = few.select("doc_id", "lang", "hash").distinct().withColumn("n", F.row_number().over(order))
    ids = ids.where(F.col("n") <= per_language).select("doc_id").distinct()
    sample = rows.join(F.broadcast(ids), "doc_id")
    n_scripts = len(SCRIPTS)

    def count(batches):
        script, _ = code_tables()
        for batch in small_batches(batches):
            found: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
                own = found.setdefault(lang, np.zeros(BUCKETS + n_scripts, dtype=np.int64))
                own[:BUCKETS] += np.bincount(trigrams(data)[FOLD[data[1:-1]] != 32], minlength=BUCKETS)
                seen, n = np.unique(script[codes(text)], return_counts=True)
                own[BUCKETS + np.log2(seen[seen > 0]).astype(int)] += n[seen > 0]
            for lang, own in found.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))
    place = {lang: k for k, lang in enumerate(languages)}
    table = np.full((BUCKETS + n_scripts, len(languages)), 0.0)
    table[counts["bucket"].to_numpy(dtype=np.int64), counts["lang"].map(place).to_numpy(dtype=np.int64)] = counts["n"]
    grams, scripts = table[:BUCKETS] + 0.2, table[BUCKETS:]
    logs = np.log(grams / grams.sum(axis=0)) if languages else grams
    logs -= logs.max(axis=1, keepdims=True) if languages else 0
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, logs.astype(np.float32), share >= 0.001)


def penalties(masks: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """What each language loses on words with these sets of scripts: nothing if it uses one of them, or none does."""
    fits = (((masks[:, None] >> np.arange(len(uses), dtype=np.uint32)) & 1) @ uses.astype(np.int64)) > 0
    return np.where(fits | ~fits.any(axis=1, keepdims=True), 0.0, -FOREIGN).astype(np.float32)


def word_scores(texts: list[str], model: Model):
    """(scores, letters, bounds): per word and language, letters per word, each text's range of words."""
    data, points, starts, ends, bounds = spread(texts)
    if not len(starts):
        return np.zeros((0, len(model.languages)), dtype=np.float32), np.zeros(0, dtype=np.int64), bounds
    inside = np.flatnonzero(FOLD[data] != 32)
    edge = np.flatnonzero(np.diff(FOLD[data] == 32, prepend=True))[::2]
    scores = np.add.reduceat(model.logs[trigrams(data)[inside - 1]], np.searchsorted(inside, edge), axis=0)
    script, letter = code_tables()
    edges = np.column_stack([starts, ends]).ravel()
    letters = np.add.reduceat(letter[points].astype(np.int64), edges)[::2]
    masks, which = np.unique(np.bitwise_or.reduceat(script[points], edges)[::2], return_inverse=True)
    scores += penalties(masks, model.uses)[which]
    scores[letters == 0] = 0
    return scores, letters, bounds


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """The label of each word; the texts go in step, the longest first."""
    n, languages = scores.shape
    kind = np.min_scalar_type(max(1, languages))
    labels = np.zeros(n, dtype=kind)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = bounds[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    back = np.empty((n, languages), dtype=kind)
    best = np.zeros((len(sizes), languages), dtype=np.float32)
    own = np.arange(languages, dtype=kind)
    for t in range(steps):
        a = active[t]
        now, at = best[:a], begin[:a] + t
        top = now.max(axis=1, keepdims=True) - switch
        came = now.argmax(axis=1).astype(kind)
        change = top > now
        back[at] = np.where(change, came[:, None], own)
        best[:a] = np.where(change, top, now) + scores[at]
    last = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        labels[at] = last[:a]
        last[:a] = back[at, last[:a]]
    return labels


def _groups(texts: list):
    held, n = [], 0
    for text in texts:
        text = text or ""
        if held and n + len(text) > GROUP:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def label_texts(texts: list, model: Model, switch: float = SWITCH):
    """Yields (prediction, score, word labels) for each text."""
    k = len(model.languages)
    for held in _groups(texts):
        if not k:
            yield from [("und", 0.0, np.zeros(0, dtype=np.uint8))] * len(held)
            continue
        # words are scored in small chunks, labelled all together
        scored, sizes, chunk, n = [], [], [], 0
        for i, text in enumerate(held):
            chunk.append(text)
            n += len(text)
            if n > 1 << 18 or i == len(held) - 1:
                s, letters, bounds = word_scores(chunk, model)
                scored.append((s, letters))
                sizes.append(np.diff(bounds))
                chunk, n = [], 0
        scores = np.concatenate([s for s, _ in scored])
        letters = np.concatenate([x for _, x in scored])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        labels = viterbi(scores, bounds, switch)
        text_no = np.repeat(np.arange(len(held)), np.diff(bounds))
        weight = np.bincount(text_no * k + labels, weights=letters, minlength=len(held) * k).reshape(-1, k)
        total = weight.sum(axis=1)
        top = weight.argmax(axis=1)
        for i in range(len(held)):
            own = labels[bounds[i] : bounds[i + 1]]
            if total[i]:
                yield model.languages[top[i]], float(weight[i, top[i]] / total[i]), own
            else:
                yield "und", 0.0, own


def runs(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, end word, label) of each span."""
    if not len(labels):
        return []
    cut = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *cut.tolist(), len(labels)]
    return [(a, b, int(labels[a])) for a, b in zip(edges, edges[1:])]


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans of words): one row per row of docs. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang_pred string, score double" + ", spans array<struct<first:int,end:int,lang:string>>" * with_spans
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        model = shared.value
        for batch in small_batches(batches):
            got = list(label_texts(batch.column("text").to_pylist(), model))
            arrays = [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            if with_spans:
                arrays.append(pa.array([[{"first": a, "end": b, "lang": model.languages[k]} for a, b, k in runs(g[2])] if model.languages else [] for g in got], span))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "spans"][: 3 + with_spans])

    return id_and_text(docs).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is not `und`, with all their columns. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches):
            got = label_texts(batch.column("text").to_pylist(), shared.value)
            yield batch.filter(pa.array([g[0] != "und" for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
