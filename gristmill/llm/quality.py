"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are shares of character kinds,
repeated words and lines, lengths, and those of the line before and after.
Forward-backward gives each line's marginal, and the marginals, weighted by
the lines' lengths, make the document's quality, scaled to a probability.

Labels are given for documents, not for lines.  Training starts from a line
classifier on document labels, then lets bad documents hold good lines: lines
that the current model finds good are relabelled, and the field is fitted to
the lines' labels by gradient steps on its likelihood.  It reads at most
SAMPLE labelled rows.

Defined results: a null text is empty; a text without lines that hold a word
gets the score of the mean training document; repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, small_batches
from .labelled import logistic, predict, sigmoid
from .textkernel import chunks, words

#: Labelled rows that are read for training.
SAMPLE = 4000
STEPS = 100

# Kinds of bytes; a multi-byte letter counts as lower case.
KINDS = np.zeros((5, 256), dtype=np.float32)
KINDS[0, 65:91] = 1  # upper case
KINDS[1, 48:58] = 1  # digits
KINDS[2, [33, 63]] = 1  # ! ?
KINDS[3, [*b"|/\\<>_~^=+-"]] = 1
KINDS[4, [*b"*#$%&@"]] = 1
LOWER = np.zeros(256, dtype=np.float32)
LOWER[97:123] = 1
LOWER[0xC3:0xF5] = 1
NEWLINE = 10
BASIC = 14
FEATURES = 3 * BASIC + 2


@dataclass
class Model:
    weights: np.ndarray  # FEATURES: for bad against good
    switch: np.ndarray  # 2 x 2: scores of label pairs of neighbouring lines
    scale: np.ndarray  # of the document's logistic scale
    empty: float


def line_features(texts: list):
    """(features, lengths, bounds): of each line that has a word, and each text's range of lines."""
    x, sizes, counts = [], [], []
    for _, parts in chunks(texts, 1 << 19):
        h, starts, ends, _ = words(parts)
        data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        breaks = np.flatnonzero(data == NEWLINE)
        line = np.searchsorted(breaks, starts)  # the line of each word
        text_end = np.cumsum([len(p) + 1 for p in parts]) - 1
        own, first = np.unique(line, return_index=True)
        n_words = np.diff(np.append(first, len(h)))
        part = np.searchsorted(text_end, breaks[own])
        counts.append(np.bincount(part, minlength=len(parts)))
        if not len(own):
            continue
        begin = starts[first]
        end = ends[np.append(first[1:], len(h)) - 1]
        size = end - begin
        edges = np.column_stack([begin, end]).ravel()
        safe = np.append(data, 0)
        total = np.empty((len(own), BASIC), dtype=np.float32)
        for k in range(5):
            total[:, k] = np.add.reduceat(KINDS[k][safe], edges)[::2]
        lower = np.add.reduceat(LOWER[safe], edges)[::2]
        letters = total[:, 0] + lower
        total[:, 0] /= np.maximum(letters, 1)
        total[:, 1:5] /= size[:, None]
        same = np.append(False, h[1:] == h[:-1])
        same[first] = False
        total[:, 5] = np.add.reduceat(same.astype(np.float32), first) / n_words
        _, inverse, times = np.unique(h ^ (line.astype(np.uint64) << np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
        total[:, 6] = np.add.reduceat((times[inverse] > 2).astype(np.float32), first) / n_words
        with np.errstate(over="ignore"):
            key = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(first, n_words).astype(np.uint64) + np.uint64(3)), first) + part.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        total[:, 7] = (times[inverse] > 1) * (n_words > 2)
        total[:, 8] = times[inverse] > 3
        total[:, 9] = np.log1p(size) / 6
        total[:, 10] = np.minimum(size / n_words, 15) / 10
        total[:, 11] = n_words <= 2
        total[:, 12] = (safe[end - 1] == 46) | (safe[end - 1] == 33) | (safe[end - 1] == 63)
        total[:, 13] = letters / size
        x.append(total)
        sizes.append(size)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, dtype=np.int64)
    basic = np.concatenate(x) if x else np.zeros((0, BASIC), dtype=np.float32)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
    full = np.zeros((len(basic), FEATURES), dtype=np.float32)
    full[:, :BASIC] = basic
    starts, ends = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0]
    full[1:, BASIC : 2 * BASIC] = basic[:-1]
    full[starts, BASIC : 2 * BASIC] = 0
    full[:-1, 2 * BASIC : 3 * BASIC] = basic[1:]
    full[ends - 1, 2 * BASIC : 3 * BASIC] = 0
    full[starts, -2] = 1
    full[ends - 1, -1] = 1
    return full, sizes, bounds


def marginals(score: np.ndarray, bounds: np.ndarray, switch: np.ndarray, pairs: bool = False):
    """P(bad) of each line, by forward-backward in step over texts (longest first); with
    pairs also the expected counts of neighbouring label pairs."""
    n = len(score)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = bounds[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    node = np.column_stack([np.zeros(n), score])
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(steps):
        at = begin[: active[t]] + t
        if t == 0:
            forward[at] = node[at]
        else:
            last = forward[at - 1]
            forward[at] = node[at] + np.logaddexp(last[:, :1] + switch[0], last[:, 1:] + switch[1])
        forward[at] -= forward[at].max(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        following = backward[at + 1] + node[at + 1]
        backward[at] = np.logaddexp(following[:, :1] + switch[:, 0], following[:, 1:] + switch[:, 1])
        backward[at] -= backward[at].max(axis=1, keepdims=True)
    both = forward + backward
    bad = sigmoid(both[:, 1] - both[:, 0])
    if not pairs:
        return bad
    inner = np.ones(n, dtype=bool)
    inner[bounds[1:][np.diff(bounds) > 0] - 1] = False
    at = np.flatnonzero(inner)
    joint = forward[at][:, :, None] + switch + (node[at + 1] + backward[at + 1])[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return bad, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def aggregate(bad: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(log odds of the length-weighted share of bad, the share) of each text; nan without lines."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    held = np.concatenate([[0], np.cumsum(sizes * bad)])
    with np.errstate(invalid="ignore"):
        share = (held[bounds[1:]] - held[bounds[:-1]]) / (total[bounds[1:]] - total[bounds[:-1]])
    safe = np.clip(share, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(safe) - np.log(1 - safe), share])


def fit(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, weights: np.ndarray, switch: np.ndarray, steps: int):
    """Adam steps on the log likelihood of line labels y."""
    n = max(1, len(x))
    seen = np.zeros((2, 2))
    inner = np.ones(len(x), dtype=bool)
    inner[bounds[1:][np.diff(bounds) > 0] - 1] = False
    at = np.flatnonzero(inner)
    np.add.at(seen, (y[at], y[at + 1]), 1)
    p = np.concatenate([weights, switch.ravel()])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, s = p[: FEATURES + 1], p[FEATURES + 1 :].reshape(2, 2)
        bad, expected = marginals(x @ w[:-1] + w[-1], bounds, s, pairs=True)
        rest = y - bad
        g = np.concatenate([x.T @ rest, [rest.sum()], (seen - expected).ravel()]) / n - 1e-4 * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[: FEATURES + 1], p[FEATURES + 1 :].reshape(2, 2)


def train(texts: list, quality: np.ndarray, steps: int = STEPS) -> Model:
    x, sizes, bounds = line_features(texts)
    x = x.astype(np.float64)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    doc_bad = 1 - np.asarray(quality, dtype=int)
    weights, switch = np.zeros(FEATURES + 1), np.zeros((2, 2))
    empty = float(np.mean(quality)) if len(texts) else 0.5
    if not len(x) or doc_bad.min() == doc_bad.max():
        return Model(weights, switch, np.zeros(3), empty)
    weights = logistic(x, doc_bad[of].astype(float))
    for _ in range(2):
        bad = marginals(x @ weights[:-1] + weights[-1], bounds, switch)
        y = ((bad > 0.5) & (doc_bad[of] == 1)).astype(int)
        weights, switch = fit(x, y, bounds, weights, switch, steps)
    bad = marginals(x @ weights[:-1] + weights[-1], bounds, switch)
    has = np.diff(bounds) > 0
    scale = logistic(aggregate(bad, sizes, bounds)[has], 1 - doc_bad[has].astype(float), 0.1)
    return Model(weights, switch, scale, empty)


def score_texts(texts: list, model: Model) -> np.ndarray:
    x, sizes, bounds = line_features(texts)
    bad = marginals(x @ model.weights[:-1] + model.weights[-1], bounds, model.switch)
    found = aggregate(bad, sizes, bounds)
    has = np.diff(bounds) > 0
    out = np.full(len(texts), model.empty)
    out[has] = predict(found[has], model.scale)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per row of docs. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches):
            found = score_texts(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, score double")


def score_lines(text: str, model: Model) -> list[tuple[str, float]]:
    """(line, P(good)) of the lines of a text that hold a word."""
    x, _, bounds = line_features([text])
    bad = marginals(x @ model.weights[:-1] + model.weights[-1], bounds, model.switch)
    return list(zip([line for line in text.split("\n") if line.strip(" \t\n\v\f\r")], (1 - bad).tolist()))
