"""Toxicity by weak supervision.

Voters are words of a fixed lexicon, words and word beginnings that are
proposed by labelled documents (inflected forms share a beginning), and fixed
patterns that know nothing of the words.  A row's label is one more voter, of a
stated accuracy.  A generative model of the votes, fitted by expectation
maximisation, estimates how often each voter fires on toxic and on clean
documents, and from the covariance that is left within each class which voters
repeat each other: correlated voters share one voice.  A linear classifier is
trained on the model's posterior labels.

The labelled sample is bounded.  Half of its rows propose voters, and the
generative model sees all of them: a voter that fires by chance in one half is
contradicted by the other.  A voter that does not fire abstains, as a word of
one language says nothing about texts in another.

Defined results: a null text is empty; an empty text gets the score of a
document on which no voter fires; repeated rows are scored each; without
labelled rows, the score is that of the prior; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, small_batches
from .labelled import logistic, predict, sigmoid

#: Labelled rows that are read for training.
SAMPLE = 10_000
VOTERS = 120
#: How often a label is right.
LABELS = 0.98
WORD = re.compile(r"[^\W\d_]+")
# Words that vote whatever the sample says.
LEXICON = (
    "arse ass asshole bastard bitch bullshit clown coward crap creep cretin cunt damn dickhead disgusting dumb dumbass fool fraud fuck fucking garbage "
    "hate hateful hideous idiot idiotic ignorant imbecile jerk kill lame liar loser lunatic maggot moron moronic nasty parasite pathetic pig prick "
    "psycho puke rat retard retarded rubbish scum shit shitty sick slut stupid sucker trash ugly useless vermin vile weak whore worthless wretch"
).split()
# Patterns that vote whatever the words are, each beside a text (in lower case) that all its matches hold.
PATTERNS = {
    "shout": ("!", re.compile(r"\b[A-Z]{3,}!")),
    "exclaim": ("!!", re.compile(r"!{2,}")),
    "masked": ("", re.compile(r"(?<=[A-Za-z])[*#@$%]{2,}(?=[A-Za-z])")),
    "address": ("you", re.compile(r"\byou(?:'re| are) (?:a |an |so |such )", re.I)),
    "threat": (" you", re.compile(r"\b(?:i|we) (?:will|'ll|gonna) \w+ you\b", re.I)),
}


@dataclass
class Model:
    lexicon: list[tuple[str, bool]]  # (letters, whether a whole word)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    accuracies: np.ndarray | None = None
    voices: np.ndarray | None = None


def find_lexicon(texts: list[str], y: np.ndarray, most: int = VOTERS) -> list[tuple[str, bool]]:
    """Words, and beginnings of 4 to 9 letters, that mark toxic documents.

    A beginning that all hits of a longer one share is left out, and words that a chosen beginning covers."""
    bad, good = Counter(), Counter()
    for text, one in zip(texts, y):
        seen = set(WORD.findall(text.lower()))
        found = {(w, True) for w in seen if len(w) >= 3} | {(w[:k], False) for w in seen for k in range(4, min(9, len(w)) + 1)}
        (bad if one else good).update(found)
    nb, ng = max(1, int(sum(y))), max(1, int(len(y) - sum(y)))
    least = max(3, 0.004 * nb)
    odds = {k: math.log((n + 0.5) / nb) - math.log((good[k] + 0.5) / ng) for k, n in bad.items() if n >= least}
    # worth: how much the votes tell about the class
    worth = {k: o * bad[k] for k, o in odds.items() if o > 2.5}
    out: list[tuple[str, bool]] = []
    for key in sorted(worth, key=lambda k: (-worth[k], k)):
        letters, whole = key
        if any(letters.startswith(a) or (not w and a.startswith(letters)) for a, w in out if not (whole is False and w)):
            continue
        out.append(key)
        if len(out) == most:
            break
    return out


class Votes:
    """Counts of lexicon hits in texts."""

    def __init__(self, lexicon: list[tuple[str, bool]]):
        import ahocorasick

        self.n = len(lexicon)
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for k, (letters, _) in enumerate(lexicon):
            by.setdefault(letters, []).append(k)
        for letters, own in by.items():
            self.automaton.add_word(letters, (len(letters), own))
        if lexicon:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> np.ndarray:
        """Hits of each lexicon voter, then of the patterns."""
        out = np.zeros(self.n + len(PATTERNS))
        if not text:
            return out
        low = text.lower()
        if self.n:
            for end, (size, own) in self.automaton.iter(low):
                start = end - size + 1
                if start and low[start - 1].isalpha():
                    continue
                more = end + 1 < len(low) and low[end + 1].isalpha()
                for k in own:
                    if not more or not self.lexicon[k][1]:
                        out[k] += 1
        for k, (needs, pattern) in enumerate(PATTERNS.values()):
            out[self.n + k] = needs in low and pattern.search(text) is not None
        return out


def label_model(votes: np.ndarray, prior: float, neutral: int = 0, labels: np.ndarray | None = None, silence: bool = True, rounds: int = 50):
    """(posterior, rates, voices) of 0/1 votes. The last `neutral` voters are not taken to speak for either class at first.

    rates[c, j]: how often voter j fires in class c.  voices[j]: the share of a
    voice that j has, one over one plus its correlations within the classes.
    labels: 0 or 1 for each row, a voter that is right in the share LABELS of its votes.
    silence: whether a voter that does not fire votes by that, or abstains."""
    n, m = votes.shape
    voices = np.ones(m)
    share = votes.mean(axis=0) if n else np.zeros(m)
    rates = np.stack([np.clip(share * 0.2, 1e-4, 0.5), np.clip(share * 3 + 0.01, 1e-3, 0.9)])
    rates[:, m - neutral :] = np.clip(share[m - neutral :], 1e-4, 1 - 1e-4)
    said = np.zeros(n) if labels is None else (2 * labels - 1) * math.log(LABELS / (1 - LABELS))
    post = np.full(n, prior)
    for turn in range(2):
        for _ in range(rounds):
            ratio = np.log(rates[1] / rates[0]) * voices
            quiet = np.log((1 - rates[1]) / (1 - rates[0])) * voices * silence
            post = sigmoid(votes @ (ratio - quiet) + quiet.sum() + math.log(prior / (1 - prior)) + said)
            w = np.stack([1 - post, post])
            rates = np.clip((w @ votes + np.array([[0.05], [0.5]])) / (w.sum(axis=1, keepdims=True) + 1), 1e-5, 1 - 1e-5)
        if turn == 0 and n > 1:
            rest = votes - (1 - post)[:, None] * rates[0] - post[:, None] * rates[1]
            spread = rest.std(axis=0) + 1e-6
            tie = np.abs((rest / spread).T @ (rest / spread) / n)
            np.fill_diagonal(tie, 0)
            voices = 1 / (1 + np.where(tie > 0.2, tie, 0).sum(axis=1))
    return post, rates, voices


def features(counts: np.ndarray, lexicon: int) -> np.ndarray:
    hits = counts[:, :lexicon]
    total = hits.sum(axis=1, keepdims=True)
    kinds = (hits > 0).sum(axis=1, keepdims=True)
    return np.hstack([np.log1p(hits), counts[:, lexicon:], np.log1p(total), total > 0, np.minimum(kinds, 5)])


def train(texts: list, y: np.ndarray) -> Model:
    texts, y = [t or "" for t in texts], np.asarray(y, dtype=float)
    fixed = [(w, True) for w in LEXICON]
    model = Model(fixed + [v for v in find_lexicon(texts[::2], y[::2]) if v not in fixed])
    vote = Votes(model.lexicon)
    counts = np.array([vote(t) for t in texts]).reshape(len(texts), vote.n + len(PATTERNS))
    prior = float(np.clip(np.mean(y), 0.01, 0.99)) if len(y) else 0.1
    post, model.accuracies, model.voices = label_model((counts > 0).astype(float), prior, len(PATTERNS), y, silence=False)
    model.weights = logistic(features(counts, vote.n), post, 2.0)
    if not len(texts):
        model.weights[-1] = math.log(prior / (1 - prior))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per row of docs. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        vote = Votes(model.lexicon)
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            counts = np.array([vote(t) for t in texts]).reshape(len(texts), vote.n + len(PATTERNS))
            x = features(counts, vote.n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(predict(x, model.weights))], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, score double")
