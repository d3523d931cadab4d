"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes, at each place of a word, the longest piece
of the vocabulary.  The automaton is a trie of the pieces with failure links:
where a node has no child for the next byte, its link leads to the node for
what is left after popping the longest pieces of its string, and the number of
popped pieces was counted when the link was made.  A word of n bytes takes
O(n) steps, and no piece is built.

Words are runs of non-space characters.  A word is read as the marker byte
followed by its UTF-8 bytes; pieces with the marker start words.  The
vocabulary is that of a byte-level tokenizer file, in which the marker stands
for the space before a word; every single byte is a piece, so any word splits.
A byte-pair vocabulary serves as one of word pieces here: its pieces are taken
greedily, not by merges, and its special tokens are pieces like any other.

Defined results: a null or empty text, or one of white space only, has 0 words
and 0 tokens; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, kept, resolved, small_batches

MARKER = 0x20
#: Distinct words whose counts one Python process keeps; then it starts anew.
CACHE = 400_000


class LongestMatch:
    """pieces: byte strings. Every single byte, and the marker, must be pieces."""

    def __init__(self, pieces: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                if byte not in child[at]:
                    child[at][byte] = len(child)
                    child.append({})
                    final.append(False)
                at = child[at][byte]
            final[at] = True
        # link[v]: where reading goes on after popped[v] pieces came off the string of v; -1: nowhere
        link, popped = [-1] * len(child), [0] * len(child)
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for byte, u in child[v].items():
                if final[u]:
                    link[u], popped[u] = 0, 1
                else:
                    z, n = link[v], popped[v]
                    while z >= 0 and byte not in child[z]:
                        z, n = link[z], n + popped[z]
                    if z >= 0:
                        link[u], popped[u] = child[z][byte], n
                queue.append(u)
        self.child, self.link, self.popped = child, link, popped

    def count(self, word: bytes) -> int:
        """The number of greedy pieces of word; -1 if it can't be split."""
        child, link, popped = self.child, self.link, self.popped
        at = n = 0
        for byte in word:
            while byte not in child[at]:
                n += popped[at]
                at = link[at]
                if at < 0 or (at == 0 and byte not in child[0]):
                    return -1
            at = child[at][byte]
        while at > 0:
            n += popped[at]
            at = link[at]
        return n if at == 0 else -1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def vocabulary(path: str) -> list[bytes]:
    """Pieces that can start a word (after the marker) or go on within one."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    to_byte = byte_alphabet()
    pieces = (bytes(to_byte[c] for c in name) for name in names if all(c in to_byte for c in name))
    return [p for p in pieces if p and MARKER not in p[1:]]


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self.automaton.count(b"\x20" + word.encode("utf-8", "surrogatepass"))
        if len(word) < 200:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, vocab_path: str | Callable[[], str]) -> DataFrame:
    """doc_id, n_words, n_tokens: one row per row of docs. No shuffle.

    Each executor reads the vocabulary from vocab_path, a local file of its
    tokenizer package or a function that finds it there, once per Python process."""

    def run(batches):
        name = f"longest-match {vocab_path}"
        counts = kept(name, lambda: _Counts(LongestMatch(vocabulary(resolved(vocab_path)))), heavy=True)
        for batch in small_batches(batches, heavy=name):
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                found = text.split() if text else []
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
