"""Vectorised word and shingle hashing over UTF-8 bytes (numpy, no Spark).

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z
lowered.  A word's hash is a polynomial over random byte values modulo 2**64,
taken from prefix sums, and then mixed; a shingle's hash mixes its words'.
"""

from __future__ import annotations

import numpy as np

M64 = (1 << 64) - 1
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE = seeded(256, 7)[LOWER]
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[[32, 9, 10, 11, 12, 13]] = True
WEIGHT = seeded(64, 99) | np.uint64(1)
_power: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, kept between calls unless one long text asks for more."""
    if len(_power.get("up", ())) >= n:
        return _power["up"], _power["down"]
    size = max(2 * CHUNK, n)
    found = []
    for b in (BASE, INVERSE):
        out = np.ones(size, dtype=np.uint64)
        done, step = 1, b
        with np.errstate(over="ignore"):
            while done < size:
                k = min(done, size - done)
                out[done : done + k] = out[:k] * np.uint64(step)
                done, step = done + k, step * step & M64
        found.append(out)
    if size == 2 * CHUNK:
        _power["up"], _power["down"] = found
    return found[0], found[1]


def chunks(texts, size: int = CHUNK):
    """Yields (first index, list of byte strings) of about `size` bytes together."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t
        if held and n + len(b) > size:
            yield first, held
            first, held, n = i, [], 0
        held.append(b)
        n += len(b) + 1
    if held:
        yield first, held


def words(parts: list[bytes]):
    """(hashes, starts, ends, bounds): word hashes of the joined parts, byte
    offsets in the joined text, and bounds[i]:bounds[i+1] the words of part i."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    sep = IS_SEP[data]
    edge = np.flatnonzero(np.diff(sep, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(VALUE[data] * up[: len(data)], out=total[1:])
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return h, starts, ends, np.searchsorted(starts, at)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            out += h[j : j + n] * WEIGHT[j]
    return mix(out)


def shingle_sets(texts, k: int = 5):
    """Yields, for each text, the sorted distinct hashes of its k-word shingles.

    Fewer than k words make one shingle of them all; no word makes none."""
    for _, parts in chunks(texts):
        h, _, _, bounds = words(parts)
        s = windows(h, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            else:
                yield windows(h[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64)


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set, from its sorted elements."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        b = np.bitwise_xor.reduce(mix(s * np.uint64(3) + np.uint64(1)))
        return int(mix(np.array([a ^ (b * np.uint64(BASE)) ^ np.uint64(len(s))], dtype=np.uint64))[0])
