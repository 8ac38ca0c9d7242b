"""Vectorised hashing of byte texts: prefix polynomials over a run of bytes, from which any span's hash follows."""

from __future__ import annotations

import numpy as np

#: An odd factor has an inverse modulo 2**64, so a span's hash is (P[e] - P[s]) * B**-s.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
CHUNK = 1 << 18


def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64)


VALUES = _values(1)
_POWERS: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    have = _POWERS.get("n", 0)
    if have < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        if size > 64 * CHUNK:  # a very long text's table isn't kept
            return up[:n], down[:n]
        _POWERS.update(n=size, up=up, down=down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """P with P[i] = sum of values[data[j]] * BASE**j over j < i; one longer than data."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(values[data] * powers(len(data))[0], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (public-domain splitmix64 finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: list[bytes], limit: int = CHUNK):
    """(first, texts) in runs of at most `limit` bytes, or one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and the number of words before each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    s, e = edge[::2], edge[1::2]
    p = prefix(data)
    h = mix((p[e] - p[s]) * powers(len(data) + 1)[1][s])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.concatenate(([0], np.searchsorted(s, ends)))


def shingles(texts: list[bytes], n: int = 3) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingle hashes; fewer words: the whole sequence as one; none: empty."""
    h, at = word_hashes(texts)
    h = np.concatenate((h, np.zeros(n, np.uint64)))
    total = np.zeros(len(h) - n, np.uint64)
    for k in range(n):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)] + np.uint64(k + 1))
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= n:
            out.append(np.unique(total[lo : hi - n + 1]))
        elif hi > lo:
            one = np.zeros(1, np.uint64)
            for k, x in enumerate(h[lo:hi]):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(1000 * (hi - lo) + k))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
