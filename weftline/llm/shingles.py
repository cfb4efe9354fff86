"""Vectorised hashing of word shingles and fast similarity sketches (NumPy, used inside Spark tasks).

Words are runs of bytes other than space and the bytes 9-13 of the UTF-8 text. A word's
hash joins two polynomials in its bytes, modulo two primes and at two random points, so
that two words of n bytes agree with a probability of at most (n / 2**30)**2, whatever
they look like. All words of a text are hashed at once: no Python code runs per word. A
shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: (prime modulus, point) of the two polynomials.
_FIELDS = ((2**31 - 1, 1_350_274_199), (2**31 - 19, 982_451_653))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word whose products with powers add up without overflow.
_SAFE = 1 << 24


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a point modulo a prime, grown as longer words come."""

    def __init__(self, prime: int, point: int) -> None:
        self.prime, self.point = prime, point
        self.known = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.point, len(self.known), self.prime))
            self.known = np.concatenate((self.known, self.known * step % np.uint64(self.prime)))
        return self.known


_POWERS = [_Powers(*field) for field in _FIELDS]


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    sizes = end - start
    first = np.cumsum(sizes) - sizes
    value = (_LOWER[raw] if lower else raw)[~space].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(value)) - np.repeat(first, sizes)
    out = sizes.astype(np.uint64)
    for powers in _POWERS:
        prime = np.uint64(powers.prime)
        parts = value * powers.upto(int(sizes.max()))[place]
        if sizes.max() > _SAFE:
            parts %= prime
        out = mix(out) + np.add.reduceat(parts, first) % prime
    return mix(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles.

    A text with fewer words than ``width`` has its whole word sequence as its one
    shingle; null and wordless texts have none.
    """
    words = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(words):
        return words
    span = min(width, len(words))
    out = np.zeros(len(words) - span + 1, dtype=np.uint64)
    for k in range(span):
        out = mix(out * _BASE + words[k : len(words) - span + 1 + k])
    return np.unique(out + np.uint64(span))


def sketches(sets: list[np.ndarray], size: int, seed: int = 1) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: one row of ``size`` values each.

    In round i every element of a set falls by a fresh hash into a bin and offers
    the value (i, hash); a bin keeps its least value, so bins filled in an earlier
    round never change. Rounds stop once all bins are full. From round ``size`` on
    every element goes to bin i - size, which fills every bin after 2 * size rounds
    at the latest. Two sets agree in a bin with the probability of their Jaccard
    similarity, concentrated about as well as with independent permutations.
    """
    n = len(sets)
    full = np.uint64(2**64 - 1)
    out = np.full(n * size, full, dtype=np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if n else np.empty(0, dtype=np.uint64)
    live = np.arange(n)
    for i in range(2 * size):
        if not len(live):
            break
        h = mix(items + np.uint64((seed * 2 * size + i + 1) * 0x632BE59BD9B4E019 % 2**64))
        place = h % np.uint64(size) if i < size else np.full(len(h), i - size, dtype=np.uint64)
        value = (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10))
        np.minimum.at(out, owner * size + place.astype(np.int64), value)
        short = (out.reshape(n, size) == full).any(axis=1)
        if not short[live].all():
            live = np.flatnonzero(short)
            keep = short[owner]
            owner, items = owner[keep], items[keep]
    return out.reshape(n, size)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` neighbouring coordinates; the band's number is mixed in."""
    n, size = sketch.shape
    bands = size // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)) * _BASE
    parts = sketch[:, : bands * rows].reshape(n, bands, rows)
    for k in range(rows):
        key = mix(key * _BASE + parts[:, :, k])
    return key.view(np.int64)
