"""Sets of word shingles as sorted arrays of 64-bit hashes, made for whole batches of texts at once.

Words are hashed by a polynomial with an odd base modulo 2**64 (prefix sums, then division by a power of the base) and mixed; a
shingle's hash mixes those of its words in order. Two different shingles of one pair of documents share a hash with a chance of about
n * n / 2**64, which is taken as none."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 21)
        for i, base in enumerate((BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of lower-cased texts, and the number of the text it stands in."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(firsts, starts, side="right") - 1


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of k words; with fewer words, of the whole sequence; without words, none."""
    hashes, of = words([(t or "").encode().lower() for t in texts])
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - k + 1)
        grams = np.zeros(n, np.uint64)
        for i in range(k):
            grams = mix(grams * np.uint64(BASE) + hashes[i : i + n] + np.uint64(i))
        out = []
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo >= k:
                out.append(np.unique(grams[lo : hi - k + 1]))
            elif hi > lo:
                one = np.full(1, hi - lo, np.uint64)
                for h in hashes[lo:hi]:
                    one = mix(one * np.uint64(BASE) + h)
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
