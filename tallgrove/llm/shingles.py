"""Hashed word shingles of whole texts, in numpy."""
from __future__ import annotations

import numpy as np

#: Odd multipliers of the mixer and of the chain of words.
M1, M2, CHAIN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * M1
        h = (h ^ (h >> np.uint64(27))) * M2
        return h ^ (h >> np.uint64(31))


#: Fixed value: base of the words' hashes, which is odd and so has an inverse modulo 2 ** 64.
BASE = 0xD1342543DE82EF95
#: Bytes whose words are hashed at once, within the processor's cache; a longer word is hashed whole.
BLOCK = 1 << 18
_powers = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """The first n or more powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _powers[i] = np.cumprod(x)
    return _powers


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in order, words of each text); with ``lower`` A-Z count as a-z.

    A word's hash is a polynomial in its bytes, from prefix sums over all bytes at once, then mixed with its length.
    """
    raw = [(t or "").encode() for t in texts]
    x = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if lower:
        x = x + ((x >= 65) & (x <= 90)).view(np.uint8) * np.uint8(32)
    white = (x == 32) | ((x >= 9) & (x <= 13))
    edge = np.flatnonzero(np.diff(white, prepend=True))  # the text ends with white space
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
            own = x[start[i] : end[j - 1]]
            power, inverse = powers(max(BLOCK, len(own)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own + np.uint64(1)) * power[: len(own)])])
            s, e = start[i:j] - start[i], end[i:j] - start[i]
            out[i:j] = mix64(((sums[e] - sums[s]) * inverse[s]) ^ ((e - s).astype(np.uint64) * CHAIN))
            i = j
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
    return out, np.diff(bounds)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted different 63-bit hashes of its shingles.

    A text of fewer than ``words`` words is one shingle of all its words; one without words has none.
    """
    h, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        chain = np.zeros(max(len(h) - words + 1, 0), np.uint64)
        for k in range(words):
            chain = mix64(chain * CHAIN + h[k : len(h) - words + 1 + k]) if len(chain) else chain
    chain >>= np.uint64(1)
    out = []
    for end, n in zip(ends, sizes):
        if n >= words:
            out.append(np.unique(chain[end - n : end - words + 1]).view(np.int64))
        elif n:
            with np.errstate(over="ignore"):
                one = np.array([n], np.uint64)
                for x in h[end - n : end]:
                    one = mix64(one * CHAIN + x)
            out.append((one >> np.uint64(1)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
