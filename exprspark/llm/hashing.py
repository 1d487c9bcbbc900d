"""Vectorised 64-bit hashes of words, word windows and skip-grams.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. The hash of a word is
a polynomial over its bytes modulo 2**64, read off prefix sums, so a megabyte of text costs a few
array passes whatever the number of words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator (a public bit mixer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)[LOWER]
FACTORS = mix(np.arange(1000, 1064, dtype=np.uint64) * BASE) | np.uint64(1)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, dtype=np.uint64), np.full(size, BASE_INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _pieces(texts: list[bytes]):
    """(owners, pieces) of about a megabyte each; a longer text is cut only at white space."""
    owners: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                gaps = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8, min(PIECE, end - at), at)])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    later = [k for k in (text.find(bytes([c]), at + PIECE) for c in np.flatnonzero(SPACE)) if k >= 0]
                    end = min(later) if later else end
            if held and size + end - at > PIECE:
                yield owners, held
                owners, held, size = [], [], 0
            owners.append(i)
            held.append(text[at:end])
            size += end - at
            at = end
    if held:
        yield owners, held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every word in order; owner is the index of its text."""
    owner_parts, hash_parts = [], []
    for owners, pieces in _pieces(texts):
        data = np.frombuffer(b" ".join(pieces), np.uint8)
        begins = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
        edge = np.diff(np.concatenate(([False], ~SPACE[data], [False])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = max(PIECE * 2, 1 << int(len(data)).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(CODES[data] * up[: len(data)], out=sums[1:])
        value = (sums[end] - sums[start]) * down[start]
        hash_parts.append(mix(value + (end - start).astype(np.uint64) * FACTORS[63]))
        owner_parts.append(np.asarray(owners, dtype=np.int64)[np.searchsorted(begins, start, "right") - 1])
    if not owner_parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owner_parts), np.concatenate(hash_parts)


def windows(owner: np.ndarray, words: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the words at position + offsets, wherever all lie in one text. Offsets rise from 0."""
    reach = offsets[-1]
    n = len(words) - reach
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = owner[:n] == owner[reach:]
    value = np.full(n, len(offsets), np.uint64) * FACTORS[62] + np.full(n, reach, np.uint64) * FACTORS[61]
    for k, offset in enumerate(offsets):
        value += words[offset : offset + n] * FACTORS[k]
    return owner[:n][inside], mix(value[inside])


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct window hashes of each text; a shorter text is one sequence, a text without words is empty."""
    owner, words = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))
    holder, value = windows(owner, words, tuple(range(width)))
    held = np.concatenate(([0], np.cumsum(np.bincount(holder, minlength=len(texts)))))
    out = []
    for i, n in enumerate(counts):
        if n >= width:
            out.append(np.unique(value[held[i] : held[i + 1]]))
        elif n:
            own = words[first[i] : first[i + 1]]
            out.append(mix(np.sum(own * FACTORS[10 : 10 + n], keepdims=True) + np.full(1, n, np.uint64) * FACTORS[60]))
        else:
            out.append(np.empty(0, np.uint64))
    return out
