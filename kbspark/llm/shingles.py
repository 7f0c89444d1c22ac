"""Words and word shingles of whole texts."""

from __future__ import annotations

import numpy as np

WORDS = 5
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WORDS + 1)], np.uint64)
BASE, STEP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: bytes that stand between words: blanks and line ends, 0x09 to 0x0D and 0x20
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words(text: str) -> bytes:
    """A text's bytes with A-Z in lower case; its words are the runs `[^\\x20\\x09-\\x0D]+`."""
    return text.encode("utf-8", "surrogatepass").lower()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    return x ^ (x >> np.uint64(29))


def run_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of bytes; the runs lie side by side, sizes are above 0."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    at = np.cumsum(sizes) - sizes
    powers = np.multiply.accumulate(np.full(int(sizes.max()), BASE, np.uint64))
    place = np.arange(len(letters)) - np.repeat(at, sizes)
    return mix(mix(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * powers[place], at)))


def word_hashes(found: bytes) -> np.ndarray:
    """The hash of each word, in order; nothing is kept between texts."""
    data = np.frombuffer(found, np.uint8)
    inside = ~BLANK[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return run_hashes(data[inside], edges[1::2] - edges[::2])


def shingle_hashes(h: np.ndarray, size: int = WORDS) -> np.ndarray:
    """One 64-bit hash for each run of `size` words; a shorter sequence is one shingle, an empty one none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(min(size, len(h))):
        out += h[k : k + n] * POWERS[k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct five-word shingles of a text."""
    return np.unique(shingle_hashes(word_hashes(words(text))))
