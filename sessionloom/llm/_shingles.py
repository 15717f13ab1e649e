"""Word shingles of texts as sets of 64-bit hashes, and MinHash sketches of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from sessionloom.llm._bpe import text_buffers

WORDS = 5
WINDOW = 1 << 20  # bytes hashed at a time
FACTOR = np.uint64(0x100000001B3)
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers() -> np.ndarray:
    return np.power(FACTOR, np.arange(4096, dtype=np.uint64))


def shingles(column, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of every text, sorted within it, joined; offsets of each text).

    Words stand between blanks and control characters up to U+0020.  A text of fewer
    words has one shingle, all of them; one without words has none.
    """
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    solid = np.append(data > 0x20, False)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] |= solid[offsets[:-1][offsets[:-1] < len(data)]]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = _word_hashes(data, solid[:-1], begin)
    at = np.searchsorted(begin, offsets)  # of each text's first word
    count = np.diff(at)
    text = np.repeat(np.arange(n), count)
    rank = np.arange(len(begin)) - at[text]
    out = np.zeros(len(begin), np.uint64)
    for k in range(words):
        more = rank + k < count[text]
        part = np.where(more, np.append(word[k:], np.zeros(min(k, len(word)), np.uint64)), np.uint64(0))
        out = mix(out * FACTOR + part)
    keep = (rank + words <= count[text]) | (rank == 0)
    out, text = out[keep], text[keep]
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[new], text[new]
    return out, np.searchsorted(text, np.arange(n + 1))


def _word_hashes(data: np.ndarray, solid: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of the solid bytes from every word's beginning to the next one's, some bytes at a time."""
    out, ends = np.empty(len(begin), np.uint64), np.append(begin, len(data))
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + WINDOW)))
        a, z = int(ends[i]), int(ends[j])
        step = np.arange(a, z) - np.repeat(begin[i:j], np.diff(ends[i : j + 1]))
        value = np.where(solid[a:z], (data[a:z].astype(np.uint64) + np.uint64(1)) * _powers()[step & 4095], np.uint64(0))
        out[i:j] = mix(np.add.reduceat(value, begin[i:j] - a))
        i = j
    return out


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits (two columns) that equal sets share; zero for empty sets."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        out[full, 0] = mix(np.add.reduceat(mix(hashes), at))
        out[full, 1] = mix(np.add.reduceat(mix(hashes * FACTOR + MIX[0]), at))
    return out


def sketches(hashes: np.ndarray, offsets: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """MinHash values (32 bits, `size` a text) of non-empty sets; zeros for empty ones."""
    out = np.zeros((len(offsets) - 1, size), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        salt = mix(np.arange(size, dtype=np.uint64) + np.uint64(seed << 32))
        for i in range(size):
            # a multiply and a shift of well mixed hashes is random enough, and cheap
            low = np.minimum.reduceat((hashes ^ salt[i]) * (salt[i] | np.uint64(1)), offsets[:-1][full])
            out[full, i] = (low >> np.uint64(32)).astype(np.uint32) ^ (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out
