"""Byte-level BPE on Arrow buffers: word splitting, an encode cache and ragged helpers.

Splitting is vectorised over the UTF-8 bytes of a whole batch of texts: every
byte belongs to exactly one word, and words never cross a text or a special
token.  A batch is then dictionary-encoded, so only its distinct words reach
Python.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, BLANK, SPACE = 0, 1, 2, 3, 4

# White space of the Unicode property White_Space.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


@lru_cache(2)
def char_classes(path: str) -> np.ndarray:
    """The class of every code point: by Python's Unicode tables; where those have no
    entry but `regex` has a letter or number, as the tokenizer's own splitter takes it."""
    import regex

    kind = {"L": LETTER, "N": NUMBER, "C": 9}
    out = np.fromiter(
        (kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    control = np.flatnonzero(out == 9)
    out[control] = OTHER
    control = control[(control < 0xD800) | (control > 0xDFFF)]
    newer = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, control)))]
    split = load_tokenizer(path).pre_tokenizer.pre_tokenize_str
    for first, group in (("a", LETTER), ("1", NUMBER)):
        ends = {span[1] for _, span in split("".join(f"\n{first}{chr(c)}\n" for c in newer))}
        out[[c for i, c in enumerate(newer) if 4 * i + 2 not in ends]] = group
    out[list(WHITE_SPACE)] = BLANK
    out[0x20] = SPACE
    return out


@lru_cache(4)
def load_tokenizer(path: str):
    """The tokenizers library's object for a vocabulary file; truncation and padding off."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(4)
def specials(path: str) -> dict[bytes, int]:
    """Added tokens (text -> id); only plain ones, without stripping, are supported."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    for t in added:
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
            raise ValueError(f"unsupported added token {t}")
    return {t["content"].encode(): t["id"] for t in added}


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _find(data: bytes, needle: bytes) -> list[int]:
    out, at = [], data.find(needle)
    while at >= 0:
        out.append(at)
        at = data.find(needle, at + len(needle))
    return out


def _special_spans(data: np.ndarray, offsets: np.ndarray, tokens: tuple[bytes, ...]) -> list[tuple[int, int]]:
    raw = data.tobytes() if tokens else b""
    found = sorted((at, -len(t)) for t in tokens for at in _find(raw, t))
    spans, end = [], 0
    for at, size in found:
        inside = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at - size, "left")
        if at >= end and inside:
            spans.append((at, at - size))
            end = at - size
    return spans


def _chars(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Byte positions of the characters (None: every byte is one) and their classes."""
    if not (data & 0x80).any():
        return None, table[:128][data]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    out = table[:128][lead & 0x7F]
    for low, high, n, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        which = np.flatnonzero((lead >= low) & (lead < high))
        if len(which):
            point = (lead[which] & mask).astype(np.uint32)
            for k in range(1, n):
                point = (point << 6) | (data[at[which] + k] & 0x3F)
            out[which] = table[point]
    return at, out


def split_words(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Byte offsets at which words begin, in ascending order.

    The rule: an apostrophe with s, t, re, ve, m, ll or d; else a run of letters,
    of numbers or of other characters with one space before it; else white space,
    whose last character is left to what follows.
    """
    size = len(data)
    if size == 0:
        return np.zeros(0, np.int64)
    at, c = _chars(data, char_classes(path))
    n = len(c)
    index = (lambda x: x) if at is None else (lambda x: np.searchsorted(at, x))
    head = np.zeros(n + 1, bool)  # of a text or what stands between special tokens
    head[index(offsets[:-1])] = True
    spans = _special_spans(data, offsets, tuple(specials(path)))
    for a, b in spans:
        head[index(a)] = head[index(b)] = True
    head[0], head = True, head[:n]
    blank = c >= BLANK
    kind = np.where(blank, np.uint8(BLANK), c)
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start & ~blank & ~head)
    after = after[blank[after - 1]]
    start[after - 1] = True
    start[after[c[after - 1] == SPACE]] = False
    _contractions(data, at, kind, head, start)
    for a, b in spans:
        start[index(a) + 1 : index(b)] = False
    found = np.flatnonzero(start)
    return found if at is None else at[found]


def _contractions(data, at, kind, head, start) -> None:
    n = len(kind)
    lead = data if at is None else data[at]
    quote = np.flatnonzero((lead == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~head[quote + 1] & (kind[quote + 1] == LETTER)]
    if not len(quote):
        return
    first = lead[quote + 1]
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    two = np.minimum(quote + 2, n - 1)
    pair = (first.astype(np.uint16) << 8) | lead[two]
    wanted = np.array([(a << 8) | b for a, b in (b"re", b"ve", b"ll")], np.uint16)
    both = ~one & (quote + 2 < n) & ~head[two] & np.isin(pair, wanted)
    start[quote[one | both] + 1] = False
    for which, skip in ((quote[one], 2), (quote[both], 3)):
        rest = which[which + skip < n] + skip
        start[rest[~head[rest] & (kind[rest] == LETTER)]] = True


def word_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words as an Arrow binary array over the same bytes."""
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def words_per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, the index of its first word; with the total at the end."""
    return np.searchsorted(starts, offsets, "left")


def ragged_take(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[begin[i]:begin[i] + length[i]] for every i, joined."""
    total = int(length.sum())
    if total == 0:
        return values[:0]
    before = np.cumsum(length) - length
    where = np.repeat(begin - before, length)
    where += np.arange(total)
    return values[where]


def distinct_words(column, path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word in them, first word of each text) of a string column."""
    data, offsets = text_buffers(column)
    starts = split_words(data, offsets, path)
    coded = word_array(np.ascontiguousarray(data), starts).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), words_per_text(starts, offsets)


def cut_long(column, path: str, most: int = 2 << 20) -> tuple[pa.Array, np.ndarray]:
    """(texts, those above twice `most` bytes in parts cut where words end; the first part of each text).

    A cut is made before a single space between two ASCII letters, which starts a word whatever
    surrounds it.  Without such places, or with special tokens that hold a space, a text stays whole.
    """
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    long = np.flatnonzero(np.diff(offsets) > 2 * most)
    cuts = [offsets[:-1]]
    for i in long.tolist() if not any(b" " in t for t in specials(path)) else ():
        at, end = int(offsets[i]) + most, int(offsets[i + 1])
        while at < end - most:
            part = data[at - 1 : min(at + most, end)]
            letter = ((part | 0x20) >= 0x61) & ((part | 0x20) <= 0x7A)
            found = np.flatnonzero((part[1:-1] == 0x20) & letter[:-2] & letter[2:])
            if len(found):
                at += int(found[0])
                cuts.append(np.array([at]))
            at += most
    begin = np.sort(np.concatenate(cuts), kind="stable")
    ends = np.append(begin, len(data)).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    first = np.append(np.searchsorted(begin, offsets[:-1]), len(begin)) if len(begin) > n else np.arange(n + 1)
    return parts, first


def some_texts(parts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """Neighbouring texts of about `most` bytes together."""
    ends = np.frombuffer(parts.buffers()[1], np.int64) if len(parts) else np.zeros(1, np.int64)
    begin = 0
    while begin < len(parts):
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, "right")) - 1)
        yield parts.slice(begin, stop - begin)
        begin = stop


def encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words joined, number of ids of each word), by the tokenizers library."""
    known = specials(path)
    model = load_tokenizer(path).model
    table = byte_chars()
    ids: list[int] = []
    sizes = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        if w in known:
            got = [known[w]]
        else:
            got = [t.id for t in model.tokenize(w.decode("latin-1").translate(table))]
        ids += got
        sizes[i] = len(got)
    return np.array(ids, np.uint32), sizes


@lru_cache(1)
def byte_chars() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordCache:
    """Ids of the words met so far in this Python worker, at most `limit` words."""

    def __init__(self, path: str, limit: int = 300_000):
        self.path, self.limit = path, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _add(self, words: list[bytes]) -> None:
        ids, size = encode_words(words, self.path)
        if len(ids) and ids.max() > 0xFFFF and self.ids.dtype == np.uint16:
            self.ids = self.ids.astype(np.uint32)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, ids.astype(self.ids.dtype))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, offsets of each text in them) of a string column."""
        parts, first = cut_long(column, self.path)
        if len(parts) == len(first) - 1:
            return self._encode(parts)
        ids, size = [], [np.zeros(0, np.int64)]
        for some in some_texts(parts):
            got, ends = self._encode(some)
            ids.append(got)
            size.append(np.diff(ends))
        ends = np.append(0, np.cumsum(np.concatenate(size)))
        return np.concatenate(ids), ends[first]

    def _encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        words, index, first = distinct_words(column, self.path)
        words = words.to_pylist()
        if len(self.index) + len(words) > self.limit:
            self.clear()
        new = [w for w in words if w not in self.index]
        if new:
            self._add(new)
        place = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[index]
        size = self.size[place]
        ends = np.append(0, np.cumsum(size))
        return ragged_take(self.ids, self.begin[place], size), ends[first]


@lru_cache(2)
def word_cache(path: str) -> WordCache:
    return WordCache(path)
