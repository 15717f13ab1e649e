"""Token counts by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a batch lie end to end in one array of symbols.  Every
round finds the lowest merge rank of each pre-token and applies that merge in all
pre-tokens at once, until none has a pair left; the symbols that survive are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.llm import _bpe
from sessionloom.llm._spark import ship, slices

NEVER = np.int64(1) << 40


class RankMerger:
    """Byte-level BPE merges of one vocabulary file, applied to many pre-tokens at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for _, c in sorted(_bpe.byte_chars().items())], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def counts(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; `data` has their bytes end to end, none is empty."""
        out = np.empty(len(length), np.int64)
        which = np.arange(len(length))
        symbol = self.byte_id[data]
        length = length.astype(np.int64)
        rank = np.full(len(symbol), NEVER)
        if len(symbol) > 1:
            rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        rank[np.cumsum(length) - 1] = NEVER
        while len(which):
            lowest = np.minimum.reduceat(rank, np.cumsum(length) - length)
            done = lowest == NEVER
            if done.any():
                out[which[done]] = length[done]
                keep = np.repeat(~done, length)
                symbol, rank = symbol[keep], rank[keep]
                which, length, lowest = which[~done], length[~done], lowest[~done]
                if not len(which):
                    break
            word = np.repeat(np.arange(len(which)), length)
            hit = np.flatnonzero(rank == lowest[word])
            hit = hit[self._every_other(hit)]
            symbol[hit] = self.made[rank[hit]]
            alive = np.ones(len(symbol), bool)
            alive[hit + 1] = False
            rank[hit] = NEVER
            length -= np.bincount(word[hit], minlength=len(which))
            hit = np.cumsum(alive)[hit] - 1
            symbol, rank = symbol[alive], rank[alive]
            last = np.zeros(len(symbol), bool)
            last[np.cumsum(length) - 1] = True
            more = hit[~last[hit]]
            rank[more] = self.ranks(symbol[more], symbol[more + 1])
            before = hit[hit > 0] - 1
            before = before[~last[before]]
            rank[before] = self.ranks(symbol[before], symbol[before + 1])
        return out

    @staticmethod
    def _every_other(hit: np.ndarray) -> np.ndarray:
        """Of pairs that overlap (a symbol repeated), the first, third and so on."""
        order = np.arange(len(hit))
        first = np.ones(len(hit), bool)
        first[1:] = hit[1:] != hit[:-1] + 1
        return (order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0


@lru_cache(2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


class CountCache:
    """Token counts of the pre-tokens met in this Python worker, at most `limit` of them."""

    def __init__(self, path: str, limit: int = 300_000):
        self.path, self.limit, self.known = path, limit, {}
        self.special = _bpe.specials(path)

    def text_counts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, tokens) of every text."""
        parts, first = _bpe.cut_long(column, self.path)
        both = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *map(self._counts, _bpe.some_texts(parts))]
        sums = (np.append(0, np.cumsum(np.concatenate(x))) for x in zip(*both))
        return tuple(np.diff(x[first]) for x in sums)

    def _counts(self, column) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = _bpe.text_buffers(column)
        starts = _bpe.split_words(data, offsets, self.path)
        coded = _bpe.word_array(np.ascontiguousarray(data), starts).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        plain = [w for w in new if w not in self.special]
        if plain:
            length = np.fromiter(map(len, plain), np.int64, len(plain))
            found = merger(self.path).counts(np.frombuffer(b"".join(plain), np.uint8), length)
            self.known.update(zip(plain, found.tolist()))
        self.known.update((w, 1) for w in new if w in self.special)
        size = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = size[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else size
        ends = np.append(0, np.cumsum(size))
        return np.diff(offsets), np.diff(ends[_bpe.words_per_text(starts, offsets)])


@lru_cache(2)
def count_cache(path: str) -> CountCache:
    return CountCache(path)


def count_tokens(
    docs: DataFrame, path: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    No shuffle: each task counts its own rows, in parts of about 2 MB of text.  Null
    and empty texts have 0 bytes and 0 tokens; repeated rows each get their row; a
    null id stays null; other columns are not read; an empty table gives none.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = count_cache(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n_bytes, n_tokens = cache.text_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
