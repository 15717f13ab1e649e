"""BPE encoding and decoding through a table of distinct words.

1.  Whole documents are gathered into chunks of about `CHUNK_BYTES` of text; a
    chunk's key is a hash of its texts, and its place.
2.  Each chunk gives its distinct words, in lists by hash bucket.  A bucket's lists
    meet in one task, which encodes each distinct word of the corpus once and sends
    every list's ids back to its chunk.
3.  Chunks meet their ids by key; ids are laid out by position.
4.  Decoding joins ids with the pieces of the vocabulary (a fixed table) and joins
    the pieces' bytes.

A word comes once from a chunk at most, so no bucket grows with a hot word; there is a
bucket for every BUCKET_BYTES of the table, and its lists are read one after another.
Lists and texts travel compressed, as the texts would else be the largest part of the
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.llm import _bpe
from sessionloom.llm._chunks import buckets_for, keyed, packed, squeeze, unpacked, unsqueeze
from sessionloom.llm._spark import schema_plus, ship, slices

CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 1 << 30


def _bounds(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first, length) of the words."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)


def _bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A hash bucket of each word (no word is empty)."""
    data, first, length = _bounds(words)
    if not len(first):
        return first
    low = int(first[0])
    place = np.arange(int(length.sum())) - np.repeat(first - low, length)
    power = np.power(np.uint64(0x100000001B3), np.arange(256, dtype=np.uint64))
    value = (data[low : low + len(place)] + np.uint64(1)) * power[place & 255]
    mixed = np.add.reduceat(value, first - low) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _words(path: str, size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in keyed(batches, size):
            words, _, _ = _bpe.distinct_words(table["text"], path)
            data, first, length = _bounds(words)
            bucket = _bucket_of(words, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[b] : cuts[b + 1]]
                spread = _bpe.ragged_take(data, first[mine], length[mine])
                rows.append({"bucket": b, "chunk": key, "words": squeeze(length[mine].astype("<u4"), spread)})
            kinds = pa.schema([("bucket", pa.int32()), ("chunk", pa.binary()), ("words", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def _encode_bucket(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}  # the bucket's words, each encoded once
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                length, letters = unsqueeze(row["words"], "<u4", "u1")
                whole, ends = letters.tobytes(), np.cumsum(length).tolist()
                words = [whole[a:b] for a, b in zip([0, *ends], ends)]
                fresh = [w for w in words if w not in known]
                ids, sizes = _bpe.encode_words(fresh, path)
                joined, stops = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
                known.update(zip(fresh, (joined[a:b] for a, b in zip([0, *stops], stops))))
                got = [known[w] for w in words]
                size = np.fromiter(map(len, got), np.int64, len(got)) // 4
                every = np.frombuffer(b"".join(got), "<u4")
                narrow = not len(every) or every.max() <= 0xFFFF
                ids_kind = "<u2" if narrow else "<u4"
                data = squeeze(np.array([2 if narrow else 4], "u1"), size.astype("<u4"), every.astype(ids_kind))
                out.append({"chunk": row["chunk"], "bucket": row["bucket"], "ids": data})
            kinds = pa.schema([("chunk", pa.binary()), ("bucket", pa.int32()), ("ids", pa.binary())])
            yield pa.RecordBatch.from_pylist(out, kinds)

    return run


def _lay_out(path: str, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        lists = dict(zip(left["bucket"].to_pylist(), left["ids"].to_pylist()))
        for table in map(unpacked, right["packed"]):
            words, index, first = _bpe.distinct_words(table["text"], path)
            values, begin, size = _word_ids(lists, words, path, buckets)
            spread = _bpe.ragged_take(values, begin[index], size[index])
            ends = np.append(0, np.cumsum(size[index]))[first]
            data = pa.py_buffer(np.ascontiguousarray(spread, "<u4"))
            ids = pa.Array.from_buffers(pa.large_binary(), table.num_rows, [None, pa.py_buffer(ends * 4), data])
            out.append(
                pa.table(
                    [table["doc_id"], pa.array(np.diff(ends)), ids.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"]
                )
            )
        kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        return pa.concat_tables(out) if out else kinds.empty_table()

    return run


def _word_ids(lists: dict[int, bytes], words: pa.Array, path: str, buckets: int):
    """(all ids joined, first, number) of each word.  Words without a list, as when a
    repeated task cut its chunks elsewhere, are encoded here."""
    bucket = _bucket_of(words, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    size, parts, lost = np.zeros(len(words), np.int64), [], []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        mine = order[cuts[b] : cuts[b + 1]]
        if b in lists:
            width = unsqueeze(lists[b], "u1")[0][0]
            _, each, ids = unsqueeze(lists[b], "u1", "<u4", f"<u{width}")
            size[mine] = each
            parts.append(ids.astype("<u4"))
        else:
            lost.append(mine)
    placed = order
    if lost:
        rest = np.concatenate(lost)
        placed = order[~np.isin(order, rest)]
        more, each = _bpe.encode_words(words.take(pa.array(rest)).to_pylist(), path)
        size[rest] = each
        parts.append(more.astype("<u4"))
        placed = np.append(placed, rest)
    begin = np.zeros(len(words), np.int64)
    begin[placed] = np.cumsum(size[placed]) - size[placed]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4"), begin, size


def encode_documents(
    docs: DataFrame, path: str, *, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens and ids (little-endian unsigned 32-bit).

    Special strings inside texts become their ids, as the library does by default.
    Null and empty texts have no ids; repeated rows, ids in common and null ids keep
    their rows; other columns are not read; an empty table gives none.  A text longer
    than a chunk is a chunk of its own.
    """
    ship(docs.sparkSession)
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    buckets = buckets_for(read, BUCKET_BYTES)
    words = read.mapInArrow(_words(path, chunk_bytes, buckets), "bucket int, chunk binary, words binary")
    ids = words.groupBy("bucket").applyInArrow(_encode_bucket(path), "chunk binary, bucket int, ids binary")
    texts = read.mapInArrow(packed(chunk_bytes), "chunk binary, packed binary")
    return (
        ids.groupBy("chunk")
        .cogroup(texts.groupBy("chunk"))
        .applyInArrow(_lay_out(path, buckets), "doc_id long, n_tokens long, ids binary")
    )


@lru_cache(2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary's bytes joined, and the first and the number of each id's."""
    tok = _bpe.load_tokenizer(path)
    back = {c: b for b, c in _bpe.byte_chars().items()}
    known = {i: t for t, i in _bpe.specials(path).items()}
    each = []
    for i in range(max(tok.get_vocab(True).values()) + 1):
        each.append(known[i] if i in known else bytes(back[c] for c in tok.id_to_token(i) or ""))
    size = np.fromiter(map(len, each), np.int64, len(each))
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size


def decode_ids(encoded: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of a binary column of ids; bytes that are no UTF-8 become U+FFFD.

    A null gives an empty text.  Ids outside the vocabulary are an error.
    """
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begin, size = pieces(path)
        for batch in batches:
            for part in slices(batch, ids_col, 8 << 20):
                texts = []
                for x in part.column(ids_col):
                    ids = np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, "<u4")
                    texts.append(_bpe.ragged_take(data, begin[ids], size[ids]).tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"]
                )

    kept = encoded.drop("decoded")
    return kept.mapInArrow(run, schema_plus(kept, ("decoded", "string")))
