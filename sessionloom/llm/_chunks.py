"""Chunks of whole documents, and arrays squeezed for a shuffle."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401  pa.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sessionloom.llm._bpe import text_buffers
from sessionloom.llm._spark import input_bytes, partitions, slices


def buckets_for(docs: DataFrame, each: int) -> int:
    """Hash buckets for lists of a table: one for `each` bytes of it, and some for every core of a small cluster.

    More shuffle partitions do not make more, so that lists do not shrink to nothing.
    """
    return max(min(4 * partitions(docs.sparkSession), 1024), -(-input_bytes(docs) // each))


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Documents by about `size` bytes of text; the same rows give the same chunks on each run."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        for part in slices(batch, "text", size // 4):
            held.append(part)
            total += part.column("text").nbytes
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def keyed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, pa.Table]]:
    """(key, documents) of every chunk.  A key holds a hash of the texts, by which scans agree, and the chunk's
    place, so that equal chunks stay apart."""
    for i, table in enumerate(chunks(batches, size)):
        data, offsets = text_buffers(table["text"])
        digest = hashlib.blake2b(data, digest_size=16)
        digest.update(np.ascontiguousarray(offsets))
        yield digest.digest() + struct.pack("<II", TaskContext.get().partitionId(), i), table


@lru_cache(1)
def codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed binary: their number and sizes, then their bytes."""
    parts = [np.ascontiguousarray(x).tobytes() for x in arrays]
    sizes = struct.pack(f"<B{len(parts)}I", len(parts), *map(len, parts))
    return sizes + codec().compress(b"".join(parts), asbytes=True)


def unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The first arrays of a squeezed binary, as the given types."""
    sizes = struct.unpack_from(f"<{data[0]}I", data, 1)
    body = codec().decompress(memoryview(data)[1 + 4 * len(sizes) :], sum(sizes), asbytes=True)
    out, at = [], 0
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(body, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def packed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks as rows (chunk, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in keyed(batches, size):
            sink = pa.BufferOutputStream()
            own = pa.Codec("zstd", compression_level=3)  # a stream takes its codec away
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=own)) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["chunk", "packed"],
            )

    return run


def unpacked(data) -> pa.Table:
    """The documents of a packed chunk (an Arrow binary scalar)."""
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()
