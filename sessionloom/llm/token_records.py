"""Token ids in length-delimited binary records, with an index beside each file.

A record: the payload's length (u64), the masked CRC-32 of those 8 bytes (u32), the
payload, its masked CRC-32 (u32).  The payload: doc_id (i64), 1 if doc_id is null (u8),
bytes per id (u8: 2 or 4), then the ids.  The index holds one entry per record: offset
(u64), whole length (u32), ids (u32), so that records can be read in any order.  All
numbers are little-endian.  A checksum is masked by turning it right by 15 bits and
adding 0xA282EAD8.

Files are written by tasks under names of their own, and only those that a finished
task reported are in the manifest: a lost or repeated task leaves nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm import _bpe
from sessionloom.llm._spark import fresh_path, partitions, ship, slices, store

HEAD, PAYLOAD, TAIL = struct.Struct("<QI"), struct.Struct("<qBB"), struct.Struct("<I")
INDEX = np.dtype([("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(data, at: int) -> tuple[bytes, int]:
    """(payload, where the next record begins); ValueError if a checksum is wrong."""
    size, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"bad length at {at}")
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) != size or TAIL.unpack_from(data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"bad record at {at}")
    return payload, at + size + 16


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    system, top = fs.FileSystem.from_uri(folder)
    name = f"ids-{part:06d}-{uuid.uuid4().hex}"
    cache, rows, total, ids_total, out, index = _bpe.word_cache(path), 0, 0, 0, None, None
    for batch in batches:
        for piece in slices(batch, "text"):
            if out is None:
                system.create_dir(top, recursive=True)
                out = system.open_output_stream(f"{top}/{name}.rec")
                index = system.open_output_stream(f"{top}/{name}.idx")
            ids, ends = cache.encode(piece.column("text"))
            width = 2 if ids.dtype == np.uint16 and end_id <= 0xFFFF else 4
            ids = ids.astype("<u2" if width == 2 else "<u4")
            last = end_id.to_bytes(width, "little")
            entries = np.empty(piece.num_rows, INDEX)
            data = []
            for i, doc in enumerate(piece.column("doc_id").to_pylist()):
                body = PAYLOAD.pack(doc or 0, doc is None, width) + ids[ends[i] : ends[i + 1]].tobytes() + last
                data.append(frame(body))
                entries[i] = total, len(data[-1]), ends[i + 1] - ends[i] + 1
                total += len(data[-1])
            out.write(b"".join(data))
            index.write(entries.tobytes())
            rows += piece.num_rows
            ids_total += int(entries["n_tokens"].sum())
    if out is not None:
        out.close()
        index.close()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "file": f"{folder}/{name}", "n_records": rows, "n_ids": ids_total, "n_bytes": total}]
        )


MANIFEST = "part long, file string, n_records long, n_ids long, n_bytes long"


def write_records(
    docs: DataFrame, path: str, *, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write every document's ids and `end_id`, in ascending id order; returns the manifest.

    Null and empty texts become records with the end id alone.  Null ids come first.
    Repeated ids each get a record, in an order of their texts' hashes.  An empty table
    gives no file.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "records")
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # the hash and the place split an id, and a text, that has too many rows for a task
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order)
    return store(dealt.mapInArrow(lambda batches: _write(batches, folder, path, end_id), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, at = fs.FileSystem.from_uri(row["file"])
            with system.open_input_stream(f"{at}.idx") as f:
                index = np.frombuffer(f.read(), INDEX)
            begin = row["first_id"] + np.cumsum(index["n_tokens"]) - index["n_tokens"]
            done = 0
            with system.open_input_stream(f"{at}.rec") as f:
                while done < len(index):  # about 4 MB of records at a time
                    size = np.cumsum(index["length"][done:].astype(np.int64))
                    n = int(np.searchsorted(size, 4 << 20)) + 1
                    n = min(n, len(index) - done)
                    data, at_byte, out = f.read(int(size[n - 1])), 0, []
                    for i in range(done, done + n):
                        payload, at_byte = unframe(data, at_byte)
                        doc, null, width = PAYLOAD.unpack_from(payload)
                        ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=PAYLOAD.size)
                        if len(ids) != index["n_tokens"][i]:
                            raise ValueError(f"record {i} of {row['file']} differs from its index")
                        out.append((None if null else doc, int(begin[i]), len(ids), ids.astype("<u4").tobytes()))
                    done += n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )


def read_records(manifest: DataFrame) -> DataFrame:
    """The records of all files: doc_id, start (ids in all records before), n_tokens, ids (unsigned 32-bit).

    Every checksum is verified.  The running sum is over the manifest, a row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id"))
    placed = placed.repartition(partitions(manifest.sparkSession))
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("file").to_pylist():
            system, at = fs.FileSystem.from_uri(file)
            with system.open_input_stream(f"{at}.idx") as f:
                index = np.frombuffer(f.read(), INDEX)
            for a in range(0, len(index), 100_000):
                some = index[a : a + 100_000]
                columns = [pa.array([file] * len(some)), pa.array(np.arange(a, a + len(some)))]
                columns += [pa.array(some[c].astype(np.int64)) for c in INDEX.names]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "record", *INDEX.names])


def record_places(manifest: DataFrame) -> DataFrame:
    """file, record (its number there), offset, length and n_tokens of every record, from the index files alone."""
    ship(manifest.sparkSession)
    files = manifest.select("file").repartition(partitions(manifest.sparkSession), "file")
    return files.mapInArrow(_places, "file string, record long, offset long, length long, n_tokens long")


def _at_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, opened = [], {}
        for row in batch.to_pylist():
            if row["file"] not in opened:
                system, at = fs.FileSystem.from_uri(row["file"])
                opened[row["file"]] = system.open_input_file(f"{at}.rec")
            payload, _ = unframe(opened[row["file"]].read_at(row["length"], row["offset"]), 0)
            doc, null, width = PAYLOAD.unpack_from(payload)
            ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=PAYLOAD.size)
            out.append((None if null else doc, len(ids), ids.astype("<u4").tobytes()))
        for f in opened.values():
            f.close()
        kinds = (pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "n_tokens", "ids"]
        )


def read_places(places: DataFrame) -> DataFrame:
    """doc_id, n_tokens and ids of the records at some places (file, offset, length), in their order: each is read alone."""
    ship(places.sparkSession)
    return places.select("file", "offset", "length").mapInArrow(_at_places, "doc_id long, n_tokens long, ids binary")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """All records in an order that the seed fixes.  Places are shuffled, not records."""
    places = record_places(manifest)
    return read_places(places.orderBy(F.xxhash64("file", "record", F.lit(seed)), "file", "record"))
