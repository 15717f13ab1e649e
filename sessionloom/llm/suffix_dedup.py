"""Repeated byte strings over the corpus, by hash winnowing in place of sorted prefix doubling.

A byte is repeated if a string of `length` bytes that covers it starts anywhere else.
Positions get ranks and drop out when unique; a rank is a hash of the bytes it stands for,
which serves as the sort's number without a sort (`repeated_by_sorting` does sort, at many
times the shuffle):

1.  Rank at `anchor` bytes.  Neighbouring windows of `length` bytes whose smallest rank
    is the same form a run, about one for 70 positions, so equal windows lie in runs of
    equal smallest rank.  Runs whose rank occurs once in the corpus are done.
2.  Rank of a run's whole extent (its bytes and length).  Where all runs of a rank, or
    several of them, have one extent, all their windows are repeated.
3.  What is left, runs that share a rank but no extent, is taken window by window: the
    pair (rank at length/2, rank length/2 further on), past the threshold.  One run of
    every extent that occurs more than once takes part, as a partner.

Ranks travel in lists by hash bucket and chunk of documents, distinct in a list, so a
passage that occurs everywhere has an entry per chunk.  Chunks are written once and read
in every round.  Long texts are taken PART positions at a time.

Bytes are cut only where an extent, or both halves of a window, have the same rank and
the same smallest rank: 128 bits.  Ranks mix sums modulo 2^64 with sums modulo two primes,
as strings are known that any sum modulo 2^64 takes for equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm._bpe import ragged_take, text_buffers
from sessionloom.llm._chunks import buckets_for, packed, squeeze, unpacked, unsqueeze
from sessionloom.llm._spark import partitions, ship, store

LENGTH, ANCHOR = 200, 64
CHUNK_BYTES, PART, BUCKET_BYTES = 8 << 20, 1 << 19, 64 << 20
PRIMES = (2147483647, 2147483629)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ONCE, SAME, MIXED = 0, 1, 2  # of smallest ranks: unique; one extent; several
ALONE, SHARED, PARTNER = 0, 1, 2  # of extents
LISTS = "bucket int, chunk binary, kind int, data binary"
BACK = "chunk binary, kind int, bucket int, data binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo a prime, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out.astype(np.uint32)


@lru_cache(1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.uint64, np.ndarray, np.ndarray]]]:
    """Powers of the bases and of their inverses, modulo 2^64 and modulo the primes."""
    both = []
    for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
        power = np.full(n, np.uint64(base))
        power[0] = 1
        both.append(np.multiply.accumulate(power, out=power))
    primes = []
    for i, prime in enumerate(PRIMES):
        base = int(MIX[i]) % prime
        primes.append((np.uint64(prime), _powers(base, prime, n), _powers(pow(base, -1, prime), prime, n)))
    return *both, primes


class Ranks:
    """Ranks of any extent of a byte buffer, from running sums of polynomials."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.back, primes = _tables(max(2 * PART, n + 1))
        letter = data.astype(np.uint64) + np.uint64(1)
        self.sums = self._summed(letter * power[:n])
        self.primes = [(p, self._summed(letter * up[:n]), back) for p, up, back in primes]

    @staticmethod
    def _summed(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=out[1:])
        return out

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.sums[end] - self.sums[begin]) * self.back[begin]
        both = np.zeros(len(begin), np.uint64)
        for p, sums, back in self.primes:  # a part is short enough for exact sums
            both = (both << np.uint64(32)) | ((sums[end] - sums[begin]) % p * back[begin] % p)
        return mix(out ^ mix(both))

    def all(self, size: int) -> np.ndarray:
        """Ranks, by sums modulo 2^64 alone, at `size` of every position that has so many bytes after it."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Runs:
    """Runs of windows with one smallest rank, of a part of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        self.length = length
        self.ranks = Ranks(data)
        size = np.diff(offsets)
        enough = size >= length
        windows = np.where(enough, size - length + 1, 0)
        begin = offsets[:-1]
        if not enough.any():
            self.first = self.count = np.zeros(0, np.int64)
            self.low = self.extent = self.both = np.zeros(0, np.uint64)
            self.twice = np.zeros(0, bool)
            return
        every = self.ranks.all(anchor)
        low = _lowest(every, length - anchor + 1)
        before = np.cumsum(windows) - windows
        at = np.repeat(begin - before, windows) + np.arange(int(windows.sum()))
        value = low[at]
        head = np.ones(len(at), bool)
        head[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
        where = np.flatnonzero(head)
        self.first, self.low = at[where], value[where]
        self.count = np.diff(np.append(where, len(at)))
        whole = self.ranks.at(self.first, self.first + self.count + length - 1)
        self.extent = mix(whole + self.count.astype(np.uint64) * MIX[0])
        self.both = mix(self.extent + self.low * MIX[1])
        self.twice = self._twice(every, length - anchor)

    def _twice(self, every: np.ndarray, reach: int) -> np.ndarray:
        """Runs that hold their smallest rank twice, as in periodic text: windows of one run may be equal."""
        mask = np.uint64((1 << 20) - 1)
        table = np.zeros(1 << 20, bool)
        table[(self.low & mask).astype(np.int64)] = True
        at = np.flatnonzero(table[(every & mask).astype(np.int64)])
        lows = np.unique(self.low)
        rank = every[at]
        same = lows[np.minimum(np.searchsorted(lows, rank), len(lows) - 1)] == rank
        at, rank = at[same], rank[same]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        next_ = np.flatnonzero((rank[1:] == rank[:-1]) & (at[1:] - at[:-1] <= self.count.max() + reach))
        here, there, rank = at[next_], at[next_ + 1], rank[next_]
        from_ = np.maximum(np.searchsorted(self.first, here - reach, "right") - 1, 0)
        n = np.searchsorted(self.first, here, "right") - from_
        run = np.repeat(from_ - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair = np.repeat(np.arange(len(here)), n)
        holds = (self.low[run] == rank[pair]) & (self.first[run] <= here[pair])
        holds &= there[pair] <= self.first[run] + self.count[run] - 1 + reach
        out = np.zeros(len(self.first), bool)
        out[run[holds]] = True
        return out

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, rank, rank further on) of the windows of some runs."""
        count = self.count[which]
        at = np.repeat(self.first[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        half = self.length // 2
        tail = self.length - half
        return at, self.ranks.at(at, at + half), self.ranks.at(at + tail, at + self.length)


def _parts(table: pa.Table, length: int, anchor: int) -> Iterator[tuple[int, Runs]]:
    """(position in the chunk, runs) of parts of about PART bytes: some documents, or some of the windows of one."""
    data, offsets = text_buffers(table["text"])
    begin, n = 0, len(offsets) - 1
    while begin < n:
        a, size = int(offsets[begin]), int(offsets[begin + 1] - offsets[begin])
        if size > PART:
            for at in range(a, a + size - length + 1, PART):
                piece = data[at : min(at + PART + length - 1, a + size)]
                yield at, Runs(piece, np.array([0, len(piece)]), length, anchor)
            begin += 1
            continue
        end = int(np.searchsorted(offsets, a + PART, "left"))
        end = min(max(end, begin + 1), n)
        long = np.flatnonzero(np.diff(offsets[begin : end + 1]) > PART)
        if len(long):
            end = begin + int(long[0])
        b = offsets[end]
        yield a, Runs(data[a:b], offsets[begin : end + 1] - a, length, anchor)
        begin = end


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket, where each bucket begins in it, buckets that are not empty)."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, cuts, np.flatnonzero(np.diff(cuts))


def _spread_lists(key: bytes, kind: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    order, cuts, full = _split(keys, buckets)
    rows = []
    for b in full.tolist():
        mine = order[cuts[b] : cuts[b + 1]]
        rows.append({"bucket": b, "chunk": key, "kind": kind, "data": squeeze(keys[mine], *(c[mine] for c in columns))})
    kinds = pa.schema([("bucket", pa.int32()), ("chunk", pa.binary()), ("kind", pa.int32()), ("data", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, kinds)


def _distinct_runs(table: pa.Table, length: int, anchor: int):
    """The distinct smallest ranks of a chunk with (several?, least and greatest extent),
    and its distinct extents with their smallest rank and (several?)."""
    low, both = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    extent, twice = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for _, runs in _parts(table, length, anchor):
        if len(runs.first):
            low.append(runs.low)
            extent.append(runs.extent)
            both.append(runs.both)
            twice.append(runs.twice)
    twice = np.concatenate(twice)
    low, extent, both = np.concatenate(low), np.concatenate(extent), np.concatenate(both)
    keys, first, count = np.unique(both, return_index=True, return_counts=True)
    extents = keys, low[first], (count > 1).astype(np.uint8)
    order = np.argsort(low, kind="stable")
    low, extent, twice = low[order], extent[order], twice[order]
    head = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.zeros(0, np.int64)
    several = (np.diff(np.append(head, len(low))) > 1).astype(np.uint8)
    least = np.minimum.reduceat(extent, head) if len(head) else extent
    most = np.maximum.reduceat(extent, head) if len(head) else extent
    if len(head):  # a run that may repeat itself: open, whatever the others are
        own = np.logical_or.reduceat(twice, head)
        several[own], least[own], most[own] = 1, 0, 0xFFFFFFFFFFFFFFFF
    return (low[head], several, least, most - least), extents


def _first_lists(length: int, anchor: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, table in zip(batch.column("chunk").to_pylist(), map(unpacked, batch.column("packed"))):
                (low, *rest), (both, *others) = _distinct_runs(table, length, anchor)
                yield _spread_lists(key, 0, low, rest, buckets)
                yield _spread_lists(key, 1, both, others, buckets)

    return run


KINDS = {0: ("<u8", "u1", "<u8", "<u8"), 1: ("<u8", "<u8", "u1"), 2: ("<u8", "<u8", "u1")}


def _count_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each entry of a bucket's lists is, sent back to the lists' chunks."""
    lists: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            lists.setdefault(row["kind"], []).append((row["chunk"], row["bucket"], row["data"]))
    for kind, rows in lists.items():
        columns = [np.concatenate(c) for c in zip(*(unsqueeze(d, *KINDS[kind]) for _, _, d in rows))]
        size = [len(unsqueeze(d, KINDS[kind][0])[0]) for _, _, d in rows]
        found = (_ranks_found, _extents_found, _windows_found)[kind](*columns)
        ends = np.cumsum(size)
        out = [
            {"chunk": c, "kind": kind, "bucket": b, "data": squeeze(found[e - n : e])}
            for (c, b, _), n, e in zip(rows, size, ends)
        ]
        kinds = pa.schema([("chunk", pa.binary()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
        yield pa.RecordBatch.from_pylist(out, kinds)


def _ranks_found(low, several, least, spread):
    key, place = np.unique(low, return_inverse=True)
    total = np.bincount(place, 1 + several.astype(np.int64), len(key))
    low_, high = np.full(len(key), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(key), np.uint64)
    np.minimum.at(low_, place, least)
    np.maximum.at(high, place, least + spread)
    kind = np.where(total < 2, ONCE, np.where(low_ == high, SAME, MIXED))
    return kind[place].astype(np.uint8)


def _placed(one, two, several):
    """(order by both, first of each pair in it, place of each, how often a pair occurs: twice counts as twice or more)."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    head = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(one) else np.zeros(0, bool)
    place = np.cumsum(head) - 1
    return order, np.flatnonzero(head), place, np.bincount(place, 1 + several[order].astype(np.int64))


def _extents_found(both, low, several):
    order, head, place, total = _placed(both, low, several)
    found = np.where(total[place] > 1, SHARED, ALONE)
    found[head[total > 1]] = PARTNER
    out = np.empty(len(both), np.uint8)
    out[order] = found
    return out


def _windows_found(one, two, several):
    order, _, place, total = _placed(one, two, several)
    out = np.empty(len(one), np.uint8)
    out[order] = total[place] > 1
    return out


class Found:
    """What the buckets said of a chunk's entries of one kind, looked up by key."""

    def __init__(self, answers: pa.Table, kind: int):
        self.of: dict[int, np.ndarray] = {}
        for k, b, data in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "data"))):
            if k == kind:
                got = unsqueeze(data, "u1")[0]
                self.of[b] = np.maximum(self.of[b], got) if b in self.of else got

    def entries(self, keys: np.ndarray, buckets: int) -> np.ndarray:
        """Answers for the same keys, in the same order, as the lists had."""
        order, cuts, full = _split(keys, buckets)
        out = np.zeros(len(keys), np.uint8)
        for b in full.tolist():
            got = self.of.get(b)
            if got is None or len(got) != cuts[b + 1] - cuts[b]:
                raise ValueError("a chunk's answers do not fit its lists")
            out[order[cuts[b] : cuts[b + 1]]] = got
        return out


def _open_runs(table: pa.Table, answers: pa.Table, length: int, anchor: int, buckets: int):
    """Intervals known to be repeated, and (position, rank, rank) of windows left to be compared."""
    (low_keys, *_), (both_keys, *_) = _distinct_runs(table, length, anchor)
    of_low = Found(answers, 0).entries(low_keys, buckets)
    of_both = Found(answers, 1).entries(both_keys, buckets)
    known, left = [np.zeros((0, 2), np.int64)], [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    seen = np.zeros(len(both_keys), bool)
    for at, runs in _parts(table, length, anchor):
        if not len(runs.first):
            continue
        rank = of_low[np.searchsorted(low_keys, runs.low)]
        place = np.searchsorted(both_keys, runs.both)
        extent = of_both[place]
        whole = (rank == SAME) | ((rank == MIXED) & (extent != ALONE))
        known.append(np.stack([runs.first[whole], (runs.first + runs.count + length - 1)[whole]], 1) + at)
        partner = np.flatnonzero((rank == MIXED) & (extent == PARTNER))
        partner = partner[np.unique(place[partner], return_index=True)[1]]
        partner = partner[~seen[place[partner]]]
        seen[place[partner]] = True
        which = np.sort(np.append(np.flatnonzero((rank == MIXED) & (extent == ALONE)), partner))
        where, one, two = runs.windows(which)
        left.append((where + at, one, two))
    return np.concatenate(known), tuple(np.concatenate(x) for x in zip(*left))


def _pairs(one: np.ndarray, two: np.ndarray):
    """Distinct pairs with (several?), and the place of every pair in them."""
    order = np.lexsort((two, one))
    head = np.ones(len(one), bool)
    head[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    place = np.empty(len(one), np.int64)
    place[order] = np.cumsum(head) - 1
    first = order[head]
    several = (np.bincount(place, minlength=len(first)) > 1).astype(np.uint8)
    return one[first], two[first], several, place


def _second_lists(length: int, anchor: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [LIST_SCHEMA().empty_table()]
        key = left["chunk"][0].as_py() if len(left) else b""
        for table in map(unpacked, right["packed"]):
            _, (_, one, two) = _open_runs(table, left, length, anchor, buckets)
            one, two, several, _ = _pairs(one, two)
            out.append(pa.Table.from_batches([_spread_lists(key, 2, one, [two, several], buckets)]))
        return pa.concat_tables(out)

    return run


def LIST_SCHEMA() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("chunk", pa.binary()), ("kind", pa.int32()), ("data", pa.binary())])


def _merge(intervals: np.ndarray) -> np.ndarray:
    """Sorted intervals with overlapping and touching ones joined."""
    if not len(intervals):
        return intervals
    intervals = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(intervals[:, 1])
    head = np.append(True, intervals[1:, 0] > reach[:-1])
    first = np.flatnonzero(head)
    return np.stack([intervals[first, 0], reach[np.append(first[1:] - 1, len(reach) - 1)]], 1)


def _within_characters(spans: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Spans without the bytes of characters that they hold in part."""
    inner = np.append((data & 0xC0) == 0x80, False)  # bytes that continue a character
    for _ in range(3):
        spans = spans + np.stack([inner[spans[:, 0]], np.zeros(len(spans), bool)], 1)
        spans = spans - np.stack([np.zeros(len(spans), bool), inner[spans[:, 1]]], 1)
    return spans[spans[:, 0] < spans[:, 1]]


def _finish(length: int, anchor: int, buckets: int, characters: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for table in map(unpacked, right["packed"]):
            known, (where, one, two) = _open_runs(table, left, length, anchor, buckets)
            keys, _, _, place = _pairs(one, two)
            hit = where[Found(left, 2).entries(keys, buckets)[place] > 0] if len(where) else where
            data, offsets = text_buffers(table["text"])
            # runs end with their text, so intervals of neighbouring texts may touch: cut them there
            spans = _merge(np.concatenate([known, np.stack([hit, hit + length], 1)]))
            spans = _cut_at(spans, offsets)
            if characters:
                spans = _within_characters(spans, data)
            doc = np.searchsorted(offsets, spans[:, 0], "right") - 1
            each = np.searchsorted(doc, np.arange(table.num_rows + 1))
            inside = spans - offsets[doc][:, None]
            pairs = pa.StructArray.from_arrays(
                [pa.array(inside[:, 0], pa.int64()), pa.array(inside[:, 1], pa.int64())], names=["start", "end"]
            )
            edges = np.concatenate([[0], spans.ravel(), [len(data)]])
            rest = np.concatenate([data[x:y] for x, y in edges.reshape(-1, 2).tolist()])
            gone = np.append(0, np.cumsum(spans[:, 1] - spans[:, 0]))
            before = offsets - gone[np.searchsorted(spans[:, 1], offsets, "right")]
            kept = pa.Array.from_buffers(
                pa.large_binary(), table.num_rows, [None, pa.py_buffer(before.astype(np.int64)), pa.py_buffer(rest)]
            )
            table = table.append_column("n_bytes", pa.array(np.diff(offsets), pa.int64()))
            table = table.append_column("spans", pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), pairs))
            out.append(table.append_column("kept", kept.cast(pa.binary())))
        return pa.concat_tables(out)

    return run


def _cut_at(spans: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    first = np.searchsorted(offsets, spans[:, 0], "right")
    last = np.searchsorted(offsets, spans[:, 1], "left")
    inner = last - first
    if not inner.any():
        return spans
    cuts = np.unique(ragged_take(offsets, first, inner))
    pieces = []
    for a, b in spans.tolist():
        edges = [a, *cuts[(cuts > a) & (cuts < b)].tolist(), b]
        pieces += list(zip(edges, edges[1:]))
    return np.array(pieces, np.int64).reshape(-1, 2)


def repeated_bytes(
    docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, characters: bool = False, chunk_bytes: int = CHUNK_BYTES,
    text_col: str = "text",
) -> DataFrame:
    """Every row of docs with n_bytes, spans (array<struct<start, end>>: maximal repeated runs, in
    UTF-8 bytes of the text) and kept (binary: the other bytes, joined).

    Every place of a repeated string counts, the first too; strings are judged on the
    input; matches never cross texts.  With `characters`, a character of which only a part
    is repeated stays, so that kept is UTF-8.  Null and short texts have no spans.  Repeated
    rows repeat each other's text.  Columns named n_bytes, spans or kept are replaced.
    An empty table gives none.
    """
    if not 2 <= anchor <= length:
        raise ValueError("anchor must be between 2 and length")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_bytes", "spans", "kept").withColumnRenamed(text_col, "text")
    columns = docs.select("text", *(c for c in docs.columns if c != "text"))
    texts = store(columns.mapInArrow(packed(chunk_bytes), "chunk binary, packed binary"), "chunks")
    buckets = buckets_for(texts, BUCKET_BYTES)
    first = texts.mapInArrow(_first_lists(length, anchor, buckets), LISTS)
    # written, as both later rounds must see the same partners
    answers = store(first.groupBy("bucket").applyInArrow(_count_bucket, BACK), "ranks")
    second = answers.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(_second_lists(length, anchor, buckets), LISTS)
    more = second.groupBy("bucket").applyInArrow(_count_bucket, BACK)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [*columns.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())]
    )
    both = answers.unionByName(more)
    done = both.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(_finish(length, anchor, buckets, characters), schema)
    return done.withColumnRenamed("text", text_col)


def _first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, at, rank) of every position with 8 bytes after it: those bytes as a number."""
    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            data = (text or "").encode()
            for a in range(0, len(data) - 7, PART):
                part = np.frombuffer(data[a : a + PART + 7], np.uint8)
                rank = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, 8)).view("<i8").ravel()
                at = np.arange(a, a + len(rank))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rank), doc)), pa.array(at), pa.array(rank)], names=["doc", "at", "rank"]
                )


def _reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (one, two): (doc, at, rank) of those that share both, numbered through the task's range."""
    number, held = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        one, two = table["one"].to_numpy(), table["two"].to_numpy()
        head = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        last = int(np.flatnonzero(head)[-1])  # the last pair may go on in the next batch
        yield _several(table.slice(0, last), head[:last], number)
        number += int(head[:last].sum())
        held = table.slice(last)
    if held is not None:
        yield _several(held, np.arange(len(held)) == 0, number)


def _several(table: pa.Table, head: np.ndarray, number: int) -> pa.RecordBatch:
    place = np.cumsum(head) - 1
    many = np.bincount(place, minlength=1)[place] > 1
    rank = pa.array((number + place[many]).astype(np.int64))
    kept = table.filter(pa.array(many))
    return pa.RecordBatch.from_arrays([kept["doc"].combine_chunks(), kept["at"].combine_chunks(), rank], names=["doc", "at", "rank"])


def repeated_by_sorting(docs: DataFrame, *, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """(doc, at): where a string of `length` bytes (9 at least) starts that starts elsewhere too, by plain prefix doubling.

    Spark sorts pairs of ranks at growing offsets; positions are ranked anew and drop out
    when unique.  Every position of the corpus takes part, so this is for small tables: it
    is the measure of `repeated_bytes`.  `doc` is monotonically_increasing_id of docs.
    """
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(text_col).alias("text"))
    now, have = read.mapInArrow(_first_ranks, "doc long, at long, rank long"), 8
    while have < length:
        step = min(have, length - have)
        further = now.select("doc", (F.col("at") - step).alias("at"), F.col("rank").alias("two"))
        pairs = now.withColumnRenamed("rank", "one").join(further, ["doc", "at"])
        dealt = pairs.repartitionByRange(partitions(spark), "one", "two").sortWithinPartitions("one", "two")
        now = store(dealt.mapInArrow(_reranked, "doc long, at long, rank long"), "doubled")
        have += step
    return now.select("doc", "at")
