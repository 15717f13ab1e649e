"""Best-fit packing of token sequences, improved by swap-based local search.

Pieces are dealt to groups of about GROUP_ITEMS by hash.  A group is packed best-fit
decreasing; then underfull bins, emptiest first, give documents to fuller ones, by moves
and by exchanges one for one, one for two or two for one, each of which raises the sum
of squared fills and at least halves the room of the bin that gains.  Bits say which
sizes, and sums of two sizes, the bins of every room hold, so all bins and all documents
are offered whatever their number.  A group ends at its lower bound, ceil(tokens /
capacity), or after two passes over all underfull bins that emptied none.  What stays
loose, the bins of a group that are emptiest, is pooled with other groups' and packed
anew, until one group is left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import _bpe
from sessionloom.llm._spark import schema_plus, ship, slices, store

CAPACITY = 2048
GROUP_ITEMS = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _bpe.word_cache(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = cache.encode(part.column("text"))
                rows = []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[ends[i] : ends[i + 1]], end_id).astype("<u4")
                    first = len(own) % capacity or capacity
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, k, a, b - a, zlib.crc32(own[a:b])))
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                        names=["doc_id", "piece", "start", "length", "ids_crc32"],
                    )

    return run


def cut_pieces(
    docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of every document: its ids and `end_id`, cut only where longer than capacity.

    All pieces but a document's first are full.  A null or empty text is the end id alone.
    """
    ship(docs.sparkSession)
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return read.mapInArrow(_cut(path, capacity, end_id), PIECES)


class Bins:
    """Bins of one group, looked up by the room left and by the sizes that they hold."""

    def __init__(self, capacity: int, size: list[int]):
        self.capacity, self.size = capacity, size
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some bin has room r
        self.sums: list[tuple[int, int] | None] = []  # of a bin: bits of its sizes, and of the sums of two
        self.held: dict[int, tuple[int, int]] = {}  # the same of all bins with a room

    def _enter(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].add(b)
        self.mask |= 1 << r
        self.held.pop(r, None)

    def _leave(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].discard(b)
        self.held.pop(r, None)
        if not self.by_room[r]:
            self.mask &= ~(1 << r)

    def least(self, size: int) -> int | None:
        """The least room that holds `size`."""
        above = self.mask >> size
        return size + (above & -above).bit_length() - 1 if above else None

    def sums_of(self, b: int) -> tuple[int, int]:
        if self.sums[b] is None:
            one = two = 0
            for x in self.items[b]:
                two |= one << self.size[x]
                one |= 1 << self.size[x]
            self.sums[b] = one, two
        return self.sums[b]

    def sums_at(self, room: int) -> tuple[int, int]:
        if room not in self.held:
            one = two = 0
            for b in self.by_room[room]:
                x, y = self.sums_of(b)
                one, two = one | x, two | y
            self.held[room] = one, two
        return self.held[room]

    def add(self, item: int) -> None:
        r = self.least(self.size[item])
        if r is None:
            self.items.append([])
            self.room.append(self.capacity)
            self.sums.append(None)
            b = len(self.room) - 1
        else:
            b = next(iter(self.by_room[r]))
            self._leave(b)
        self.items[b].append(item)
        self.room[b] -= self.size[item]
        self.sums[b] = None
        self._enter(b)

    def change(self, b: int, out: list[int], into: list[int]) -> None:
        self._leave(b)
        for x in out:
            self.items[b].remove(x)
        self.items[b] += into
        self.room[b] += sum(self.size[x] for x in out) - sum(self.size[x] for x in into)
        self.sums[b] = None
        self._enter(b)

    def close(self, b: int) -> None:
        """An empty bin goes; the last one takes its number."""
        self._leave(b)
        last = len(self.room) - 1
        if b != last:
            self._leave(last)
            self.items[b], self.room[b], self.sums[b] = self.items[last], self.room[last], self.sums[last]
            self._enter(b)
        for x in (self.items, self.room, self.sums):
            x.pop()

    def pick(self, b: int, total: int, two: bool) -> list[int]:
        """One document of a bin, or two, of `total` tokens."""
        if not two:
            return [next(x for x in self.items[b] if self.size[x] == total)]
        seen: dict[int, int] = {}
        for x in self.items[b]:
            if total - self.size[x] in seen:
                return [seen[total - self.size[x]], x]
            seen[self.size[x]] = x
        raise AssertionError("no two documents of that size")


def pack(size: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of item numbers) for items of 1 to `capacity` tokens."""
    bins = Bins(capacity, size.tolist())
    for i in np.argsort(-size, kind="stable").tolist():
        bins.add(i)
    bound = math.ceil(int(size.sum()) / capacity)
    idle = 0
    while len(bins.room) > bound and idle < 2:
        before = len(bins.room)
        if not _pass(bins, bound):
            break
        idle = idle + 1 if len(bins.room) == before else 0
    return bins.items


def _pass(bins: Bins, bound: int) -> bool:
    """Every underfull bin, emptiest first, gives what raises the squared fills; whether any did."""
    changed = False
    for b in sorted(range(len(bins.room)), key=lambda x: -bins.room[x]):
        while b < len(bins.room) and bins.room[b] and (_move(bins, b) or _exchange(bins, b)):
            changed = True
            if not bins.items[b]:
                bins.close(b)
                if len(bins.room) <= bound:
                    return True
                break
    return changed


def _move(bins: Bins, giver: int) -> bool:
    """The largest document that fits goes to the fullest other bin that holds it, if that is the fuller of the two."""
    bins._leave(giver)
    found = None
    for x in sorted(bins.items[giver], key=lambda i: -bins.size[i]):
        r = bins.least(bins.size[x])
        if r is not None and r - bins.size[x] < bins.room[giver]:
            found = x, next(iter(bins.by_room[r]))
            break
    bins._enter(giver)
    if found is None:
        return False
    bins.change(giver, [found[0]], [])
    bins.change(found[1], [], [found[0]])
    return True


def _bits(mask: int) -> list[int]:
    out = []
    while mask:
        out.append((mask & -mask).bit_length() - 1)
        mask &= mask - 1
    return out


def _exchange(bins: Bins, giver: int) -> bool:
    """The exchange with a bin at least as full that fills it most: a document for one or two smaller ones, or two for one."""
    one, two = (_bits(x) for x in bins.sums_of(giver))
    bins._leave(giver)
    rooms = bins.mask & ((2 << bins.room[giver]) - 2)
    most, best = 0, None
    while rooms and rooms.bit_length() - 1 > most:
        r = rooms.bit_length() - 1
        rooms ^= 1 << r
        singles, pairs = bins.sums_at(r)
        for gives, takes, kind in ((one, singles, (False, False)), (one, pairs, (False, True)), (two, singles, (True, False))):
            for x in gives:
                low, high = max(x - r, 0), x - (r + 1) // 2  # what is taken back, so that half of the room is filled
                fits = (takes >> low) & ((2 << (high - low)) - 1) if high >= low else 0
                if fits:
                    y = low + (fits & -fits).bit_length() - 1
                    if x - y > most:
                        most, best = x - y, (r, x, y, kind)
            if most == r:
                break
    bins._enter(giver)
    if best is None:
        return False
    r, x, y, (gives_two, takes_two) = best
    taker = next(b for b in bins.by_room[r] if b != giver and bins.sums_of(b)[takes_two] >> y & 1)
    give, take = bins.pick(giver, x, gives_two), bins.pick(taker, y, takes_two)
    bins.change(giver, give, take)
    bins.change(taker, take, give)
    return True


def _pack_group(capacity: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["length"].to_numpy()
        bins = pack(size, capacity)
        fill = np.array([size[x].sum() for x in bins])
        loose = np.zeros(len(bins), bool)
        if not last:  # the emptiest, until another bin's worth of room is among them
            order = np.argsort(fill, kind="stable")
            free = np.cumsum(capacity - fill[order])
            loose[order[: int(np.searchsorted(free, capacity)) + 1]] = True
            loose &= fill < capacity
        number, offset, open_ = (np.empty(len(rows), t) for t in (np.int64, np.int64, bool))
        for k, x in enumerate(bins):
            number[x], open_[x] = k, loose[k]
            offset[x] = np.cumsum(size[x]) - size[x]
        return rows.assign(bin=number, offset=offset, open=open_)

    return run


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (`length` from 1 to capacity).

    Full pieces are sequences by themselves.  Rows are told apart by place, never by id,
    so repeated rows are packed each.  No rows give no sequences.  Other columns stay.
    """
    kept = pieces.drop("sequence_id", "offset", "group", "bin", "open")
    full = kept.where(F.col("length") >= capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest, done, level = kept.where(F.col("length") < capacity), full, 0
    count = rest.count()
    schema = schema_plus(kept, ("group", "long"), ("bin", "long"), ("offset", "long"), ("open", "boolean"))
    names = [c for c in kept.columns]
    while count:
        groups = max(1, math.ceil(count / group_items))
        salt = F.xxhash64(F.monotonically_increasing_id(), F.lit(level))  # by place: equal pieces go to all groups
        dealt = rest.withColumn("group", F.pmod(salt, F.lit(groups)).cast("long"))
        packed = store(dealt.groupBy("group").applyInPandas(_pack_group(capacity, groups == 1), schema), "packed")
        number = F.lit(level) * F.lit(1 << 56) + F.col("group") * F.lit(1 << 24) + F.col("bin")
        settled = packed.where(~F.col("open")).select(*names, number.cast("long").alias("sequence_id"), "offset")
        done = done.unionByName(settled)
        rest, level = packed.where("open").select(*names), level + 1
        count = rest.count() if groups > 1 else 0
    return done


def pack_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack_pieces(store(cut_pieces(docs, path, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity)
