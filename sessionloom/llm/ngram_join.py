"""Near-duplicate join on word shingles by chosen paths.

Sets of shingles are embedded as MinHash sketches, whose coordinates serve as tokens.
A run splits all sets on one sampled coordinate and each part on a second one: sets
that share both values share a bucket.  A bucket above LEAF members is split again, on
a coordinate sampled for it, unless its members are so alike that splitting keeps them
together; those, and all small buckets, are leaves.  In leaves all pairs are compared,
first by sketch, then by exact sets; a large leaf is compared block by block.  Of all
leaves that a pair shares the first run's counts it, so pairs are never written: a leaf
gives each set's number of links and its component within the leaf.

A pair of similarity s survives the first two splits of a run with chance s^2, so
runs_at_least(threshold, target) runs reach the target where no bucket is split
further.  What further splits lose is estimated: of pairs found, the number of runs that
found each gives a run's chance p, and recall is 1 - (1 - p)^runs.  Below the target
runs are doubled, and if that is not enough, buckets are split no more, and the first
bound holds.

Texts with equal sets form a class and take part once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm._components import components
from sessionloom.llm._shingles import WORDS, mix, set_keys, shingles, sketches
from sessionloom.llm._spark import discard, partitions, ship, slices, store

THRESHOLD, COORDINATES, LEAF, BLOCK = 0.8, 128, 256, 1024
TARGET, DOUBLINGS = 0.999, 2
ALIKE, DEEPEST = 0.4, 12
MARGIN = 0.2  # below the threshold, on sketches: 5.6 standard errors at 128 coordinates, a chance of 1e-8
FILTER_BITS = 22


def runs_at_least(threshold: float, target: float) -> int:
    """Runs after which a pair at the threshold is met with the chance `target`, by two splits each."""
    return 1 + math.ceil(math.log(1 - target) / math.log(1 - threshold**2)) if threshold < 1 else 1


def _roots(sketch: np.ndarray, first: int, last: int) -> np.ndarray:
    """The bucket of every sketch in every run, after two splits."""
    out = np.empty((len(sketch), last - first), np.uint64)
    for run in range(first, last):
        i, j = (int(x) for x in _coordinates(run, 2))
        pair = (sketch[:, i].astype(np.uint64) << np.uint64(32)) | sketch[:, j]
        out[:, run - first] = mix(mix(pair) ^ np.uint64(0x9E3779B9 * (run + 1)))
    return out


def _coordinates(seed, n: int) -> np.ndarray:
    """n different coordinates sampled for a run."""
    return np.random.default_rng([0x5851F42D, seed]).choice(COORDINATES, n, replace=False)


def _sketched(batches: Iterator[pa.RecordBatch], words: int, runs: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            hashes, offsets = shingles(part.column("text"), words)
            keys, sketch = set_keys(hashes, offsets), sketches(hashes, offsets, COORDINATES)
            small = (sketch & np.uint32(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([x.tobytes() for x in keys], pa.binary()),
                    pa.array(np.diff(offsets).astype(np.int32)),
                    pa.array([x.tobytes() for x in small], pa.binary()),
                    _lists(_roots(sketch, 0, runs)),
                ],
                names=["doc_id", "key", "size", "small", "roots"],
            )


def _more_roots(batches: Iterator[pa.RecordBatch], words: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            hashes, offsets = shingles(part.column("text"), words)
            keys, sketch = set_keys(hashes, offsets), sketches(hashes, offsets, COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in keys], pa.binary()), _lists(_roots(sketch, first, last))], names=["key", "roots"]
            )


def _lists(table: np.ndarray) -> pa.Array:
    ends = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(table.ravel().view(np.int64)))


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large buckets, split on the coordinate sampled for the bucket."""
    for batch in batches:
        n = batch.num_rows
        small = np.frombuffer(b"".join(batch.column("small").to_pylist()), np.uint8).reshape(n, COORDINATES)
        parent = batch.column("bucket").to_numpy().view(np.uint64)
        which = (mix(parent + np.uint64(0x5851F42D)) % np.uint64(COORDINATES)).astype(np.int64)
        child = mix(parent ^ mix(small[np.arange(n), which].astype(np.uint64) + np.uint64(1 << 40)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("bucket"), pa.array(child.view(np.int64)), batch.column("run"), batch.column("node")],
            names=["parent", "bucket", "run", "node"],
        )


def _leaves(roots: DataFrame, classes: DataFrame, leaf: int, deepest: int) -> DataFrame:
    """(bucket, run, node, n): the members of the leaves of some runs, without buckets of one, from (run, bucket, node)."""
    size = roots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    now = store(roots.join(size, "bucket").select("bucket", "run", "node", "n"), "buckets")
    done = now.where(F.col("n") <= leaf)
    open_ = now.where(F.col("n") > leaf)
    for _ in range(deepest):
        if open_.isEmpty():
            return done
        rows = open_.join(classes.select("node", "small"), "node").select("bucket", "run", "node", "small")
        child = store(rows.mapInArrow(_children, "parent long, bucket long, run int, node long"), "children")
        size = child.groupBy("parent", "bucket").agg(F.count("*").alias("n"))
        total = size.groupBy("parent").agg(F.sum("n").alias("whole"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
        judged = size.join(total, "parent")
        alike = F.col("squares") >= ALIKE * F.col("whole") * F.col("whole")
        split = child.join(judged.select("parent", "bucket", "n", "whole", alike.alias("alike")), ["parent", "bucket"])
        kept = F.col("alike") | (F.col("n") > 1)
        split = split.where(kept).select(
            F.when(F.col("alike"), F.col("parent")).otherwise(F.col("bucket")).alias("bucket"), "run", "node",
            F.when(F.col("alike"), F.col("whole")).otherwise(F.col("n")).alias("n"), "alike",
        )
        split = store(split, "buckets")
        discard(child)
        done = done.unionByName(split.where(F.col("alike") | (F.col("n") <= leaf)).drop("alike"))
        open_ = split.where(~F.col("alike") & (F.col("n") > leaf)).drop("alike")
    return done.unionByName(open_)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by (bucket, a, b); a group is of bounded size."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy() for c in ("bucket", "a", "b")])
        if not batch.num_rows:
            continue
        change = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
        if last is not None and tuple(ids[:, 0]) != last and held:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = tuple(ids[:, -1])
    if held:
        yield pa.Table.from_batches(held)


class Members:
    """Rows of whole groups as arrays, and their pairs."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.n = table.num_rows
        self.table = table
        self.bucket, self.a, self.b = (table[c].to_numpy() for c in ("bucket", "a", "b"))
        self.block, self.run = table["block"].to_numpy(), table["run"].to_numpy()
        self.small = np.frombuffer(b"".join(table["small"].to_pylist()), np.uint8).reshape(self.n, COORDINATES)
        change = np.append(True, (self.bucket[1:] != self.bucket[:-1]) | (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1]))
        self.first = np.flatnonzero(change)
        self.size = np.diff(np.append(self.first, self.n))
        lists = table["leaves"].combine_chunks()
        ends = lists.offsets.to_numpy()
        row = np.repeat(np.arange(self.n), np.diff(ends))
        run = lists.values.field("run").to_numpy()[ends[0] : ends[-1]]
        runs = int(run.max(initial=0)) + 1
        self.leaves = np.arange(self.n * runs, dtype=np.int64).reshape(self.n, runs) * 2 + 1  # no two alike
        self.leaves[row, run] = lists.values.field("bucket").to_numpy()[ends[0] : ends[-1]]
        self.real = np.zeros((self.n, runs), bool)
        self.real[row, run] = True

    def pairs(self, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows within groups, some at a time; between blocks a and b if they differ."""
        left, right, total = [], [], 0
        for at, m in zip(self.first.tolist(), self.size.tolist()):
            for i in range(at, at + m - 1) if m > 600 else (None,):
                if i is None:
                    x, y = np.triu_indices(m, 1)
                    x, y = x + at, y + at
                else:
                    y = np.arange(i + 1, at + m)
                    x = np.full(len(y), i)
                cross = (self.a[x] == self.b[x]) | (self.block[x] != self.block[y])
                left.append(x[cross])
                right.append(y[cross])
                total += len(left[-1])
                if total >= most:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, total = [], [], 0
        if left:
            yield np.concatenate(left), np.concatenate(right)

    def candidates(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, runs in common, similarity by sketch) of the pairs that this leaf counts and sketches let pass."""
        for x, y in self.pairs():
            lowest, shared = np.full(len(x), -1), np.zeros(len(x), np.int64)
            for r in range(self.leaves.shape[1]):
                same = (self.leaves[x, r] == self.leaves[y, r]) & self.real[x, r] & self.real[y, r]
                lowest[same & (lowest < 0)] = r
                shared += same
            own = lowest == self.run[x]
            x, y, shared = x[own], y[own], shared[own]
            alike = np.zeros(len(x), np.uint8)
            for i in range(COORDINATES):
                column = self.small[:, i]
                alike += column[x] == column[y]
            near = alike >= least * COORDINATES
            yield x[near], y[near], shared[near], alike[near] / COORDINATES


MEMBER = "bucket long, a int, b int, block int, run int, node long, n_docs long, small binary, leaves array<struct<run:int,bucket:long>>"


def _flagged(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Members with a candidate of their own leaf; with the leaf's pairs at the threshold and their runs, on one row each."""
    for table in _groups(batches):
        m = Members(table)
        hit = np.zeros(m.n, bool)
        pairs, runs = np.zeros(m.n, np.int64), np.zeros(m.n, np.int64)
        for u, v, shared, alike in m.candidates(threshold - MARGIN):
            hit[u] = hit[v] = True
            near = alike >= threshold
            np.add.at(pairs, u[near], 1)
            np.add.at(runs, u[near], shared[near])
        if hit.any():
            kept = m.table.filter(pa.array(hit))
            kept = kept.append_column("pairs", pa.array(pairs[hit])).append_column("runs", pa.array(runs[hit]))
            yield from kept.to_batches()


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, links, root): links of each member by exact sets, and its component in the leaf."""
    for table in _groups(batches):
        m = Members(table)
        sets = [np.frombuffer(x, "<u8") for x in m.table["shingles"].to_pylist()]
        docs = m.table["n_docs"].to_numpy()
        node = m.table["node"].to_numpy()
        links, root = np.zeros(m.n, np.int64), np.arange(m.n)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        inside = _Intersections(m, sets)
        for u, v, _, _ in m.candidates(threshold - MARGIN):
            both = inside.of(u, v)
            size = inside.size[u] + inside.size[v] - both
            near = both >= threshold * size - 1e-9
            u, v = u[near], v[near]
            np.add.at(links, u, docs[v])
            np.add.at(links, v, docs[u])
            for i, j in zip(*_spanning(u, v, m.n)):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[hit]), pa.array(links[hit]), pa.array(node[[find(i) for i in hit.tolist()]])],
            names=["node", "links", "root"],
        )


def _spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Few enough edges for a loop: labels spread over the edges until they rest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved.tolist(), label[moved].tolist()


class _Intersections:
    """Sizes of intersections within groups: products of incidence rows for groups, over
    shingles that two members have at least."""

    def __init__(self, members: Members, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.group = np.repeat(np.arange(len(members.first)), members.size)
        self.first, self.count, self.sets = members.first, members.size, sets
        self.table = lru_cache(1)(self._of_group)

    def _of_group(self, g: int) -> np.ndarray:
        a, m = int(self.first[g]), int(self.count[g])
        values = np.concatenate(self.sets[a : a + m])
        row = np.repeat(np.arange(m), self.size[a : a + m])
        _, col, count = np.unique(values, return_inverse=True, return_counts=True)
        several = count > 1
        place = np.cumsum(several) - 1
        keep = several[col]
        row, col = row[keep], place[col[keep]]
        out = np.zeros((m, m), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        width = int(several.sum())
        step = max(1, min(width, (8 << 20) // m))
        for c in range(0, width, step):
            lo, hi = np.searchsorted(col, [c, c + step])
            part = np.zeros((m, step), np.float32)
            part[row[lo:hi], col[lo:hi] - c] = 1
            out += part @ part.T
        return out

    def of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(u), np.int64)
        group = self.group[u]
        for g in np.unique(group).tolist():
            mine = group == g
            table = self.table(g)
            out[mine] = np.rint(table[u[mine] - self.first[g], v[mine] - self.first[g]])
        return out


def _exact_sets(batches: Iterator[pa.RecordBatch], words: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, shingles) of the texts whose key may be wanted."""
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            hashes, offsets = shingles(part.column("text"), words)
            keys = set_keys(hashes, offsets)
            hit = np.flatnonzero(wanted[(keys[:, 0] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            hit = hit[np.diff(offsets)[hit] > 0]
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i].tobytes() for i in hit], pa.binary()),
                        pa.array([hashes[offsets[i] : offsets[i + 1]].tobytes() for i in hit], pa.binary()),
                    ],
                    names=["key", "shingles"],
                )


def _filter(keys: DataFrame) -> np.ndarray:
    """A table of 2^FILTER_BITS flags, of fixed size: which low bits of keys are wanted."""

    def low_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [int.from_bytes(k[:8], "little") & ((1 << FILTER_BITS) - 1) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32())], names=["low"])

    found = keys.select("key").mapInArrow(low_bits, "low int").distinct().toArrow()["low"].to_numpy()
    out = np.zeros(1 << FILTER_BITS, bool)
    out[found] = True
    return out


def similar_documents(
    docs: DataFrame, *, words: int = WORDS, threshold: float = THRESHOLD, target: float = TARGET, leaf: int = LEAF,
    block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, class_id (least id reachable by links), n_links, kept (it is its class_id).

    Two documents are linked if their sets of shingles have a Jaccard similarity of the
    threshold at least; a text of fewer words than a shingle is one shingle.  Null and
    empty texts, and texts of blanks, link with nothing and are their own class.
    Repeated rows link with each other.  A row without an id keeps a null id and is
    never the class_id; a class of only such rows has a null one.  Other columns are not
    read; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    runs = runs_at_least(threshold, target)
    sketched = read.mapInArrow(
        lambda b: _sketched(b, words, runs), "doc_id long, key binary, size int, small binary, roots array<long>"
    )
    sketched = store(sketched, "sketched")
    full = sketched.where("size > 0")
    classes = full.groupBy("key").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n_docs"), F.first("small").alias("small"), F.first("roots").alias("roots")
    )
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = classes.select("node", F.posexplode("roots").alias("run", "bucket"))
    leaves = store(_leaves(roots, classes, leaf, DEEPEST), "leaves")
    flagged, recall = _candidates(leaves, classes, runs, threshold, block)
    for _ in range(DOUBLINGS):
        if recall >= target:
            break
        first, runs = runs, 2 * runs
        more = read.select("text").mapInArrow(lambda b: _more_roots(b, words, first, runs), "key binary, roots array<long>")
        more = more.groupBy("key").agg(F.first("roots").alias("roots")).join(classes.select("key", "node"), "key")
        more = more.select("node", F.posexplode("roots").alias("run", "bucket")).withColumn("run", F.col("run") + first)
        leaves = store(leaves.unionByName(_leaves(more, classes, leaf, DEEPEST)), "leaves")
        flagged, recall = _candidates(leaves, classes, runs, threshold, block)
    if recall < target:  # whatever splits have lost: the first buckets whole
        leaves = store(_leaves(roots, classes, leaf, 0), "leaves")
        flagged, _ = _candidates(leaves, classes, runs, threshold, block)
    keys = flagged.select("node").distinct().join(classes.select("node", "key"), "node")
    keys = store(keys, "keys")
    wanted = spark.sparkContext.broadcast(_filter(keys))
    sets = read.select("text").mapInArrow(lambda b: _exact_sets(b, words, wanted.value), "key binary, shingles binary")
    sets = sets.groupBy("key").agg(F.first("shingles").alias("shingles")).join(keys, "key").drop("key")
    linked = _by_group(flagged.drop("pairs", "runs").join(sets, "node")).mapInArrow(
        lambda b: _linked(b, threshold), "node long, links long, root long"
    )
    linked = store(linked, "linked")
    wanted.destroy()
    discard(flagged)
    # of classes, only those of several texts or with links have more to say than their text's own id
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = links.join(components(linked, "node", "root"), "node")
    placed = classes.select("node", "key", "least", "n_docs").join(joined, "node", "left")
    placed = placed.where((F.col("n_docs") > 1) | F.col("links").isNotNull()).withColumn("root", F.coalesce("root", "node"))
    placed = store(placed, "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    n_links = (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    known = placed.join(least, "root").select("key", "class_id", n_links, F.lit(True).alias("known"))
    out = sketched.select("doc_id", "key").join(known, "key", "left")
    out = out.select(
        "doc_id", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def _candidates(leaves: DataFrame, classes: DataFrame, runs: int, threshold: float, block: int) -> tuple[DataFrame, float]:
    """(members with a candidate, estimated recall) of all leaves."""
    rows = _grouped(leaves, classes, block)
    flagged = store(
        _by_group(rows).mapInArrow(lambda b: _flagged(b, threshold), f"{MEMBER}, pairs long, runs long"), "flagged"
    )
    total = flagged.agg(F.sum("pairs").alias("pairs"), F.sum("runs").alias("runs")).first()
    return flagged, _recall(total.runs / total.pairs, runs) if total.pairs else 1.0


def _grouped(leaves: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Members with all their leaves and small sketches; those of large leaves once for each pair of blocks."""
    own = leaves.groupBy("node").agg(F.collect_list(F.struct("run", "bucket")).alias("leaves"))  # one a run at most
    about = own.join(classes.select("node", "n_docs", "small"), "node")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")
    rows = leaves.select("bucket", "run", "node", blocks.alias("blocks"), mine.alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("bucket", "run", "node", "block", other.alias("other"))
    rows = rows.select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "run", "node")
    return rows.join(about, "node").select("bucket", "a", "b", "block", "run", "node", "n_docs", "small", "leaves")


def _by_group(rows: DataFrame) -> DataFrame:
    keys = ["bucket", "a", "b"]
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _recall(mean_runs: float, runs: int) -> float:
    """1 - (1 - p)^runs, where found pairs were found in mean_runs runs on average: p from the
    mean of a binomial without its zeros, by bisection."""
    low, high = 1e-9, 1.0
    for _ in range(60):
        p = (low + high) / 2
        mean = runs * p / (1 - (1 - p) ** runs)
        low, high = (p, high) if mean < mean_runs else (low, p)
    return 1 - (1 - low) ** runs
