"""Near-duplicate vectors by NN-descent.

1.  Equal vectors of a label form a class; one of each takes part.
2.  First lists: TABLES random hyperplane codes split every label into cells of about
    CELL vectors; a vector keeps its NEIGHBOURS best of its cells.
3.  Refinement: each vector brings its neighbours and those that list it together; the
    pairs that enter a list better than its last are kept, until few lists change.
4.  Links are the lists' pairs at the threshold.  A vector whose last neighbour is still
    within it has a saturated list.  Such vectors search again, now only outside their
    connected component, and those whose new lists are saturated once more outside the
    grown component, until none is or no link is new.
5.  Audit: sampled vectors are compared with all of their label, a chunk of the corpus
    after another until ENOUGH of those with links lie in components of at most k, or
    all are compared.  Each vector counts once, in components of at most k and in
    larger ones apart; if either mean share of connected links is below RECALL, further
    tables and rounds follow, and after MOST_AUDITS all vectors of a label are compared.
6.  The members of a component are compared in blocks, exactly and in double precision.
    Blocks give counts, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm._components import components
from sessionloom.llm._spark import partitions, ship, store

THRESHOLD, NEIGHBOURS, TABLES, CELL = 0.93, 10, 6, 32
SETTLED = 0.02
AUDIT, MOST_AUDITED, ENOUGH, RECALL, MOST_AUDITS = 256, 8192, 100, 0.99, 4
BLOCK = 512
SLACK = 1e-4  # lists hold single precision
LISTS = "node long, other long, cosine float"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, unit) with unit null where a vector links with nothing."""
    for batch in batches:
        units = []
        for v, label in zip(batch.column("vector"), batch.column("label")):
            unit = None
            if v.is_valid and label.is_valid and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(float)
                if len(x) and np.isfinite(x).all():
                    scale = np.abs(x).max()
                    if scale > 0:  # scaled first, so that squares neither vanish nor overflow
                        x = x / scale
                        unit = (x / math.sqrt(x @ x)).astype("<f8").tobytes()
            units.append(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"]
        )


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(k).to_numpy() for k in keys])
        if last is not None and tuple(ids[:, 0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = tuple(ids[:, -1])
    if held:
        yield pa.Table.from_batches(held)


def _each_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    for table in _groups(batches, keys):
        ids = np.stack([table[k].to_numpy() for k in keys])
        cuts = np.flatnonzero(np.append(True, (ids[:, 1:] != ids[:, :-1]).any(0))).tolist() + [table.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)


def _codes(batches: Iterator[pa.RecordBatch], first: int, last: int) -> Iterator[pa.RecordBatch]:
    """(label, table, code, node, group, unit): a vector's cells."""
    for batch in batches:
        units = batch.column("unit").to_pylist()
        size = np.fromiter(map(len, units), np.int64, len(units))
        labels, bits = batch.column("label").to_numpy(), batch.column("bits").to_numpy()
        for dim in np.unique(size).tolist():
            mine = np.flatnonzero(size == dim)
            x = np.frombuffer(b"".join(units[i] for i in mine), "<f4").reshape(len(mine), -1)
            width = bits[mine]
            for t in range(first, last):
                planes = np.random.default_rng([t, x.shape[1]]).standard_normal((x.shape[1], 30)).astype(np.float32)
                sides = (x @ planes > 0).astype(np.int64)
                sides *= np.arange(30) < width[:, None]
                code = sides @ (np.int64(1) << np.arange(30, dtype=np.int64)) * 4096 + dim % 4096
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[mine]), pa.array(np.full(len(mine), t, np.int32)), pa.array(code), *(batch.column(c).take(pa.array(mine)) for c in ("node", "group", "unit"))],
                    names=["label", "table", "code", "node", "group", "unit"],
                )


def _matrix(table: pa.Table, kind: str = "<f4") -> np.ndarray:
    return np.frombuffer(b"".join(table["unit"].to_pylist()), kind).reshape(table.num_rows, -1)


def _best_of_cells(batches: Iterator[pa.RecordBatch], keys: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each member of a cell among those of other groups."""
    for cell in _each_group(batches, keys):
        m = cell.num_rows
        if m < 2:
            continue
        x, node, own = _matrix(cell), cell["node"].to_numpy(), cell["group"].to_numpy()
        cosine = x @ x.T
        cosine[own[:, None] == own[None, :]] = -2
        n = min(k, m - 1)
        best = np.argpartition(-cosine, n - 1, axis=1)[:, :n] if n < m - 1 else np.argsort(-cosine, axis=1)[:, :n]
        found = np.take_along_axis(cosine, best, 1).ravel()
        apart = found > -2
        yield _list_rows(np.repeat(node, n)[apart], node[best].ravel()[apart], found[apart])


def _list_rows(node: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(node), pa.array(other), pa.array(cosine.astype(np.float32))], names=["node", "other", "cosine"]
    )


def _top(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best distinct neighbours of each node, from rows sorted by node."""
    for table in _groups(batches, ["node"]):
        node, other, cosine = (table[c].to_numpy() for c in ("node", "other", "cosine"))
        order = np.lexsort((-cosine, other, node))
        node, other, cosine = node[order], other[order], cosine[order]
        new = np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1]))
        node, other, cosine = node[new], other[new], cosine[new]
        order = np.lexsort((other, -cosine, node))
        node, other, cosine = node[order], other[order], cosine[order]
        first = np.append(True, node[1:] != node[:-1])
        at = np.arange(len(node))
        keep = at - np.maximum.accumulate(np.where(first, at, 0)) < k
        yield _list_rows(node[keep], other[keep], cosine[keep])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a node's companions, of different groups, that beat the last of either's list."""
    for group in _each_group(batches, ["centre", "block"]):
        if group.num_rows < 2:
            continue
        x, node, last = _matrix(group), group["node"].to_numpy(), group["last"].to_numpy()
        own = group["group"].to_numpy()
        cosine = x @ x.T
        cosine[own[:, None] == own[None, :]] = -3
        a, b = np.nonzero(cosine > last[:, None])
        if len(a):
            yield _list_rows(node[a], node[b], cosine[a, b])


def _lists(rows: DataFrame, k: int) -> DataFrame:
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "node").sortWithinPartitions("node").mapInArrow(lambda b: _top(b, k), LISTS)


def _first_lists(vectors: DataFrame, first: int, last: int, k: int) -> DataFrame:
    bits = F.round(F.log2(F.count("*") / CELL)).cast("int")
    counts = vectors.groupBy("label").agg(F.least(F.greatest(bits, F.lit(0)), F.lit(30)).alias("bits"))
    cells = vectors.join(counts, "label").select("label", "bits", "node", "group", "unit").mapInArrow(
        lambda b: _codes(b, first, last), "label long, table int, code long, node long, group long, unit binary"
    )
    cells = store(cells, "cells")
    keys = ["label", "table", "code"]
    size = cells.groupBy(*keys).agg(F.ceil(F.count("*") / (4 * CELL)).cast("int").alias("parts"))
    # a crowded cell is dealt into parts; the rounds and the components join them again
    dealt = cells.join(size, keys).withColumn("part", F.pmod(F.xxhash64("node", "table"), F.col("parts")).cast("int"))
    keys = [*keys, "part"]
    dealt = dealt.select(*keys, "node", "group", "unit").repartition(partitions(vectors.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda b: _best_of_cells(b, keys, k), LISTS)


def _refined(lists: DataFrame, vectors: DataFrame, known: DataFrame | None, k: int, salt: int) -> DataFrame:
    last = lists.groupBy("node").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(F.lit(-2.0).cast("float")).alias("last"))
    near = lists if known is None else lists.unionByName(known)  # those of its own group lead a vector outside, too
    both = near.select(F.col("node").alias("centre"), F.col("other").alias("node"))
    both = both.unionByName(near.select(F.col("other").alias("centre"), "node")).distinct()
    # those who list a much listed vector meet in blocks, dealt anew each round
    listed = both.groupBy("centre").agg(F.ceil(F.count("*") / (6 * k)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", "centre", F.lit(salt)), F.col("blocks")).cast("int").alias("block")
    members = both.join(listed, "centre").select("centre", block, "node")
    members = members.join(vectors.select("node", "group", "unit").join(last, "node", "left"), "node")
    keys = ["centre", "block"]
    members = members.withColumn("last", F.coalesce("last", F.lit(-2.0).cast("float")))
    dealt = members.select("centre", "block", "node", "group", "unit", "last")
    dealt = dealt.repartition(partitions(lists.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_joined, LISTS)


def _audited(batches: Iterator[pa.RecordBatch], sample: list, threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, other): the links of sampled vectors, by comparison with all."""
    nodes = np.array([s[0] for s in sample])
    labels = np.array([s[1] for s in sample])
    for batch in batches:
        units, node, label = batch.column("unit").to_pylist(), batch.column("node").to_numpy(), batch.column("label").to_numpy()
        size = np.fromiter(map(len, units), np.int64, len(units))
        for dim in {len(s[2]) for s in sample}:
            mine, asked = np.flatnonzero(size == dim), np.flatnonzero([len(s[2]) == dim for s in sample])
            if not len(mine):
                continue
            x = np.frombuffer(b"".join(units[i] for i in mine), "<f4").reshape(len(mine), -1)
            q = np.frombuffer(b"".join(bytes(sample[i][2]) for i in asked), "<f4").reshape(len(asked), -1)
            hit = (q @ x.T >= threshold) & (labels[asked][:, None] == label[mine][None, :])
            hit &= nodes[asked][:, None] != node[mine][None, :]
            a, b = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[asked][a]), pa.array(node[mine][b])], names=["node", "other"])


def _descended(
    vectors: DataFrame, lists: DataFrame | None, known: DataFrame | None, first: int, tables: int, k: int
) -> DataFrame:
    """Lists of the k best of other groups, from further tables and from rounds until few entries are new."""
    more = _first_lists(vectors, first, first + tables, k)
    lists = store(_lists(more if lists is None else lists.unionByName(more), k), "lists")
    r = 0
    while True:
        better = store(_refined(lists, vectors, known, k, first + r), "better")
        now = store(_lists(lists.unionByName(better), k), "lists")
        changed = now.join(lists.select("node", "other"), ["node", "other"], "left_anti").count()
        lists, r = now, r + 1
        if changed <= SETTLED * lists.count():
            return lists


def _roots(close: DataFrame) -> DataFrame:
    return store(components(close, "node", "other"), "roots")


def _linked_outside(
    single: DataFrame, lists: DataFrame, close: DataFrame, first: int, tables: int, k: int, threshold: float
) -> tuple[DataFrame, DataFrame]:
    """(links, components): with the links that saturated lists have no room for, as far as they join components."""
    roots, known = _roots(close), lists
    while True:
        full = lists.groupBy("node").agg(F.count("*").alias("n"), F.min("cosine").alias("last"))
        full = full.where((F.col("n") >= k) & (F.col("last") >= threshold - SLACK)).select("node")
        part = single.join(full, "node").join(roots.select("node", F.col("root").alias("group")), "node")
        part = store(part.select("node", "label", "group", "unit"), "saturated")
        several = part.groupBy("label").agg(F.count_distinct("group").alias("n")).where("n > 1").select("label")
        part = part.join(several, "label", "left_semi")
        if part.isEmpty():
            return close, roots
        lists = _descended(part, None, known.join(part.select("node"), "node", "left_semi"), first, tables, k)
        found = lists.where(F.col("cosine") >= threshold - SLACK)
        if found.isEmpty():
            return close, roots
        first += tables
        close = store(close.unionByName(found.select("node", "other")), "close")
        known = known.unionByName(lists)
        roots = _roots(close)


def _recall(single: DataFrame, roots: DataFrame, threshold: float, k: int) -> tuple[float, DataFrame | None]:
    """(mean share of a vector's links that are connected, the least of small and large components; links that are not)."""
    n, whole = single.count(), 1 << 30
    size = roots.groupBy("root").agg(F.count("*").alias("size"))
    a = roots.toDF("node", "root_a").join(size.toDF("root_a", "size"), "root_a")
    b = roots.toDF("other", "root_b")
    seen, share = {True: 0, False: 0}, {True: 0.0, False: 0.0}
    missed, low, wanted = None, 0, AUDIT
    place = F.pmod(F.xxhash64("node"), F.lit(whole))
    while low < whole and seen[True] < ENOUGH:
        high = min(whole, low + math.ceil(whole * wanted / max(n, 1)))
        chosen = single.where((place >= low) & (place < high)).select("node", "label", "unit").collect()
        sample = [(r.node, r.label, r.unit) for r in chosen]
        near = single.select("node", "label", "unit").mapInArrow(lambda x: _audited(x, sample, threshold), "node long, other long")
        found = near.join(a, "node", "left").join(b, "other", "left")
        found = found.withColumn("hit", F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False)))
        each = found.groupBy("node").agg(
            F.avg(F.col("hit").cast("double")).alias("share"), F.coalesce(F.first("size") <= k, F.lit(True)).alias("small")
        )
        bad = False
        for r in each.groupBy("small").agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.min("share").alias("least")).collect():
            seen[r.small] += r.n
            share[r.small] += r.share
            bad |= r.least < 1
        if bad:
            more = store(found.where("not hit").select("node", "other"), "missed")
            missed = more if missed is None else missed.unionByName(more)
        low, wanted = high, min(2 * wanted, MOST_AUDITED)
    if low >= whole:  # every vector was compared with all
        return 1.0, missed
    return min(share[s] / seen[s] for s in seen if seen[s]), missed


def _counted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, links, root) of members of two blocks of a component."""
    for group in _each_group(batches, ["component", "a", "b"]):
        x, node, n = _matrix(group, "<f8"), group["node"].to_numpy(), group["n"].to_numpy()
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if group["a"][0] != group["b"][0]:
            block = group["part"].to_numpy()
            near &= block[:, None] != block[None, :]
        links = near @ n
        label = np.arange(len(node))
        while True:  # least label among neighbours, until they rest
            low = np.minimum(label, np.where(near, label[None, :], len(node)).min(1))
            low = np.minimum(low, low[low])
            if (low == label).all():
                break
            label = low
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(node[label[hit]])],
            names=["node", "links", "root"],
        )


def similar_vectors(
    vectors: DataFrame, *, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, tables: int = TABLES,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id (least id reachable) and kept (it is its own component_id).

    Only vectors of one label and one length are compared.  Vectors that are null, empty,
    zero or hold nulls or no finite numbers, and those without a label, link with nothing.
    Equal and repeated rows link with each other.  A null id is never a component_id.
    Other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    ship(spark)
    read = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")
    )
    rows = read.mapInArrow(_units, "vec_id long, label long, unit binary").withColumn("key", F.md5("unit"))
    rows = store(rows, "units")
    classes = rows.where("unit is not null").groupBy("label", "key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("unit").alias("exact")
    )
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    single = classes.select("node", "label", "exact").mapInArrow(_single, "node long, label long, unit binary")
    single = store(single, "single")
    k, lists, first = neighbours, None, 0
    more = None  # links that the lists of earlier audits had not
    each = single.withColumn("group", F.col("node"))
    for _ in range(MOST_AUDITS):
        lists = _descended(each, lists, None, first, tables, k)
        first += tables
        close = lists.where(F.col("cosine") >= threshold - SLACK).select("node", "other")
        close = close if more is None else close.unionByName(more)
        more, roots = _linked_outside(single, lists, close, first, tables, k, threshold)
        recall, missed = _recall(single, roots, threshold, k)
        if missed is not None:
            more = more.unionByName(missed)
            roots = _roots(more)
        if recall >= RECALL:
            break
    else:
        all_ = single.select("node", "label", F.octet_length("unit").alias("length"))
        kind = all_.groupBy("label", "length").agg(F.min("node").alias("root"))
        roots = store(all_.join(kind, ["label", "length"]).select("node", "root"), "roots")
    linked = store(_exact_links(roots, classes, threshold), "linked")
    final = components(linked, "node", "root")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.select("label", "key", "node", "least", "n").join(links, "node", "left").join(final, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "root").select(
        "label", "key", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = rows.where("unit is not null").join(known, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.unionByName(alone).withColumn("kept", kept)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [np.frombuffer(x, "<f8").astype("<f4").tobytes() for x in batch.column("exact").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("label"), pa.array(units, pa.binary())], names=["node", "label", "unit"]
        )


def _exact_links(roots: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) by comparing the members of each component in blocks."""
    parts = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = roots.join(parts, "root").join(classes.select("node", "n", F.col("exact").alias("unit")), "node")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    dealt = placed.select(F.col("root").alias("component"), part, "parts", "node", "n", "unit")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("component", "part", other, "node", "n", "unit")
    dealt = dealt.select("component", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "node", "n", "unit")
    keys = ["component", "a", "b"]
    dealt = dealt.repartition(partitions(roots.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda b: _counted(b, threshold), "node long, links long, root long")
