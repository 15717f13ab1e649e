"""Exact top-k inner products by vector-approximation files.

Vectors are written in blocks of cells: one byte a component, of `CELLS` equal steps
between the block's smallest and largest value.  A first scan of the cells bounds every
score from both sides; a query's k-th highest lower bound over all blocks is its
threshold.  A second scan takes the candidates whose upper bound reaches it.  Exact
vectors are joined to candidates alone, in order of their bounds: first the 2k highest of
a query, and of the others those that its k-th exact score does not rule out.

Groups of query blocks meet groups of data blocks, some ten thousand rows each, so cells
are sent once for each QUERY_GROUP blocks of queries and never with their exact vectors.
That is the stated query set against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm._spark import partitions, ship, store

CELLS = 256
BLOCK, QUERY_BLOCK, GROUP, QUERY_GROUP = 4096, 1024, 16, 16
EXACT = 1 << 53  # scores up to here are exact in double precision
CELL_ROWS = "block long, dim int, n int, rows binary, low binary, step binary, cells binary"
QUERY_ROWS = "block long, dim int, n int, rows binary, exact binary, names array<long>"


def _pack(batches: Iterator[pa.RecordBatch], most: int, queries: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of `most` vectors of one length: cells, or the exact integers of queries."""
    held: dict[int, list] = {}
    made = 0

    def emit(dim: int) -> pa.RecordBatch:
        nonlocal made
        rows = held.pop(dim)
        own = np.array([r for r, _ in rows], "<i8")
        exact = np.array([v for _, v in rows], "<i8").reshape(len(rows), dim)
        block = (TaskContext.get().partitionId() << 32) + made
        made += 1
        parts = {"rows": own}
        if queries:
            parts["exact"] = exact
        else:
            low = exact.min(0).astype("<i8")
            step = np.maximum(1, -(-(exact.max(0) - low + 1) // CELLS)).astype("<i8")
            parts |= {"low": low, "step": step, "cells": ((exact - low) // step).astype(np.uint8)}
        columns = {"block": pa.array([block]), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(rows)], pa.int32())}
        columns |= {name: pa.array([x.tobytes()], pa.binary()) for name, x in parts.items()}
        if queries:
            columns["names"] = pa.array([own.tolist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    for batch in batches:
        for r, v in zip(batch.column("row").to_pylist(), batch.column("whole")):
            values = v.values.to_numpy(zero_copy_only=False)
            rows = held.setdefault(len(values), [])
            rows.append((r, values))
            if len(rows) >= most:
                yield emit(len(values))
    for dim in list(held):
        yield emit(dim)


def _matrix(data: bytes, kind: str, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, dim)


def _middle(query: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Scores with the middles of cells, and how far a query's exact scores may be from them."""
    low, step = np.frombuffer(row["low"], "<i8"), np.frombuffer(row["step"], "<i8")
    half = (step - 1) / 2
    middle = low + _matrix(row["cells"], "u1", row["n"], row["dim"]) * step + half
    return query @ middle.T, np.abs(query) @ half


def _no_self(scores: np.ndarray, row: dict, query: dict) -> None:
    """A query is not its own candidate: rows are told apart by number, not by id."""
    rows = np.frombuffer(row["rows"], "<i8")
    order = np.argsort(rows)
    wanted = np.frombuffer(query["rows"], "<i8")
    at = np.minimum(np.searchsorted(rows[order], wanted), len(rows) - 1)
    mine = np.flatnonzero(rows[order][at] == wanted)
    scores[mine, order[at[mine]]] = -np.inf


def _thresholds(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "bounds": []}
        data = left.to_pylist()
        for query in right.to_pylist():
            values = _matrix(query["exact"], "<i8", query["n"], query["dim"]).astype(float)
            best = np.zeros((query["n"], 0))
            for row in data:
                if row["dim"] == query["dim"]:
                    score, off = _middle(values, row)
                    score -= off[:, None]
                    _no_self(score, row, query)
                    best = _highest(np.hstack([best, score]), k)
            for name, found in zip(np.frombuffer(query["rows"], "<i8").tolist(), best):
                found = found[np.isfinite(found)]
                if len(found):
                    out["query"].append(name)
                    out["bounds"].append(found)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.list_(pa.float64())))], names=list(out))

    return run


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    return scores if scores.shape[1] <= k else -np.partition(-scores, k - 1, axis=1)[:, :k]


def _candidates(left: pa.Table, right: pa.Table) -> pa.Table:
    """(query, row, upper) of all whose upper bound reaches the query's threshold."""
    out = [pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query", "row", "upper"])]
    data = left.to_pylist()
    for query in right.to_pylist():
        values = _matrix(query["exact"], "<i8", query["n"], query["dim"]).astype(float)
        names = np.frombuffer(query["rows"], "<i8")
        known = {t["query"]: t["least"] for t in query["thresholds"] or ()}
        needed = np.array([known.get(x, -np.inf) for x in names.tolist()])
        for row in data:
            if row["dim"] != query["dim"]:
                continue
            upper, off = _middle(values, row)
            upper += off[:, None]
            _no_self(upper, row, query)
            q, r = np.nonzero((upper >= needed[:, None]) & np.isfinite(upper))
            rows = np.frombuffer(row["rows"], "<i8")
            out.append(pa.table([pa.array(names[q]), pa.array(rows[r]), pa.array(upper[q, r])], names=out[0].column_names))
    return pa.concat_tables(out)


def quantise(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and whole = floor(scale * x); without vectors that are null or hold nulls or no finite numbers."""
    x = F.col("x")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    return read.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~odd).select("vec_id", whole.alias("whole"))


def top_k(
    vectors: DataFrame, is_query, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k highest integer inner products of each query.

    `is_query` is a condition on the column named vec_id, as F.col or SQL text.  Ties go to smaller ids.  Vectors without an
    id, null ones and those that hold nulls, NaN or infinities take no part; vectors of
    another length than the query's are no candidates.  Rows with an id in common are
    separate: each such query row has its own k results and its twin as a candidate.
    Components so large that scores may pass 2^53 are an error.  No rows, or no query,
    give none.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = quantise(vectors, scale, id_col, vector_col)
    whole = store(whole.withColumn("row", F.monotonically_increasing_id()), "whole")
    largest = F.max(F.greatest(F.abs(F.array_max("whole")), F.abs(F.array_min("whole")))).alias("x")
    most = whole.where(F.size("whole") > 0).agg(largest, F.max(F.size("whole")).alias("dim")).first()
    if most.x is not None and most.dim * most.x**2 > EXACT:
        raise ValueError("components are too large for exact scores")
    data, n_data = _blocks(whole, BLOCK, False)
    queries, n_queries = _blocks(whole.where(is_query), QUERY_BLOCK, True)
    groups = max(-(-n_data // GROUP), min(n_data, partitions(spark)))
    asking = -(-n_queries // QUERY_GROUP)

    def dealt(blocks: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        """Each block once for every group of the other side."""
        each = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(n_own)).cast("int").alias(own), each)

    cells = dealt(data, "data", groups, "queries", asking).groupBy("queries", "data")
    asked = dealt(queries.drop("names"), "queries", asking, "data", groups).groupBy("queries", "data")
    first = cells.cogroup(asked).applyInArrow(_thresholds(k), "query long, bounds array<double>")
    best = F.sort_array(F.flatten(F.collect_list("bounds")), asc=False)
    least = F.coalesce(F.try_element_at(best, F.lit(k)), F.lit(float("-inf")))
    needed = store(first.groupBy("query").agg(least.alias("least")), "needed")
    names = queries.select("block", F.explode("names").alias("query"))
    told = names.join(needed, "query").groupBy("block").agg(F.collect_list(F.struct("query", "least")).alias("thresholds"))

    asked = dealt(queries.drop("names").join(told, "block", "left"), "queries", asking, "data", groups).groupBy("queries", "data")
    close = cells.cogroup(asked).applyInArrow(_candidates, "query long, row long, upper double")
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "row")
    close = store(close.withColumn("place", F.row_number().over(order)), "close")

    one = _scored(close.where(F.col("place") <= 2 * k), whole)
    high = F.sort_array(F.collect_list("score"), asc=False)
    kth = one.groupBy("query").agg(F.try_element_at(high, F.lit(k)).alias("kth"))
    open_ = close.where(F.col("place") > 2 * k).join(kth, "query").where(F.col("upper") >= F.col("kth"))
    found = one.unionByName(_scored(open_, whole))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _scored(close: DataFrame, whole: DataFrame) -> DataFrame:
    """Candidates with their exact scores."""
    q = whole.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("whole").alias("v"))
    both = close.select("query", "row").join(q, "query").join(whole, "row")
    score = F.aggregate(F.zip_with("v", "whole", lambda x, y: x * y), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return both.select("query", "query_id", "vec_id", score.alias("score"))


def _blocks(whole: DataFrame, most: int, queries: bool) -> tuple[DataFrame, int]:
    n = max(1, -(-whole.count() // most))
    kinds = QUERY_ROWS if queries else CELL_ROWS
    return store(whole.repartition(n).mapInArrow(lambda b: _pack(b, most, queries), kinds), "queries" if queries else "cells"), n
