"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct 3- to 5-byte grams of the lower-cased text, hashed to 2^20
buckets; presence counts, not frequency, so a long text weighs no more than a short one.
Fitting: (1) in how many training texts of either class each bucket occurs; (2) the
log-count ratio r of every bucket, and the buckets whose rates differ by more than
`Z_LEAST` standard errors; (3) a logistic regression with L2 penalty on features r,
by limited-memory BFGS.  A score is the model's probability of label 1.

The fit reads a bounded sample: up to SAMPLE_PER_CLASS labelled ids of each class by
hash order, one text each, weighted to the classes' shares among all labelled ids.  It
runs in tasks; the driver gets the chosen buckets and their weights alone.  Scoring
reads every text whole, WINDOW bytes at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm._bpe import text_buffers
from sessionloom.llm._spark import ship, slices, store

SAMPLE_PER_CLASS = 8000
BITS, ORDERS = 20, (3, 4, 5)
BLOCK, PART, WINDOW = 1 << 16, 1 << 20, 1 << 20
Z_LEAST, MOST_FEATURES, PENALTY, STEPS = 4.0, 4000, 1.0, 150
UNTAUGHT = 0.49  # the highest score of a model without features, which has no ground to call a text toxic


def lowered(column) -> pa.Array:
    """Lower case, each text between two spaces so that grams see where words end."""
    return pa.array([f" {x.lower()} " if x else "" for x in column.to_pylist()], pa.large_string())


def grams(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, bucket, text) of every gram of every text, order by order and window by window."""
    data, offsets = text_buffers(lowered(column))
    for begin in range(0, len(data), WINDOW):
        end = min(begin + WINDOW, len(data))
        seen = data[begin : end + max(ORDERS) - 1]
        text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(np.clip(offsets, begin, end)))
        left = offsets[1:][text] - np.arange(begin, end)
        value = np.zeros(end - begin, np.uint64)
        for n in range(1, min(max(ORDERS), len(seen)) + 1):
            have = min(end - begin, len(seen) - n + 1)
            value = value * np.uint64(0x100000001B3)
            value[:have] += seen[n - 1 : n - 1 + have] + np.uint64(1)
            if n in ORDERS:
                whole = left >= n
                mixed = value[whole] * np.uint64(0x9E3779B97F4A7C15)
                yield n, (mixed >> np.uint64(64 - BITS)).astype(np.int64), text[whole]


@dataclass(frozen=True)
class Model:
    """Weights of the chosen buckets (in ascending order), and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        return _table(self.buckets)


def _table(buckets: np.ndarray) -> np.ndarray:
    """The place of every bucket among the chosen ones, -1 for others."""
    out = np.full(1 << BITS, -1, np.int32)
    out[buckets] = np.arange(len(buckets))
    return out


def _constant(rate: float) -> Model:
    rate = min(rate, UNTAUGHT)
    return Model(np.zeros(0, np.int64), np.zeros(0), math.log(rate / (1 - rate)))


def present(column, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of the chosen buckets."""
    pairs = []
    for _, bucket, text in grams(column):
        feature = table[bucket]
        hit = feature >= 0
        pairs.append(np.unique(text[hit] * n + feature[hit]))
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return (both // n, both % n) if n else (both, both)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class the buckets occur: a row per block of buckets."""
    count = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for part in slices(batch, "text", PART):
            label = part.column("label").to_numpy(zero_copy_only=False)
            found: dict[int, list[np.ndarray]] = {n: [] for n in ORDERS}
            for n, bucket, text in grams(part.column("text")):
                found[n].append(np.unique((text << BITS) + bucket))
            for pairs in found.values():
                both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
                for c in (0, 1):
                    mine = label[both >> BITS] == c
                    count[c] += np.bincount(both[mine] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
    if count.any():
        rows = [
            {"block": b, "counts": pa.compress(count[:, b * BLOCK : (b + 1) * BLOCK].tobytes(), "zstd", asbytes=True)}
            for b in range((1 << BITS) // BLOCK)
        ]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("block", pa.int32()), ("counts", pa.binary())]))


def _chosen(texts: tuple[int, int]):
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets of a block whose rates differ, with their log-count ratios."""
        count, block = np.zeros((2, BLOCK), np.int64), 0
        for batch in group:
            for row in batch.to_pylist():
                block = row["block"]
                count += np.frombuffer(pa.decompress(row["counts"], 8 * BLOCK, "zstd", asbytes=True), np.int32).reshape(2, BLOCK)
        ratio = np.log((count[1] + 1) / (texts[1] + 2)) - np.log((count[0] + 1) / (texts[0] + 2))
        pooled = count.sum(0) / sum(texts)
        error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / texts[0] + 1 / texts[1]))
        z = np.where(count.sum(0) >= 5, np.abs(count[1] / texts[1] - count[0] / texts[0]) / error, 0)
        hit = np.flatnonzero(z > Z_LEAST)
        yield pa.RecordBatch.from_arrays(
            [pa.array((hit + block * BLOCK).astype(np.int32)), pa.array(z[hit]), pa.array(ratio[hit])], names=["bucket", "z", "ratio"]
        )

    return run


def _features(batches: Iterator[pa.RecordBatch], buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = _table(buckets)
    for batch in batches:
        for part in slices(batch, "text", PART):
            text, feature = present(part.column("text"), table, len(buckets))
            each = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(each), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], names=["doc_id", "label", "features"])


def _fitted(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, n: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """One row with the weights and the intercept, from the features of the whole sample."""
    rows = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.int32()))]))
    rows = rows.combine_chunks()
    label, lists = rows["label"].to_numpy(), rows["features"].combine_chunks()
    ends = lists.offsets.to_numpy()
    share = np.where(label == 1, n[1] / (label == 1).sum(), n[0] / (label == 0).sum())  # undoes the sample's shares
    w, b = _solve(lists.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends), label, share, ratio)
    yield pa.RecordBatch.from_arrays([pa.array([w * ratio], pa.list_(pa.float64())), pa.array([b])], names=["weights", "intercept"])


def _solve(col: np.ndarray, size: np.ndarray, label: np.ndarray, share: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with L2 penalty on features r[j] where present, by limited-memory BFGS;
    `col` has the features of all rows joined, `size` their number in each row."""
    n, m = len(size), len(r)
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    value = r[col]
    weight = share / share.mean()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, value * x[col], n) + x[m]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label)
        slope = np.append(np.bincount(col, value * error[row], m) + PENALTY * x[:m], error.sum())
        return float(weight @ (np.logaddexp(0, z) - label * z) + PENALTY / 2 * (x[:m] @ x[:m])), slope

    x = np.zeros(m + 1)
    now, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        way, kept = slope.copy(), []
        for s, y, rho in reversed(past):
            kept.append(rho * (s @ way))
            way -= kept[-1] * y
        if past:
            s, y, rho = past[-1]
            way /= rho * (y @ y)
        else:
            way /= max(1.0, float(np.linalg.norm(way)))
        for (s, y, rho), alpha in zip(past, reversed(kept)):
            way += (alpha - rho * (y @ way)) * s
        size_, new, new_slope = 1.0, now, slope
        while size_ > 1e-6:
            new, new_slope = loss(x - size_ * way)
            if new <= now - 1e-4 * size_ * (slope @ way):
                break
            size_ /= 2
        s, y = -size_ * way, new_slope - slope
        if now - new < 1e-7 * abs(now):
            break
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y, 1 / float(s @ y))]
        x, now, slope = x + s, new, new_slope
    return x[:m], float(x[m])


def fit(docs: DataFrame, labels: DataFrame, *, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The model of labelled texts; docs has doc_id and text, labels has doc_id and label (0 or 1).

    Rows with a null id or label are left out; a null text is empty.  Of several rows of
    one id the text of the least hash is read; repeated labels count once.  Without both
    classes, or where no gram tells them apart, the model is a constant: the rate of
    label 1, (n1 + 1) / (n + 2), but 0.49 at most.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    untaught = _constant((n.get(1, 0) + 1) / (sum(n.values()) + 2))
    if n.get(0, 0) == 0 or n.get(1, 0) == 0:
        return untaught
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.where(F.col("label") == c).orderBy(*order).limit(sample_per_class) for c in (0, 1)]
    sample = store(some[0].unionByName(some[1]), "sample")  # at most 2 x sample_per_class ids
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = read.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label")
    chosen = store(chosen.agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    texts = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(texts) < 2:
        return untaught
    counted = chosen.mapInArrow(_gram_counts, "block int, counts binary")
    found = counted.groupBy("block").applyInArrow(_chosen((texts[0], texts[1])), "bucket int, z double, ratio double")
    best = sorted(found.orderBy(F.desc("z"), "bucket").limit(MOST_FEATURES).select("bucket", "ratio").collect())
    if not best:
        return untaught
    buckets, ratio = np.array([x.bucket for x in best]), np.array([x.ratio for x in best])
    features = chosen.mapInArrow(lambda b: _features(b, buckets), "doc_id long, label int, features array<int>")
    whole = features.repartition(1).sortWithinPartitions("doc_id", "label")  # the bounded sample, in one task
    got = whole.mapInArrow(lambda b: _fitted(b, ratio, (n[0], n[1])), "weights array<double>, intercept double").first()
    return Model(buckets, np.array(got.weights), got.intercept)


def _scores(column, model: Model, table: np.ndarray) -> np.ndarray:
    text, feature = present(column, table, len(model.buckets))
    total = np.bincount(text, model.weights[feature], len(column)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document; null and empty texts have the intercept's score.

    No shuffle; repeated rows and null ids keep their rows; other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for part in slices(batch, "text", PART):
                found = _scores(part.column("text"), model, table)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return read.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below `least`."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for part in slices(batch, text_col, PART):
                yield part.filter(pa.array(_scores(part.column(text_col), model, table) < least))

    return docs.mapInArrow(run, docs.schema)
