"""Recall of submissions and of retrieved candidates; summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.config import TYPES, Config

DEPTHS = (("20", 20), ("100", 100), ("200", 200), ("all", None))


def _type_names() -> F.Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), F.col("type") + 1)


def weighted_recall(submitted: DataFrame, labels: DataFrame, config: Config) -> DataFrame:
    """type, recall for each type and, as `total`, their weighted sum.

    Recall is the number of hits over the number of labels, of which a session counts at most
    truth_cap; both tables are (session, type, aid).
    """
    both = (
        labels.select("session", "type", "aid", F.lit(1).alias("true"))
        .distinct()
        .join(submitted.select("session", "type", "aid", F.lit(1).alias("said")).distinct(), ["session", "type", "aid"], "full")
    )
    own = both.groupBy("session", "type").agg(
        F.count_if(F.col("true").isNotNull() & F.col("said").isNotNull()).alias("hits"),
        F.least(F.count("true"), F.lit(config.truth_cap)).alias("truth"),
    )
    own = own.withColumn("hits", F.least("hits", F.lit(config.truth_cap)))
    by_type = own.groupBy("type").agg(F.try_divide(F.sum("hits"), F.sum("truth")).alias("recall"))
    return _with_total(by_type, ["recall"], [], config)


def _with_total(by_type: DataFrame, measures: Sequence[str], keys: Sequence[str], config: Config) -> DataFrame:
    """A row per type, and one of sums weighted by type; one aggregation of an exploded table."""
    weight = F.element_at(F.array(*map(F.lit, config.type_weights)), F.col("type") + 1)
    single = F.struct(_type_names().alias("type"), F.lit(1.0).alias("w"))
    total = F.struct(F.lit("total").alias("type"), weight.alias("w"))
    each = by_type.select(*keys, *measures, F.explode(F.array(single, total)).alias("x"))
    return each.groupBy(*keys, F.col("x.type").alias("type")).agg(*(F.sum(F.col(m) * F.col("x.w")).alias(m) for m in measures))


def ndcg(ranked: DataFrame, labels: DataFrame, config: Config) -> DataFrame:
    """type, n_sessions and the mean NDCG at keep_top_k of sessions with labels of the type; ranked is
    (session, type, aid, pred_rank), ranks from 1."""
    k = config.keep_top_k
    truth = labels.select("session", "type", "aid").distinct()
    hits = ranked.where(F.col("pred_rank") <= k).join(truth, ["session", "type", "aid"])
    got = hits.groupBy("session", "type").agg(F.sum(1 / F.log2(F.col("pred_rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    best = truth.groupBy("session", "type").agg(F.count("*").alias("n")).select("session", "type", ideal.alias("ideal"))
    kinds = ranked.select("type").distinct()
    rated = best.join(kinds, "type").join(got, ["session", "type"], "left")
    each = rated.groupBy("type").agg(F.count("*").alias("n_sessions"), F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))
    return each.select(_type_names().alias("type"), "n_sessions", "ndcg")


def recall_ceiling(rows: DataFrame, labels: DataFrame, config: Config) -> DataFrame:
    """source, type and the recall of the first 20, 100, 200 and of all candidates, for each source
    and for each but src_any and src_self without the session's own items.

    Candidates stand by ts_order_aid, then id.  One scan: a row is exploded to its sources.
    """
    names = [c for c in rows.columns if c.startswith("src_")]
    cases = [F.when(F.col(c) == 1, F.lit(c)) for c in names]
    cases += [
        F.when((F.col(c) == 1) & (F.col("src_self") == 0), F.lit(f"{c} & not self_src")) for c in names if c not in ("src_any", "src_self")
    ]
    filters = [*names, *(f"{c} & not self_src" for c in names if c not in ("src_any", "src_self"))]
    each = rows.select("session", "aid_next", "ts_order_aid", F.explode(F.array_compact(F.array(*cases))).alias("source"))
    place = Window.partitionBy("source", "session").orderBy("ts_order_aid", "aid_next")
    placed = each.withColumn("place", F.row_number().over(place))
    truth = labels.select("session", "type", F.col("aid").alias("aid_next")).distinct()
    hits = placed.join(truth, ["session", "aid_next"])
    cap = config.keep_top_k
    per_session = hits.groupBy("source", "session", "type").agg(
        *(F.least(F.count_if(F.col("place") <= d) if d else F.count("*"), F.lit(cap)).alias(f"hits_{n}") for n, d in DEPTHS)
    )
    summed = per_session.groupBy("source", "type").agg(*(F.sum(f"hits_{n}").alias(f"hits_{n}") for n, _ in DEPTHS))
    per = truth.groupBy("session", "type").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    total = per.groupBy("type").agg(F.sum("n").alias("truth"))
    grid = total.select("type", "truth", F.explode(F.array(*map(F.lit, filters))).alias("source"))  # sources without hits too
    measures = [f"recall_{n}" for n, _ in DEPTHS]
    joined = grid.join(summed, ["source", "type"], "left")
    rated = joined.select(
        "source", "type", *(F.coalesce(F.try_divide(F.col(f"hits_{n}"), F.col("truth")), F.lit(0.0)).alias(f"recall_{n}") for n, _ in DEPTHS)
    )
    return _with_total(rated, measures, ["source"], config)


def describe(rows: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """A row per column: count, mean, std, min, percentiles (linear), max, NULLs and their share."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e"))
    points = F.percentile("e.x", F.array(*map(F.lit, percentiles)))
    stats = each.groupBy("e.column").agg(
        F.count("e.x").alias("count"), F.avg("e.x").alias("mean"), F.stddev("e.x").alias("std"), F.min("e.x").alias("min"),
        points.alias("p"), F.max("e.x").alias("max"), F.count_if(F.col("e.x").isNull()).alias("count_nan"), F.count("*").alias("n"),
    )
    named = [F.col("p")[i].alias(f"p{round(100 * q):d}") for i, q in enumerate(percentiles)]
    share = (F.col("count_nan") / F.col("n")).alias("share_nan")
    return stats.select("column", "count", "mean", "std", "min", *named, "max", "count_nan", share)


def candidate_counts(rows: DataFrame) -> DataFrame:
    """Summary of the number of candidates per session, for each source."""
    names = [c for c in rows.columns if c.startswith("src_")]
    return describe(rows.groupBy("session").agg(*(F.sum(c).alias(c) for c in names)), names)
