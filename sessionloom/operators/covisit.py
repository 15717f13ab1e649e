"""Items visited together: event pairs, counts by kind of co-event, features of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.config import CoEvent, Config
from sessionloom.functions import share, whole


def event_pairs(events: DataFrame, config: Config) -> DataFrame:
    """Ordered pairs of different events of one session, at most max_time_to_next apart, either way.

    Repeated events count once.  Events differ if item, time or type does, so an item
    may be paired with itself.  One exchange: both sides are dealt by session.
    """
    once = events.select("session", "aid", "ts", "type").distinct().repartition("session")
    a = once.alias("a")
    b = once.select("session", *(F.col(c).alias(f"{c}_next") for c in ("aid", "ts", "type"))).alias("b")
    apart = F.col("ts_next") - F.col("ts")
    differ = (F.col("aid") != F.col("aid_next")) | (apart != 0) | (F.col("type") != F.col("type_next"))
    near = apart.between(-config.max_time_to_next, config.max_time_to_next)
    joined = a.join(b, (F.col("a.session") == F.col("b.session")) & near & differ)
    return joined.select("a.session", "aid", "ts", "type", "aid_next", "ts_next", "type_next", apart.alias("time_to_next"))


def is_kind(kind: CoEvent) -> F.Column:
    return (F.col("type") == kind.first) & F.col("type_next").isin(*kind.second) & (F.abs("time_to_next") <= kind.within)


def typed_counts(pairs: DataFrame, config: Config) -> DataFrame:
    """aid, aid_next and a count per kind, in one aggregation."""
    counts = [F.count_if(is_kind(k)).alias(name) for name, k in config.co_events.items()]
    return pairs.groupBy("aid", "aid_next").agg(*counts)


def long_counts(counts: DataFrame, config: Config) -> DataFrame:
    """kind, aid, aid_next, count for counts above 0."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("count")) for n in config.co_events))).alias("x")
    return counts.select("aid", "aid_next", each).select("x.kind", "aid", "aid_next", "x.count").where("count > 0")


def frequent(counts: DataFrame, config: Config) -> DataFrame:
    """Long counts that reach their kind's least count."""
    keep = F.lit(False)
    for name, k in config.co_events.items():
        keep = keep | ((F.col("kind") == name) & (F.col("count") >= k.min_count))
    return counts.where(keep)


def co_counts(events: DataFrame, config: Config) -> DataFrame:
    """kind, aid, aid_next, count over all events."""
    return frequent(long_counts(typed_counts(event_pairs(events, config), config), config), config)


def co_counts_of_splits(splits: list[DataFrame], config: Config) -> DataFrame:
    """The same, with the least counts applied in each split and again to the sums."""
    parts = [co_counts(s, config) for s in splits]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    total = both.groupBy("kind", "aid", "aid_next").agg(F.sum("count").alias("count"))
    return frequent(total, config)


def top_pairs(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent followers of each item, ties to smaller ids."""
    order = Window.partitionBy("kind", "aid").orderBy(F.desc("count"), "aid_next")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


BLOCK = 1024  # ids whose offsets are summed in one window


def _offsets(dealt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How many pairs of a kind stand before a count, before a block of items of a count, and before an item
    of a block, by falling count, then item.  No window holds a whole kind, or all items of a count."""
    per_item = dealt.groupBy("kind", "aid", "count").agg(F.count("*").alias("n"))
    per_item = per_item.withColumn("block", F.floor(F.col("aid") / BLOCK))
    per_block = per_item.groupBy("kind", "count", "block").agg(F.sum("n").alias("n"))
    per_count = per_block.groupBy("kind", "count").agg(F.sum("n").alias("n"))

    def before(name: str, own, order) -> F.Column:
        rows = own.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(rows), F.lit(0)).alias(name)

    return (
        per_count.select("kind", "count", before("before_count", Window.partitionBy("kind"), F.desc("count"))),
        per_block.select("kind", "count", "block", before("before_block", Window.partitionBy("kind", "count"), F.col("block"))),
        per_item.select("kind", "count", "block", "aid", before("before_item", Window.partitionBy("kind", "count", "block"), F.col("aid"))),
    )


def pair_features(counts: DataFrame, config: Config) -> DataFrame:
    """kind, aid, aid_next, count, count_pop, perc_pop, rank, count_rel of each item's first followers.

    perc_pop is the place of a pair in its kind by falling count, aid, aid_next.  One exchange
    by item serves the ranks, the first followers and the counts of items.
    """
    q = f"percentile_disc({config.top_quantile}) within group (order by count)"
    about = counts.groupBy("kind").agg(F.min("count").alias("low"), F.expr(q).cast("long").alias("high"), F.count("*").alias("n"))
    first_n = F.lit(0)
    for name, k in config.co_events.items():
        first_n = F.when(F.col("kind") == name, k.first_n).otherwise(first_n)
    dealt = counts.repartition("kind", "aid")
    item = Window.partitionBy("kind", "aid")
    ranked = dealt.withColumns(
        {
            "rank": F.row_number().over(item.orderBy(F.desc("count"), "aid_next")).cast("long"),
            "most": F.max("count").over(item),
        }
    )
    ranked = ranked.withColumn("place", F.col("rank") + 1 - F.min("rank").over(Window.partitionBy("kind", "aid", "count")))
    kept = ranked.where(F.col("rank") <= first_n).withColumn("block", F.floor(F.col("aid") / BLOCK))
    by_count, by_block, by_item = _offsets(dealt)
    placed = kept.join(by_item, ["kind", "count", "block", "aid"]).join(by_block, ["kind", "count", "block"])
    placed = placed.join(by_count, ["kind", "count"]).join(F.broadcast(about), "kind")  # a row per kind
    row = F.col("before_count") + F.col("before_block") + F.col("before_item") + F.col("place")
    above = share(F.col("count") - F.col("low"), F.col("high") - F.col("low"), 1.0)
    return placed.select(
        "kind", "aid", "aid_next", "count",
        F.when(F.col("high") > F.col("low"), whole(F.least(above, F.lit(1.0)) * 10_000)).alias("count_pop"),
        whole(row / F.col("n") * 10_000).alias("perc_pop"),
        "rank",
        whole(F.col("count") / F.col("most") * 100).alias("count_rel"),
    )


PAIR_FEATURES = ("count", "count_pop", "perc_pop", "rank", "count_rel")


def wide_features(features: DataFrame, config: Config) -> DataFrame:
    """One row per (aid, aid_next) with {kind}_{feature}: five joins become one."""
    columns = [
        F.max(F.when(F.col("kind") == name, F.col(f))).alias(f"{name}_{f}") for name in config.co_events for f in PAIR_FEATURES
    ]
    return features.groupBy("aid", "aid_next").agg(*columns)
