"""What a session is, and what each of its items is to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.config import CARTS, CLICKS, ORDERS, TYPES, Config
from sessionloom.functions import any_of, sum_if


def session_stats(events: DataFrame) -> DataFrame:
    """A row per session: events, distinct items, events of each type, first and last time, duration, orders alone."""
    n = {t: F.count_if(F.col("type") == i) for i, t in enumerate(TYPES)}
    alone = (n["clicks"] == 0) & (n["carts"] == 0) & (n["orders"] > 0)
    return events.groupBy("session").agg(
        F.count("aid").alias("n_events_session"),
        F.count_distinct("aid").alias("n_aids_session"),
        *(c.alias(f"n_{t}_session") for t, c in n.items()),
        F.min("ts").alias("min_ts_session"),
        F.max("ts").alias("max_ts_session"),
        (F.max("ts") - F.min("ts")).alias("duration_session"),
        alone.cast("int").alias("only_orders_session"),
    )


def item_counts(events: DataFrame) -> DataFrame:
    """session, aid: number and last time of events, in all and by type, with the recency rank in each type."""
    typed = events.groupBy("session", "aid", "type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    recent = Window.partitionBy("session", "type").orderBy(F.desc("last"), "aid")
    typed = typed.withColumn("order", F.row_number().over(recent).cast("long"))
    by_type = []
    for i, t in enumerate(TYPES):
        mine = F.col("type") == i
        by_type += [
            sum_if(mine, F.col("n")).alias(f"n_aid_{t}"),
            F.max(F.when(mine, F.col("last"))).alias(f"max_ts_aid_{t}"),
            F.min(F.when(mine, F.col("order"))).alias(f"ts_order_aid_{t}"),
        ]
    return typed.groupBy("session", "aid").agg(F.sum("n").alias("n_aid"), F.max("last").alias("max_ts_aid"), *by_type)


def item_ranks(items: DataFrame) -> DataFrame:
    """Adds ranks by recency and frequency, relative positions and left_in_cart."""
    whole = Window.partitionBy("session")

    def ranked(column: str) -> F.Column:
        return F.row_number().over(whole.orderBy(F.desc(column), "aid")).cast("long")

    out = items.withColumns(
        {
            "ts_order_aid": ranked("max_ts_aid"),
            "rank_by_n_aid": ranked("n_aid"),
            "rank_by_n_aid_carts": ranked("n_aid_carts"),
            "rank_by_n_aid_orders": ranked("n_aid_orders"),
        }
    )
    first, last = F.min("max_ts_aid").over(whole), F.max("max_ts_aid").over(whole)
    ordered_later = (F.col("n_aid_carts") > 0) & (F.col("n_aid_orders") == 0)
    left = ordered_later | (F.col("max_ts_aid_carts") > F.col("max_ts_aid_orders"))
    length = F.greatest(last - first, F.lit(3600))
    return out.withColumns(
        {
            "ts_order_aid_rel": F.round(100.0 * F.col("ts_order_aid") / F.max("ts_order_aid").over(whole)).cast("long"),
            "ts_aid_rel_pos_in_session": F.round((last - F.col("max_ts_aid")) * 100.0 / length).cast("long"),
            "left_in_cart": F.coalesce(left.cast("int"), F.lit(0)),
        }
    )


def truncated(items: DataFrame, config: Config) -> DataFrame:
    """Items among the last of a type or the most frequent; the others of long sessions go."""
    recent = [F.col(f"ts_order_aid_{t}") <= config.last_events for t in TYPES]
    frequent = [F.col(f"rank_by_n_aid{x}") <= config.most_frequent for x in ("", "_carts", "_orders")]
    return items.where(any_of(recent + frequent))


def session_items(events: DataFrame, config: Config) -> DataFrame:
    return truncated(item_ranks(item_counts(events)), config)


def sentences(events: DataFrame, types: tuple[int, ...] = (CLICKS, CARTS, ORDERS)) -> DataFrame:
    """session, n_aid and its items as words, by time."""
    chosen = events.where(F.col("type").isin(*types))
    sorted_ = F.array_sort(F.collect_list(F.struct("ts", "aid", "type")))
    words = F.transform(sorted_, lambda x: x["aid"].cast("string"))
    return chosen.groupBy("session").agg(words.alias("sentence")).select("session", F.size("sentence").cast("long").alias("n_aid"), "sentence")
