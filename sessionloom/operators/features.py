"""Features of (session, aid_next) after the collapse: recency, sources, popularity, NULLs, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.config import TYPES, Config
from sessionloom.functions import least_of, share, whole

EACH = ("", *(f"_{t}" for t in TYPES))


def recency(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Session stats joined, and times turned into differences and positions; raw times go."""
    joined = rows.join(stats, "session", "left")
    start, end = F.col("min_ts_session"), F.col("max_ts_session")

    def place(column: str):
        return whole(share(F.col(column) - start, end - start + 1, 1.0) * 100)

    new = {f"since_ts_aid{x}": end - F.col(f"max_ts_aid{x}") for x in EACH}
    new |= {f"slf_since_ts{x}": end - F.col(f"slf_max_ts{x}") for x in EACH}
    new |= {f"since_session_start_ts_aid{x}": F.col(f"max_ts_aid{x}") - start for x in ("", "_orders")}
    new |= {f"rel_pos_{c}_in_session": place(c) for c in ("max_ts_aid", "mean_max_ts_aid", "mean_max_ts_aid_orders")}
    raw = [f"{p}max_ts{m}{x}" for p, m in (("", "_aid"), ("slf_", "")) for x in EACH]
    raw += ["mean_max_ts_aid", "mean_max_ts_aid_orders", "min_ts_session", "max_ts_session"]
    return joined.withColumns(new).drop(*raw)


def sources(rows: DataFrame, config: Config) -> DataFrame:
    """Flags of where a candidate came from: a kind of co-event counts if the session has events
    of its first type among the proposing items."""
    flags = {"src_any": F.lit(True), "src_self": F.col("aid_next_is_aid") > 0}
    for name, k in config.co_events.items():
        flags[f"src_{name}"] = F.col(f"n_aid_{TYPES[k.first]}") * F.col(f"{name}_count") > 0
    flags |= {f"src_w2vec_{s}": F.col(f"n_w2vec_{s}") > 0 for s in ("all", "1_2")}
    return rows.withColumns({n: c.cast("int") for n, c in flags.items()}).drop("aid_next_is_aid")


def with_popular(rows: DataFrame, clusters: DataFrame, by_cluster: DataFrame, overall: DataFrame, config: Config) -> DataFrame:
    """Adds the popular items of a session's cluster, as new candidates too, and overall ranks."""
    known = clusters.select("session", F.col("cluster").cast("long").alias("cl"))
    joined = rows.join(known, "session", "left")
    ranks = [c for c in by_cluster.columns if c.startswith("rank_")]
    first = by_cluster.where(least_of([F.col(c) for c in ranks]) <= config.popular_keep)
    first = first.select("cl", F.col("aid").alias("aid_next"), *ranks)
    extra = joined.select("session", "cl").distinct().join(first, "cl")
    extra = extra.withColumn("src_pop_cl50", F.lit(1))
    merged = joined.drop("cl").join(extra.drop("cl"), ["session", "aid_next"], "full")
    general = overall.select(F.col("aid").alias("aid_next"), *(f"rank_{t}_cl1" for t in TYPES))
    return merged.join(general, "aid_next", "left")


def without_nulls(rows: DataFrame, config: Config) -> DataFrame:
    """Sources to 0 (src_any to 1), the order of items that are not in the session to no_order, the rest to -1."""
    out = {}
    for c in rows.columns:
        if c == "src_any":
            out[c] = F.lit(1)
        elif c.startswith("src_"):
            out[c] = F.coalesce(c, F.lit(0))
        elif c not in ("session", "aid_next"):
            out[c] = F.coalesce(c, F.lit(config.no_order if c == "ts_order_aid" else -1))
    return rows.withColumns(out)


def with_labels(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """target_{type}: 1 if the session has that label for the item, by one join for all types."""
    if labels is None:
        return rows
    wide = labels.groupBy("session", F.col("aid").alias("aid_next")).agg(
        *(F.max((F.col("type") == i).cast("int")).alias(f"target_{t}") for i, t in enumerate(TYPES))
    )
    return rows.join(wide, ["session", "aid_next"], "left").fillna(0, [f"target_{t}" for t in TYPES])
