"""Candidate items of sessions: sources, expansion, trimming, collapse to (session, aid_next)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.config import TYPES, Config
from sessionloom.functions import least_of, share, whole

KNN = ("all", "1_2")


def candidate_pairs(items: DataFrame, pairs: DataFrame, knns: list[DataFrame]) -> DataFrame:
    """Distinct (aid, aid_next): each item of a session with itself, its co-visited items and its neighbours."""
    own = items.select("aid").distinct()
    parts = [own.select("aid", F.col("aid").alias("aid_next")), pairs.select("aid", "aid_next").join(own, "aid", "left_semi")]
    parts += [k.select("aid", "aid_next") for k in knns]
    return reduce(DataFrame.unionByName, parts).distinct()


def expanded(items: DataFrame, candidates: DataFrame, wide: DataFrame, knn_feats: list[DataFrame]) -> DataFrame:
    """(session, aid, aid_next) with item features and pair features; pairs are featured before they fan out."""
    keys = ["aid", "aid_next"]
    featured = candidates.join(wide, keys, "left")
    for k in knn_feats:
        featured = featured.join(k, keys, "left")
    return items.join(featured, "aid", "left")


def trimmed(rows: DataFrame, config: Config) -> DataFrame:
    """Fewer followers for items of little weight: an item of best order 1 keeps trim_first, one of
    trim_at_order or worse trim_least, and those between in proportion.  Itself always stays."""
    orders = ["rank_by_n_aid", "ts_order_aid", *(f"ts_order_aid_{t}" for t in TYPES)]
    best = least_of([F.col(c) for c in orders])
    per_order = (config.trim_first - config.trim_least) / (config.trim_at_order - 1)
    allowed = F.greatest(F.lit(float(config.trim_first)) - per_order * (best - 1), F.lit(float(config.trim_least)))
    co = least_of([F.col(f"{k}_rank") for k in config.co_events])
    near = least_of([F.col(f"rank_w2vec_{s}") for s in KNN])
    return rows.where((F.col("aid") == F.col("aid_next")) | (co <= allowed) | (near <= allowed))


def self_features(clean_self: bool) -> list[Column]:
    """What the candidate itself was to the session.

    A minimum is taken over all proposing items, where others count as 0; with
    clean_self only the candidate itself counts.
    """
    same = F.col("aid") == F.col("aid_next")

    def own(column: str) -> Column:
        value = F.col(column)
        if clean_self:
            return F.when(same, value)
        return F.when(same, value).when(value.isNotNull(), F.lit(0))

    sums = {"slf_n": "n_aid", **{f"slf_n_{t}": f"n_aid_{t}" for t in TYPES}, "slf_left_in_cart": "left_in_cart"}
    lasts = {"slf_max_ts": "max_ts_aid", **{f"slf_max_ts_{t}": f"max_ts_aid_{t}" for t in TYPES}}
    least = {
        "slf_rank_by_n": "rank_by_n_aid",
        **{f"slf_rank_by_n_{t}": f"rank_by_n_aid_{t}" for t in TYPES[1:]},
        "slf_ts_rel_pos_in_session": "ts_aid_rel_pos_in_session",
        "slf_ts_order": "ts_order_aid",
        "slf_ts_order_rel": "ts_order_aid_rel",
        **{f"slf_ts_order_{t}": f"ts_order_aid_{t}" for t in TYPES},
    }
    out = [F.count_if(same).alias("aid_next_is_aid")]
    out += [F.sum(F.when(same, F.col(c)).otherwise(0)).cast("long").alias(n) for n, c in sums.items()]
    out += [F.max(own(c)).alias(n) for n, c in lasts.items()]
    return out + [F.min(own(c)).alias(n) for n, c in least.items()]


def event_features() -> list[Column]:
    """The events of the items that propose a candidate."""
    out = [F.count("*").alias("n_uniq_aid")]
    out += [F.count_if(F.col(f"n_aid_{t}") > 0).alias(f"n_uniq_aid_{t}") for t in TYPES]
    for x in ("", *(f"_{t}" for t in TYPES)):
        out += [F.sum(f"n_aid{x}").alias(f"n_aid{x}"), F.max(f"max_ts_aid{x}").alias(f"max_ts_aid{x}")]
        out.append(F.min(f"ts_order_aid{x}").alias(f"ts_order_aid{x}"))
    out += [whole(F.avg(f"max_ts_aid{x}")).alias(f"mean_max_ts_aid{x}") for x in ("", "_orders")]
    out += [F.min(c).alias(c) for c in ("ts_order_aid_rel", "rank_by_n_aid")]
    return [*out, whole(F.avg("ts_aid_rel_pos_in_session")).alias("ts_aid_rel_pos_in_session")]


def co_features(config: Config) -> list[Column]:
    """Counts of co-events, and means of pair features weighted by them."""
    out = []
    for kind in config.co_events:
        count = F.col(f"{kind}_count")
        out.append(F.sum(count).alias(f"{kind}_count"))
        for f in ("count_pop", "perc_pop", "rank", "count_rel"):
            out.append(whole(share(F.sum(F.col(f"{kind}_{f}") * count), F.sum(count), 1.0)).alias(f"{kind}_{f}"))
    return out


def knn_features() -> list[Column]:
    out = []
    for s in KNN:
        dist, rank = F.col(f"dist_w2vec_{s}"), F.col(f"rank_w2vec_{s}")
        out += [
            F.count_if(rank > 0).alias(f"n_w2vec_{s}"),
            whole(F.avg(dist)).alias(f"dist_w2vec_{s}"),
            whole(F.avg(rank)).alias(f"rank_w2vec_{s}"),
            F.min(rank).alias(f"best_rank_w2vec_{s}"),
        ]
    return out


def collapsed(rows: DataFrame, config: Config, *, clean_self: bool = False) -> DataFrame:
    """(session, aid_next): all features aggregated over the proposing items, in one exchange."""
    features = [*self_features(clean_self), *event_features(), *co_features(config), *knn_features()]
    return rows.groupBy("session", "aid_next").agg(*features)
