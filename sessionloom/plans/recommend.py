"""The whole recommender: features of candidates from events, pair counts, neighbours, clusters and vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.config import Config
from sessionloom.operators import candidates as C
from sessionloom.operators import clusters, covisit, features, ranking, sessions, vectors
from sessionloom.operators.evaluation import weighted_recall
from sessionloom.plans.stages import Tables, unwritten


@dataclass
class Inputs:
    """What the features are made of.  counts: kind, aid, aid_next, count; neighbours: aid, aid_next,
    dist, rank; item_vectors: aid, vector; session_clusters: session, cluster.  `keep`, a Tables,
    writes what several steps read."""

    events: DataFrame
    counts: DataFrame
    neighbours_all: DataFrame
    neighbours_buys: DataFrame
    item_vectors: DataFrame
    session_clusters: DataFrame
    labels: DataFrame | None = None
    keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = unwritten


def candidate_rows(x: Inputs, config: Config) -> DataFrame:
    """(session, aid, aid_next) with item and pair features, before trimming."""
    items = x.keep("session_items", lambda: sessions.session_items(x.events, config))
    pairs = x.keep("pair_features", lambda: covisit.pair_features(x.counts, config))
    knns = [vectors.knn_features(x.neighbours_all, "all"), vectors.knn_features(x.neighbours_buys, "1_2")]
    pool = C.candidate_pairs(items, pairs, knns)
    return C.expanded(items, pool, covisit.wide_features(pairs, config), knns)


def collapsed_rows(x: Inputs, config: Config) -> DataFrame:
    return x.keep("collapsed", lambda: C.collapsed(C.trimmed(candidate_rows(x, config), config), config))


def sourced_rows(x: Inputs, config: Config) -> DataFrame:
    return features.sources(features.recency(collapsed_rows(x, config), sessions.session_stats(x.events)), config)


def popular_rows(x: Inputs, config: Config) -> DataFrame:
    by_cluster = clusters.popularity(x.events, x.session_clusters, config, name="cl50")
    overall = clusters.popularity(x.events, None, config, name="cl1", keep=False)
    return features.with_popular(sourced_rows(x, config), x.session_clusters, by_cluster, overall, config)


def feature_rows(x: Inputs, config: Config) -> DataFrame:
    """All features, NULLs filled, with targets if there are labels."""
    filled = features.without_nulls(popular_rows(x, config), config)
    similar = vectors.similarity(filled, vectors.session_vectors(x.events, x.item_vectors, config), x.item_vectors)
    return features.with_labels(similar, x.labels)


@dataclass
class Trained:
    models: dict
    columns: list[str]


def train(rows: DataFrame, targets: tuple[str, ...], config: Config, **overrides) -> Trained:
    """A ranker for each target.  Its sample is written, as every tree reads it."""
    keep = Tables(rows.sparkSession)
    models = {}
    for t in targets:
        sample = keep(f"sample_{t}", lambda: ranking.downsample(rows, t, config))
        models[t] = ranking.fit_ranker(sample, t, config, **overrides)
    return Trained(models, ranking.feature_columns(rows))


def recommend(rows: DataFrame, trained: Trained, config: Config) -> DataFrame:
    """(session, type, aid_next, pred_score, pred_rank): the best candidates for each target."""
    from sessionloom.config import TYPES

    out = None
    for target, model in trained.models.items():
        best = ranking.top_candidates(ranking.scores(rows, model, trained.columns), config.keep_top_k)
        best = best.withColumn("type", F.lit(TYPES.index(target)))
        out = best if out is None else out.unionByName(best)
    return out


def evaluate(recommended: DataFrame, labels: DataFrame, config: Config) -> DataFrame:
    submitted = ranking.parse_submission(ranking.submission(recommended, config.keep_top_k))
    return weighted_recall(submitted, labels, config)
