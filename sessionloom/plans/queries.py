"""The queries over the given tables.  Each has SQL in `oracle` unless it fits a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import sources
from sessionloom.config import TYPES, Config
from sessionloom.operators import candidates as C
from sessionloom.operators import clusters, covisit, evaluation, features, ranking, sessions, vectors
from sessionloom.plans import recommend as R
from sessionloom.plans.stages import Tables

CONFIG = Config().with_min_count(1)
SMALL = dict(trees=5)  # in the queries that fit a ranker


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return sources.from_event_table(table(spark, d, "events"))


def counts(spark, d) -> DataFrame:
    return covisit.co_counts(events(spark, d), CONFIG)


def item_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("aid"), F.col("embedding").alias("vector"))


def seen_vectors(spark, d, types=(0, 1, 2)) -> DataFrame:
    seen = events(spark, d).where(F.col("type").isin(*types)).select("aid").distinct()
    return item_vectors(spark, d).join(seen, "aid", "left_semi")


def neighbours(spark, d, types=(0, 1, 2)) -> DataFrame:
    items = seen_vectors(spark, d, types)
    return vectors.knn_exact(items, items, CONFIG.knn)


def bought_neighbours(spark, d) -> DataFrame:
    """Neighbours in the catalogue of items that were carted or ordered."""
    return neighbours(spark, d, (1, 2))


def session_clusters(spark, d) -> DataFrame:
    return events(spark, d).select("session", (F.col("session") % 10).cast("int").alias("cluster")).distinct()


def labels(spark, d) -> DataFrame:
    return sources.split_at_midpoint(events(spark, d))[1]


def inputs(spark, d) -> R.Inputs:
    keep = Tables(spark)
    log = keep("events", lambda: events(spark, d))
    return R.Inputs(
        log, keep("counts", lambda: covisit.co_counts(log, CONFIG)), keep("neighbours_all", lambda: neighbours(spark, d)),
        keep("neighbours_buys", lambda: bought_neighbours(spark, d)), item_vectors(spark, d), session_clusters(spark, d),
        keep("labels", lambda: sources.split_at_midpoint(log)[1]), keep,
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    real = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*(F.round(c, digits).alias(c) if c in real else c for c in df.columns))


def co_visit_topn(spark, d):
    """The 20 items most often visited with each item."""
    all_kinds = covisit.event_pairs(events(spark, d), CONFIG).groupBy("aid", "aid_next").agg(F.count("*").alias("count"))
    top = covisit.top_pairs(all_kinds.withColumn("kind", F.lit("any")), 20)
    return top.select("aid", "aid_next", "count", "rank")


def self_merge_pairs(spark, d):
    return covisit.event_pairs(events(spark, d), CONFIG)


def co_counts_typed(spark, d):
    return covisit.typed_counts(covisit.event_pairs(events(spark, d), CONFIG), CONFIG)


def co_counts_per_split(spark, d):
    return covisit.co_counts_of_splits(list(sources.split_last_days(events(spark, d))), Config().with_min_count(2))


def train_test_split(spark, d):
    train, test = sources.split_last_days(events(spark, d))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def pair_features(spark, d):
    return covisit.pair_features(Tables(spark)("counts", lambda: counts(spark, d)), CONFIG)


def pair_features_wide(spark, d):
    return covisit.wide_features(pair_features(spark, d), CONFIG)


def pair_features_frequent(spark, d):
    """With the least counts of each kind."""
    return covisit.pair_features(Tables(spark)("counts", lambda: covisit.co_counts(events(spark, d), Config())), Config())


def session_stats(spark, d):
    return sessions.session_stats(events(spark, d))


def session_item_counts(spark, d):
    return sessions.item_counts(events(spark, d))


def session_item_ranks(spark, d):
    return sessions.item_ranks(sessions.item_counts(events(spark, d)))


def session_item_left_in_cart(spark, d):
    return session_item_ranks(spark, d).where("left_in_cart = 1").select("session", "aid", "left_in_cart")


def session_item_truncated(spark, d):
    from dataclasses import replace

    return sessions.session_items(events(spark, d), replace(CONFIG, last_events=3, most_frequent=2)).select("session", "aid")


def sentences(spark, d):
    rows = sessions.sentences(events(spark, d))
    return rows.select("session", "n_aid", F.array_join("sentence", " ").alias("sentence"))


def knn_exact(spark, d):
    return rounded(neighbours(spark, d))


def candidate_pairs_union(spark, d):
    items = sessions.session_items(events(spark, d), CONFIG)
    return C.candidate_pairs(items, pair_features(spark, d), [neighbours(spark, d), bought_neighbours(spark, d)])


def candidates_expanded(spark, d):
    return R.candidate_rows(inputs(spark, d), CONFIG)


def candidates_trimmed(spark, d):
    return C.trimmed(candidates_expanded(spark, d), CONFIG).select("session", "aid", "aid_next")


def _collapse(columns):
    def query(spark, d):
        rows = C.trimmed(candidates_expanded(spark, d), CONFIG)
        return rows.groupBy("session", "aid_next").agg(*columns())

    return query


def recency_feats(spark, d):
    x = inputs(spark, d)
    rows = features.recency(R.collapsed_rows(x, CONFIG), sessions.session_stats(x.events))
    names = [c for c in rows.columns if "since_" in c or c.startswith("rel_pos_")]
    return rows.select("session", "aid_next", *names)


def source_flags(spark, d):
    rows = R.sourced_rows(inputs(spark, d), CONFIG)
    return rows.select("session", "aid_next", *(c for c in rows.columns if c.startswith("src_")))


def cluster_popularity(spark, d):
    return clusters.popularity(events(spark, d), session_clusters(spark, d), CONFIG, name="cl50")


def general_popularity(spark, d):
    return clusters.popularity(events(spark, d), None, CONFIG, name="cl1", keep=False).drop("cl")


def popularity_candidates_outer(spark, d):
    rows = R.popular_rows(inputs(spark, d), CONFIG)
    names = [c for c in rows.columns if c.endswith(("_cl50", "_cl1"))]
    return rows.select("session", "aid_next", "n_aid", *names)


def session_embedding(spark, d):
    rows = vectors.session_vectors(events(spark, d), item_vectors(spark, d), CONFIG)
    return rows.select("session", F.posexplode("vector").alias("dim", "x")).select("session", "dim", "x")


def session_item_similarity(spark, d):
    pairs = events(spark, d).select("session", F.col("aid").alias("aid_next")).distinct()
    s = vectors.session_vectors(events(spark, d), item_vectors(spark, d), CONFIG)
    return rounded(vectors.similarity(pairs, s, item_vectors(spark, d)), 4)


def labels_join(spark, d):
    rows = events(spark, d).select("session", F.col("aid").alias("aid_next")).distinct()
    return features.with_labels(rows, labels(spark, d))


def null_policy(spark, d):
    return features.without_nulls(R.popular_rows(inputs(spark, d), CONFIG), CONFIG)


def features_full(spark, d):
    return rounded(R.feature_rows(inputs(spark, d), CONFIG), 4)


def labelled(spark, d) -> DataFrame:
    rows = R.sourced_rows(inputs(spark, d), CONFIG)
    return features.with_labels(rows.select("session", "aid_next", "n_aid", "ts_order_aid", *(c for c in rows.columns if c.startswith("src_"))), labels(spark, d))


def downsample_negatives(spark, d):
    from dataclasses import replace

    few = replace(CONFIG, negatives_per_positive=2, max_negatives=15)
    return ranking.downsample(labelled(spark, d), "carts", few).select("session", "aid_next", "target_carts")


def group_sizes(spark, d):
    return ranking.group_sizes(labelled(spark, d))


def simple_scores(spark, d) -> DataFrame:
    """A stand-in for a model's scores, which SQL can compute."""
    stats = sessions.item_counts(events(spark, d))
    score = F.round(F.col("n_aid") / (1 + F.col("aid") % 7), 6)
    return stats.select("session", F.col("aid").alias("aid_next"), score.alias("pred_score"))


def rank_topk(spark, d):
    return ranking.top_candidates(simple_scores(spark, d), 20)


def recommended(spark, d) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, range(len(TYPES))))).alias("type")
    return rank_topk(spark, d).select("session", "aid_next", "pred_score", kinds)


def submission_strings(spark, d):
    return ranking.submission(recommended(spark, d), 20)


def submission_parse(spark, d):
    return ranking.parse_submission(submission_strings(spark, d))


def recall_weighted(spark, d):
    return rounded(evaluation.weighted_recall(submission_parse(spark, d), labels(spark, d), CONFIG))


def recall_ceiling_by_source(spark, d):
    return rounded(evaluation.recall_ceiling(labelled(spark, d), labels(spark, d), CONFIG))


def candidate_count_describe(spark, d):
    return rounded(evaluation.candidate_counts(labelled(spark, d)), 4)


def basket_co_visit(spark, d):
    """Parts ordered together: pairs of one order, counted."""
    log = sources.from_baskets(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    pairs = covisit.event_pairs(log, CONFIG)
    counted = pairs.groupBy("aid", "aid_next").agg(F.count("*").alias("count"))
    top = covisit.top_pairs(counted.withColumn("kind", F.lit("any")), 20)
    return top.select("aid", "aid_next", "count", "rank")


def etl_sessions(spark, d):
    """Sessions nested to JSON text, and flattened back."""
    name = F.element_at(F.array(*map(F.lit, TYPES)), F.col("type") + 1)
    one = F.struct("aid", (F.col("ts") * 1000 + 999).alias("ts"), name.alias("type"))
    nested = events(spark, d).groupBy("session").agg(F.collect_list(one).alias("events"))
    text = nested.select(F.to_json(F.struct("session", "events")).alias("line"))
    return sources.flatten_sessions(text.select(F.from_json("line", sources.SESSION_LOG).alias("x")).select("x.*"))


def etl_labels(spark, d):
    """Labels nested to JSON text, a click as an id and others as lists, and flattened back."""
    each = labels(spark, d).groupBy("session").agg(
        F.max(F.when(F.col("type") == 0, F.col("aid"))).alias("clicks"),
        *(F.collect_list(F.when(F.col("type") == i, F.col("aid"))).alias(TYPES[i]) for i in (1, 2)),
    )
    text = each.select(F.to_json(F.struct("session", F.struct(*TYPES).alias("labels"))).alias("line"))
    return sources.flatten_labels(text.select(F.from_json("line", sources.LABEL_LOG).alias("x")).select("x.*"))


def word2vec_vectors(spark, d):
    model = vectors.fit_word2vec(sessions.sentences(events(spark, d)), CONFIG, vectorSize=16, minCount=2)
    return vectors.item_vectors(model)


def kmeans_sessions(spark, d):
    s = vectors.session_vectors(events(spark, d), item_vectors(spark, d), CONFIG)
    return clusters.cluster_sessions(s, CONFIG, k=5)


def _ivf(spark, d) -> DataFrame:
    from dataclasses import replace

    items = seen_vectors(spark, d)
    return vectors.knn_ivf(items, items, replace(CONFIG, ivf_cells=8))


def knn_ivf(spark, d):
    return rounded(_ivf(spark, d))


def knn_ivf_recall(spark, d):
    """Edges of the exact neighbours, and how many of them the inverted file finds."""
    found = _ivf(spark, d).select("aid", "aid_next", F.lit(1).alias("hit"))
    both = neighbours(spark, d).select("aid", "aid_next").join(found, ["aid", "aid_next"], "left")
    return both.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))


def frequent_item_neighbours(spark, d):
    """Neighbours among the most frequent items alone."""
    from dataclasses import replace

    return rounded(vectors.frequent_neighbours(events(spark, d), item_vectors(spark, d), replace(CONFIG, knn_items=40)))


def _numeric(spark, d) -> DataFrame:
    rows = features.without_nulls(R.popular_rows(inputs(spark, d), CONFIG), CONFIG)
    return features.with_labels(rows, labels(spark, d))


def ranker_scores(spark, d):
    rows = Tables(spark)("features", lambda: _numeric(spark, d))  # read by every tree and again for the scores
    trained = R.train(rows, ("carts",), CONFIG, **SMALL)
    return R.recommend(rows, trained, CONFIG)


def ranker_ndcg(spark, d):
    """NDCG of sessions that the ranker has not seen, by target."""
    rows = Tables(spark)("features", lambda: _numeric(spark, d))
    seen, unseen = ranking.split_sessions(rows, 0.3, CONFIG)
    trained = R.train(seen, ("carts",), CONFIG, **SMALL)
    best = R.recommend(unseen, trained, CONFIG)
    own = unseen.select("session").distinct()
    return evaluation.ndcg(best.select("session", "type", F.col("aid_next").alias("aid"), "pred_rank"), labels(spark, d).join(own, "session", "left_semi"), CONFIG)


def feature_importance(spark, d):
    rows = Tables(spark)("features", lambda: _numeric(spark, d))
    trained = R.train(rows, ("orders",), CONFIG, **SMALL)
    return ranking.feature_importance(spark, trained.models["orders"], trained.columns)


QUERIES = (
    co_visit_topn, self_merge_pairs, co_counts_typed, co_counts_per_split, train_test_split, pair_features,
    pair_features_wide, session_stats, session_item_counts, session_item_ranks, session_item_left_in_cart,
    session_item_truncated, sentences, knn_exact, candidate_pairs_union, candidates_expanded, candidates_trimmed,
    recency_feats, source_flags, cluster_popularity, general_popularity, popularity_candidates_outer,
    session_embedding, session_item_similarity, labels_join, null_policy, features_full, downsample_negatives,
    group_sizes, rank_topk, submission_strings, submission_parse, recall_weighted, recall_ceiling_by_source,
    candidate_count_describe, basket_co_visit, etl_sessions, etl_labels, word2vec_vectors, kmeans_sessions, knn_ivf,
    knn_ivf_recall, frequent_item_neighbours, pair_features_frequent,
    ranker_scores, ranker_ndcg, feature_importance,
)


def queries() -> dict:
    out = {q.__name__: q for q in QUERIES}
    out["session_next_self_feats"] = _collapse(lambda: C.self_features(False))
    out["session_next_event_feats"] = _collapse(C.event_features)
    out["session_next_co_feats"] = _collapse(lambda: C.co_features(CONFIG))
    out["session_next_knn_feats"] = _collapse(C.knn_features)
    return out
