"""Hand-made rows for what the given tables do not hold."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sessionloom import sources
from sessionloom.config import Config
from sessionloom.operators import candidates as C
from sessionloom.operators import clusters, covisit, evaluation, features, ranking, sessions, vectors

ONE = Config().with_min_count(1)
LOG = "session long, aid long, ts long, type int"


def log(spark, *rows):
    return spark.createDataFrame(rows, LOG)


def counted(df, *keys):
    return {tuple(r[k] for k in keys): r["count"] for r in df.collect()}


def test_repeated_events_count_once_and_an_item_pairs_with_itself(spark):
    events = log(spark, (1, 10, 0, 0), (1, 11, 60, 0), (1, 10, 120, 0), (1, 10, 120, 0))
    got = counted(covisit.co_counts(events, ONE).where("kind = 'click_to_click'"), "aid", "aid_next")
    assert got == {(10, 10): 2, (10, 11): 2, (11, 10): 2}


def test_windows_are_inclusive(spark):
    clicks = log(spark, (1, 1, 0, 0), (1, 2, 43_200, 0), (2, 1, 0, 0), (2, 3, 43_201, 0))
    got = counted(covisit.co_counts(clicks, ONE).where("kind = 'click_to_click'"), "aid", "aid_next")
    assert set(got) == {(1, 2), (2, 1)}
    carts = log(spark, (1, 1, 0, 1), (1, 2, 86_400, 1), (2, 1, 0, 1), (2, 3, 86_401, 1))
    got = counted(covisit.co_counts(carts, ONE).where("kind = 'cart_to_cart'"), "aid", "aid_next")
    assert set(got) == {(1, 2), (2, 1)}


def test_least_counts_apply_per_split_or_to_all(spark):
    a, b = log(spark, (1, 1, 0, 1), (1, 2, 1, 1)), log(spark, (2, 1, 0, 1), (2, 2, 1, 1))
    two = Config().with_min_count(2)
    assert covisit.co_counts(a.unionByName(b), two).count() == 2
    assert covisit.co_counts_of_splits([a, b], two).count() == 0


def test_pair_features_of_ties_and_of_one_count(spark):
    rows = [("cart_to_cart", 1, n, c) for n, c in ((5, 5), (4, 5), (3, 3), (2, 1))]
    counts = spark.createDataFrame(rows + [("buy_to_buy", 1, 2, 7)], "kind string, aid long, aid_next long, count long")
    got = {(r.kind, r.aid_next): r for r in covisit.pair_features(counts, ONE).collect()}
    assert [got["cart_to_cart", n]["rank"] for n in (4, 5, 3, 2)] == [1, 2, 3, 4]
    assert [got["cart_to_cart", n].count_pop for n in (4, 5, 3, 2)] == [10_000, 10_000, 5_000, 0]
    assert [got["cart_to_cart", n].perc_pop for n in (4, 5, 3, 2)] == [2_500, 5_000, 7_500, 10_000]
    assert [got["cart_to_cart", n].count_rel for n in (4, 3, 2)] == [100, 60, 20]
    assert got["buy_to_buy", 2].count_pop is None


def test_left_in_cart_and_only_orders(spark):
    events = log(
        spark, (1, 1, 0, 0), (1, 1, 5, 1), (1, 2, 0, 0), (1, 2, 1, 1), (1, 2, 2, 2), (1, 3, 3, 2), (1, 4, 1, 2), (1, 4, 9, 1), (2, 9, 0, 2)
    )
    items = {(r.session, r.aid): r for r in sessions.session_items(events, ONE).collect()}
    assert {k: r.left_in_cart for k, r in items.items()} == {(1, 1): 1, (1, 2): 0, (1, 3): 0, (1, 4): 1, (2, 9): 0}
    stats = {r.session: r for r in sessions.session_stats(events).collect()}
    assert (stats[1].only_orders_session, stats[2].only_orders_session) == (0, 1)
    assert stats[2].duration_session == 0


def test_trim_by_order(spark):
    names = {f"{k}_rank": None for k in ONE.co_events} | {"rank_w2vec_all": None, "rank_w2vec_1_2": None}
    rows = []
    for order in (1, 20, 40):
        rows += [(order, order, 100 + r, order, r) for r in range(1, 26)]
    df = spark.createDataFrame(rows, "session long, aid long, aid_next long, best long, click_to_click_rank long")
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("long"))
    for n in ("rank_by_n_aid", "ts_order_aid", "ts_order_aid_clicks", "ts_order_aid_carts", "ts_order_aid_orders"):
        df = df.withColumn(n, F.col("best") if n == "rank_by_n_aid" else F.lit(None).cast("long"))
    kept = {r.session: r["count"] for r in C.trimmed(df, ONE).groupBy("session").count().collect()}
    assert kept == {1: 20, 20: 3, 40: 3}


def test_minimum_over_proposers_is_zero_unless_clean(spark):
    base = dict.fromkeys(
        ["n_aid", "n_aid_clicks", "n_aid_carts", "n_aid_orders", "left_in_cart", "max_ts_aid", "max_ts_aid_clicks", "max_ts_aid_carts",
         "max_ts_aid_orders", "rank_by_n_aid", "rank_by_n_aid_carts", "rank_by_n_aid_orders", "ts_aid_rel_pos_in_session", "ts_order_aid",
         "ts_order_aid_rel", "ts_order_aid_clicks", "ts_order_aid_carts", "ts_order_aid_orders"], 7
    )
    df = spark.createDataFrame([(1, 5, 5), (1, 6, 5)], "session long, aid long, aid_next long")
    df = df.withColumns({k: F.lit(v) for k, v in base.items()})
    mixed = df.groupBy("session", "aid_next").agg(*C.self_features(False)).first()
    clean = df.groupBy("session", "aid_next").agg(*C.self_features(True)).first()
    assert (mixed.slf_ts_order, clean.slf_ts_order) == (0, 7)
    assert mixed.slf_n == clean.slf_n == 7
    assert mixed.aid_next_is_aid == 1


def test_popular_items_become_candidates_and_nulls_are_filled(spark):
    rows = spark.createDataFrame([(1, 5, 3, 1)], "session long, aid_next long, ts_order_aid long, src_self int")
    own = spark.createDataFrame([(1, 4)], "session long, cluster int")
    ranks = [f"rank_{t}{d}_cl50" for t in ("clicks", "carts", "orders") for d in ("", "_7d")]
    popular = spark.createDataFrame([(4, 8)], "cl long, aid long").withColumns({r: F.lit(1) for r in ranks})
    general = spark.createDataFrame([(5, 2, 2, 2)], "aid long, rank_clicks_cl1 long, rank_carts_cl1 long, rank_orders_cl1 long")
    out = features.without_nulls(features.with_popular(rows, own, popular, general, ONE), ONE)
    got = {r.aid_next: r for r in out.collect()}
    assert (got[8].ts_order_aid, got[8].src_pop_cl50, got[8].src_self, got[8].rank_clicks_cl1) == (999, 1, 0, -1)
    assert (got[5].src_pop_cl50, got[5].rank_carts_cl1) == (0, 2)


def test_session_vector_weights(spark):
    day = 86_400
    events = log(spark, (1, 1, 4 * day, 0), (1, 2, 3 * day, 2), (1, 3, 0, 1), (1, 9, 4 * day, 0))
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "aid long, vector array<float>")
    got = vectors.session_vectors(events, items, ONE).first().vector
    w1, w2, w3, w9 = 0.1, (1 - 1 / 3) * 0.6, 0.1 * 0.3, 0.1
    total = w1 + w2 + w3 + w9
    assert got == pytest.approx([(w1 + w3) / total, (w2 + w3) / total], abs=1e-6)


def test_popular_days_are_strict(spark):
    end = 30 * 86_400
    events = log(spark, (1, 1, end - 7 * 86_400, 0), (1, 2, end, 0))
    got = {r.aid: r for r in clusters.popularity(events, None, ONE, name="cl1", keep=False).collect()}
    assert (got[2].rank_clicks_7d_cl1, got[1].rank_clicks_7d_cl1) == (1, 2)
    both = clusters.popularity(events, None, replace(ONE, popular_keep=1), name="cl1").count()
    assert both == 2


def test_downsampling_caps(spark):
    rows = [(1, i, int(i < 1)) for i in range(61)] + [(2, i, int(i < 4)) for i in range(154)] + [(3, i, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "session long, aid_next long, target_carts int").withColumn("target_orders", F.lit(0))
    got = ranking.downsample(df, "carts", ONE)
    sizes = {(r.session, r.target_carts): r["count"] for r in got.groupBy("session", "target_carts").count().collect()}
    assert sizes == {(1, 1): 1, (1, 0): 40, (2, 1): 4, (2, 0): 100}
    assert "target_orders" not in got.columns


def test_recall_counts_twenty_at_most(spark):
    labels = spark.createDataFrame([(1, 2, i) for i in range(25)] + [(2, 2, 1)], "session long, type int, aid long")
    said = spark.createDataFrame([(1, 2, i) for i in range(10)], "session long, type int, aid long")
    got = {r.type: r.recall for r in evaluation.weighted_recall(said, labels, ONE).collect()}
    assert got["orders"] == pytest.approx(10 / 21)
    assert got["total"] == pytest.approx(0.6 * 10 / 21)


def test_label_json_takes_ids_and_lists(spark, tmp_path):
    path = tmp_path / "labels.jsonl"
    path.write_text('{"session":1,"labels":{"clicks":5,"carts":[6,7]}}\n{"session":2,"labels":{"orders":[8]}}\n')
    got = {tuple(r) for r in sources.read_json_labels(spark, str(path)).collect()}
    assert got == {(1, 0, 5), (1, 1, 6), (1, 1, 7), (2, 2, 8)}


def test_session_json(spark, tmp_path):
    path = tmp_path / "sessions.jsonl"
    path.write_text('{"session":1,"events":[{"aid":5,"ts":1999,"type":"clicks"},{"aid":6,"ts":2000,"type":"orders"}]}\n')
    sources.convert_json(spark, str(path), str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 5, 1, 0), (1, 6, 2, 2)}
    with pytest.raises(ValueError):
        sources.convert_json(spark, str(path), str(tmp_path / "x"), "other")


def test_submission_round_trip(spark):
    rows = spark.createDataFrame([(1, 0, 5, 0.5), (1, 0, 6, 0.5), (1, 0, 7, 0.9)], "session long, type int, aid_next long, pred_score double")
    out = ranking.submission(rows, 2)
    assert [tuple(r) for r in out.collect()] == [("1_clicks", "7 5")]
    assert {tuple(r) for r in ranking.parse_submission(out).collect()} == {(1, 0, 7), (1, 0, 5)}


def test_counts_are_symmetric(spark):
    events = sources.from_event_table(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    got = covisit.co_counts(events, ONE).where("kind = 'click_to_click'")
    back = got.select("kind", F.col("aid_next").alias("aid"), F.col("aid").alias("aid_next"), "count")
    assert got.exceptAll(back.select(got.columns)).count() == 0


def test_tables_are_written_once_and_resumed(spark, tmp_path):
    from sessionloom.plans.stages import Tables, run_name

    made = []

    def make():
        made.append(1)
        return spark.range(3)

    first = Tables(spark, f"file://{tmp_path}")
    assert first("a", make).count() == first("a", make).count() == 3 and made == [1]
    assert Tables(spark, f"file://{tmp_path}")("a", make).count() == 3 and made == [1]
    assert Tables(spark)("a", make).count() == 3 and made == [1, 1]
    (tmp_path / "a" / "_SUCCESS").unlink()  # a write that did not finish is made again
    assert first("a", make).count() == 3 and made == [1, 1, 1]
    assert run_name("x") != run_name("x") and run_name("x").startswith("x-")


def test_offsets_across_blocks_of_items(spark):
    ids = [1, 5, 1023, 1024, 5000, -7]
    rows = [("cart_to_cart", a, n, 1 + (a + n) % 2) for a in ids for n in (3, 4, 9)]
    counts = spark.createDataFrame(rows, "kind string, aid long, aid_next long, count long")
    got = {(r.aid, r.aid_next): r.perc_pop for r in covisit.pair_features(counts, ONE).collect()}
    order = sorted(rows, key=lambda r: (-r[3], r[1], r[2]))
    assert got == {(r[1], r[2]): int((i + 1) / len(rows) * 10_000) for i, r in enumerate(order)}


def test_popularity_ranks_are_clipped(spark):
    events = log(spark, *[(s, a, 0, 0) for a in range(30) for s in range(1 + a % 7)])
    got = {r.aid: r.rank_clicks_cl1 for r in clusters.popularity(events, None, replace(ONE, popular_clip=10), name="cl1", keep=False).collect()}
    order = sorted(range(30), key=lambda a: (-(1 + a % 7), a))
    assert got == {a: min(i + 1, 10) for i, a in enumerate(order)}


def test_neighbours_across_slabs_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 8)).astype(np.float32)
    x[7] = x[3]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "aid long, vector array<float>")
    got = {(r.aid, r.rank): r.aid_next for r in vectors.knn_exact(items, items, 5, query_slab=40, item_slab=25).collect()}
    dist = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    for i in range(90):
        assert [got[i, k + 1] for k in range(5)] == np.lexsort((np.arange(90), dist[i]))[:5].tolist()
    ivf = vectors.knn_ivf(items, items, replace(ONE, ivf_cells=6, ivf_recall=0.95), 5)
    found = {(r.aid, r.aid_next) for r in ivf.collect()}
    assert len(found & {(a, b) for (a, _), b in got.items()}) >= 0.9 * 450


def test_saved_models_and_files(spark, tmp_path):
    words = spark.createDataFrame([(["1", "2", "3"],), (["2", "3", "1"],)] * 5, "sentence array<string>")
    model = vectors.fit_word2vec(words, ONE, vectorSize=4, minCount=1)
    vectors.save_word2vec(model, f"file://{tmp_path}/w2v")
    again = vectors.load_word2vec(f"file://{tmp_path}/w2v")
    assert sorted(vectors.item_vectors(again).collect()) == sorted(vectors.item_vectors(model).collect())
    rows = spark.createDataFrame([(s, a, float(a), int(a == 1)) for s in range(40) for a in range(3)], "session long, aid_next long, x double, target_carts int")
    train, valid = ranking.split_sessions(rows, 0.3, ONE)
    assert train.count() + valid.count() == 120 and 0 < valid.count() < 120
    assert not {r.session for r in train.collect()} & {r.session for r in valid.collect()}
    ranker = ranking.fit_ranker(rows, "carts", replace(ONE, min_leaf_rows=1), trees=2)
    ranking.save_model(ranker, f"file://{tmp_path}/ranker")
    names = ranking.feature_columns(rows)
    want = sorted(ranking.scores(rows, ranker, names).collect())
    assert sorted(ranking.scores(rows, ranking.load_model(f"file://{tmp_path}/ranker"), names).collect()) == want
    listed = spark.createDataFrame([("1_carts", "5 6"), ("2_orders", "7")], "session_type string, labels string")
    sources.write_csv(listed, f"file://{tmp_path}/submission")
    assert sorted(sources.read_submission(spark, f"file://{tmp_path}/submission").collect()) == sorted(listed.collect())
    sources.write_csv(spark.createDataFrame([(1.23456,)], "x double"), f"file://{tmp_path}/rounded", decimals=2)
    assert spark.read.csv(f"file://{tmp_path}/rounded", header=True).first().x == "1.23"


def test_metrics_have_all_rows(spark, tmp_path):
    import json

    sources.write_metrics(spark.range(12_345), str(tmp_path / "m.json"))
    assert len(json.loads((tmp_path / "m.json").read_text())) == 12_345
    sources.write_metrics(spark.range(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []


def test_ranker_is_listwise(spark):
    import random

    pick = random.Random(3)
    rows = []
    for s in range(60):
        base = pick.random() * 100  # only the differences within a session tell
        for a in range(12):
            good = a == s % 12
            rows.append((s, a, base + 5 * good + pick.random(), pick.random(), int(good)))
    df = spark.createDataFrame(rows, "session long, aid_next long, x double, y double, target_carts int")
    few = replace(ONE, min_leaf_rows=2, column_share=1.0, row_share=1.0, tree_depth=6)
    model = ranking.fit_ranker(df, "carts", few, trees=6)
    assert model.getNumTrees == 6
    best = ranking.top_candidates(ranking.scores(df, model, ["x", "y"]), 20).withColumn("type", F.lit(1))
    truth = df.where("target_carts = 1").select("session", F.lit(1).alias("type"), F.col("aid_next").alias("aid"))
    row = evaluation.ndcg(best.withColumnRenamed("aid_next", "aid"), truth, ONE).first()
    assert (row.type, row.n_sessions) == ("carts", 60) and row.ndcg > 0.6  # 0.42 by chance


def test_ndcg(spark):
    ranked = spark.createDataFrame([(1, 0, 7, 1), (1, 0, 8, 2), (1, 0, 9, 3), (2, 0, 5, 1)], "session long, type int, aid long, pred_rank long")
    truth = spark.createDataFrame([(1, 0, 8), (1, 0, 9), (2, 0, 6), (3, 1, 1)], "session long, type int, aid long")
    import math

    want = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    row = evaluation.ndcg(ranked, truth, ONE).collect()
    assert [(r.type, r.n_sessions) for r in row] == [("clicks", 2)] and row[0].ndcg == pytest.approx(want / 2)
