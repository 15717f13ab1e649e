"""Training rows, rankers, scores, submissions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.cluster import ship
from sessionloom.config import TYPES, Config
from sessionloom.functions import spread


def downsample(rows: DataFrame, target: str, config: Config) -> DataFrame:
    """Sessions with a positive: all their positives, and negatives in pseudo-random order, up to
    negatives_per_positive times the positives and max_negatives.  Other targets go."""
    label = f"target_{target}"
    own = Window.partitionBy("session")
    positives = F.sum(label).over(own)
    negative_first = own.orderBy(label, spread(config.seed, F.col("session"), F.col("aid_next")), "aid_next")
    allowed = F.least(F.col("positives") * config.negatives_per_positive, F.lit(config.max_negatives))
    marked = rows.withColumns({"positives": positives, "place": F.row_number().over(negative_first)})
    kept = marked.where((F.col("positives") > 0) & ((F.col(label) == 1) | (F.col("place") <= allowed)))
    others = [f"target_{t}" for t in TYPES if t != target]
    return kept.drop("positives", "place", *others)


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session").agg(F.count("*").alias("n"))


def feature_columns(rows: DataFrame) -> list[str]:
    """All columns but keys and targets."""
    return [c for c in rows.columns if c not in ("session", "aid_next") and not c.startswith("target_")]


def split_sessions(rows: DataFrame, valid_share: float, config: Config) -> tuple[DataFrame, DataFrame]:
    """(train, valid) by whole sessions."""
    place = spread(config.seed, F.col("session")) % 10_000
    return rows.where(place >= int(valid_share * 10_000)), rows.where(place < int(valid_share * 10_000))


def _slopes(k: int) -> Callable[[pa.Table], pa.Table]:
    """Of one session's rows: the step towards a better NDCG at k, and its weight (LambdaRank, by Newton)."""

    def run(rows: pa.Table) -> pa.Table:
        label, score = rows["label"].to_numpy().astype(bool), rows["prediction"].to_numpy()
        place = np.empty(len(score), np.int64)
        place[np.argsort(-score, kind="stable")] = np.arange(len(score))
        discount = np.where(place < k, 1 / np.log2(place + 2), 0)
        ideal = (1 / np.log2(np.arange(min(int(label.sum()), k)) + 2)).sum() or 1.0
        up, down = np.flatnonzero(label), np.flatnonzero(~label)
        change = np.abs(discount[up][:, None] - discount[down][None, :]) / ideal
        doubt = 1 / (1 + np.exp(np.clip(score[up][:, None] - score[down][None, :], -50, 50)))
        slope, weight = np.zeros(len(score)), np.full(len(score), 1e-6)
        slope[up], slope[down] = (doubt * change).sum(1), -(doubt * change).sum(0)
        curve = doubt * (1 - doubt) * change
        weight[up] += curve.sum(1)
        weight[down] += curve.sum(0)
        x = rows["x"].cast(pa.list_(pa.field("element", pa.float64())))
        return pa.table([x, pa.array(slope / weight), pa.array(weight)], names=["x", "step", "weight"])

    return run


def fit_ranker(rows: DataFrame, target: str, config: Config, *, trees: int | None = None) -> GBTRegressionModel:
    """Boosted trees that rank the rows of each session by the target (LambdaRank): every tree is fitted to the
    steps that most raise NDCG at keep_top_k, from the scores of those before it.

    `rows` are read once for every tree; a session's rows meet in one task (a sample has max_negatives at most).
    """
    columns, spark = feature_columns(rows), rows.sparkSession
    ship(spark)
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    x = x.select("session", F.col(f"target_{target}").alias("label"), "features")
    model, made = None, []
    for i in range(trees or config.trees):
        scored = x.withColumn("prediction", F.lit(0.0)) if model is None else model.transform(x)
        narrow = scored.select("session", "label", "prediction", vector_to_array("features").alias("x"))
        steps = narrow.groupBy("session").applyInArrow(_slopes(config.keep_top_k), "x array<double>, step double, weight double")
        one = RandomForestRegressor(
            numTrees=1, bootstrap=False, subsamplingRate=config.row_share, featureSubsetStrategy=str(config.column_share),
            maxDepth=config.tree_depth, minInstancesPerNode=config.min_leaf_rows, seed=config.seed + i,
            featuresCol="features", labelCol="step", weightCol="weight",
        )
        made.append(one.fit(steps.select(array_to_vector("x").alias("features"), "step", "weight"))._java_obj.trees()[0])
        model = _boosted(spark, made, config.step_size)
    return model


def _boosted(spark: SparkSession, trees: list, step: float) -> GBTRegressionModel:
    """One model of trees, each with the same weight."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    each = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        each[i], weights[i] = tree, step
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"ranker_{len(trees)}", each, weights))


def scores(rows: DataFrame, model, columns: list[str]) -> DataFrame:
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    ranked = model.transform(data.select("session", "aid_next", "features"))
    return ranked.select("session", "aid_next", F.col("prediction").alias("pred_score"))


def feature_importance(spark: SparkSession, model, columns: list[str]) -> DataFrame:
    """Share of the gain of each feature, largest first."""
    gains = model.featureImportances.toArray()
    total = float(gains.sum()) or 1.0
    rows = sorted(((c, round(float(g) / total, 4)) for c, g in zip(columns, gains)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)


def top_candidates(scored: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each session, ties to smaller ids."""
    order = Window.partitionBy("session").orderBy(F.desc("pred_score"), "aid_next")
    ranked = scored.withColumn("pred_rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("pred_rank") <= k).select("session", "aid_next", "pred_score", "pred_rank")


def submission(ranked: DataFrame, k: int) -> DataFrame:
    """session_type and its items, best first, from (session, type, aid_next, pred_score) rows."""
    order = Window.partitionBy("session", "type").orderBy(F.desc("pred_score"), "aid_next")
    first = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    name = F.element_at(F.array(*map(F.lit, TYPES)), F.col("type") + 1)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "aid_next"))), lambda x: x["aid_next"].cast("string"))
    grouped = first.groupBy("session", "type").agg(F.array_join(listed, " ").alias("labels"))
    return grouped.select(F.concat_ws("_", F.col("session").cast("string"), name).alias("session_type"), "labels")


def parse_submission(submitted: DataFrame) -> DataFrame:
    """session, type, aid of each listed item, back from strings."""
    parts = F.split("session_type", "_")
    name, out = parts.getItem(1), F.lit(None).cast("int")
    for i, t in enumerate(TYPES):
        out = F.when(name == t, i).otherwise(out)
    each = F.explode(F.split("labels", " ")).alias("aid")
    rows = submitted.select(parts.getItem(0).cast("long").alias("session"), out.alias("type"), each)
    return rows.select("session", "type", F.col("aid").try_cast("long").alias("aid")).where("aid is not null")
