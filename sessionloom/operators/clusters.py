"""Session clusters, and items popular in them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.config import TYPES, Config
from sessionloom.functions import least_of


def cluster_sessions(vectors: DataFrame, config: Config, k: int | None = None) -> DataFrame:
    """session, cluster by k-means on session vectors."""
    model = KMeans(
        k=k or config.clusters, maxIter=config.kmeans_iterations, tol=config.kmeans_tolerance, seed=config.seed,
        featuresCol="features", predictionCol="cluster",
    )
    points = vectors.select("session", array_to_vector("vector").alias("features"))
    return model.fit(points).transform(points).select("session", "cluster")


def popularity(events: DataFrame, clusters: DataFrame | None, config: Config, *, name: str = "cl50", keep: bool = True) -> DataFrame:
    """cl, aid and six ranks, {rank_type}[_7d]_{name}: places of an item in its cluster by events
    of a type, in all and in the last days before the last event of all.

    Without clusters all sessions are one.  A session without a cluster is in cluster -1.
    Rows of which no rank is among the first popular_keep go, unless keep is false.
    """
    end = events.agg((F.max("ts") - config.popular_days * 86_400).alias("since"))
    if clusters is None:
        placed = events.withColumn("cl", F.lit(0).cast("long"))
    else:
        known = clusters.select("session", F.col("cluster").cast("long").alias("cl"))
        placed = events.join(known, "session", "left").withColumn("cl", F.coalesce("cl", F.lit(-1)))
    placed = placed.crossJoin(F.broadcast(end))  # one row
    late = F.col("ts") > F.col("since")
    counts = {}
    for i, t in enumerate(TYPES):
        counts[f"rank_{t}_{name}"] = F.count_if(F.col("type") == i)
        counts[f"rank_{t}_7d_{name}"] = F.count_if((F.col("type") == i) & late)
    counted = placed.groupBy("cl", "aid").agg(*(c.alias(n) for n, c in counts.items()))
    # only places before the clip need an order: every task keeps that many rows of a cluster, and no more are moved
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in counts))).alias("x")
    order = Window.partitionBy("cl", "name").orderBy(F.desc("n"), "aid")
    first = counted.select("cl", "aid", each).select("cl", "aid", "x.*").withColumn("rank", F.row_number().over(order))
    first = first.where(F.col("rank") < config.popular_clip)
    wide = first.groupBy("cl", "aid").agg(*(F.max(F.when(F.col("name") == n, F.col("rank"))).alias(n) for n in counts))
    clipped = [F.coalesce(F.col(n), F.lit(config.popular_clip)).cast("long").alias(n) for n in counts]
    if keep:
        return wide.where(least_of([F.col(n) for n in counts]) <= config.popular_keep).select("cl", "aid", *clipped)
    return counted.select("cl", "aid").join(wide, ["cl", "aid"], "left").select("cl", "aid", *clipped)
