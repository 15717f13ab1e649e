"""Item and session vectors: Word2Vec, weighted means, nearest neighbours, similarity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.cluster import ship
from sessionloom.config import Config
from sessionloom.functions import dot, squared_distance, whole


def fit_word2vec(sentences: DataFrame, config: Config, **overrides) -> Word2VecModel:
    """Skip-gram vectors of items, from a table with a column `sentence` of words."""
    options = dict(
        vectorSize=config.vector_size, windowSize=config.window_size, minCount=config.min_item_count,
        maxSentenceLength=1000, seed=config.seed, inputCol="sentence", outputCol="vector",
    )
    return Word2Vec(**(options | overrides)).fit(sentences)


def item_vectors(model: Word2VecModel) -> DataFrame:
    return model.getVectors().select(F.col("word").cast("long").alias("aid"), vector_to_array("vector", "float32").alias("vector"))


def session_vectors(events: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """session, vector: the mean of its events' item vectors, weighted by recency and type.

    The weight falls linearly from 1 to its floor over weight_days.  An event whose item
    has no vector adds its weight all the same, and nothing to the sum.  Sessions without
    any vector are left out.
    """
    age = F.max("ts").over(Window.partitionBy("session")) - F.col("ts")
    by_time = F.greatest(1 - age / (config.weight_days * 86_400), F.lit(config.weight_floor))
    by_type = F.lit(None).cast("double")
    for i, w in enumerate(config.type_weights):
        by_type = F.when(F.col("type") == i, w).otherwise(by_type)
    weighted = events.select("session", "aid", (by_time * by_type).alias("w"))
    total = weighted.groupBy("session").agg(F.sum("w").alias("total"))
    # events of one item are added before vectors are joined: less to multiply, less to move
    per_item = weighted.groupBy("session", "aid").agg(F.sum("w").alias("w"))
    joined = per_item.join(items.select("aid", "vector"), "aid")
    cells = joined.select("session", "w", F.posexplode("vector").alias("dim", "x"))
    sums = cells.groupBy("session", "dim").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("s"))
    lists = sums.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("cells"))
    mean = F.transform("cells", lambda c: F.round(c["s"] / F.col("total"), 6))
    return lists.join(total, "session").select("session", mean.alias("vector"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest items of each query of two slabs: matrix products choose, differences measure."""

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["aid", "aid_next", "dist"])]
        if len(queries) and len(items):
            q, x = _matrix(queries["v"]), _matrix(items["w"])
            names, own = queries["aid"].to_numpy(), items["aid_next"].to_numpy()
            length = (x * x).sum(1)
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                dist = length - 2 * (part @ x.T) + (part * part).sum(1)[:, None]
                n = min(k, len(x))
                last = np.partition(dist, n - 1, axis=1)[:, n - 1]
                # products lose some digits: all that may be among the k are measured again
                row, col = np.nonzero(dist <= (last + 1e-9 * (length.max() + last + 1))[:, None])
                exact = ((part[row] - x[col]) ** 2).sum(1)
                order = np.lexsort((own[col], exact, row))
                row, col, exact = row[order], col[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < k
                out.append(pa.table([pa.array(names[a + row[keep]]), pa.array(own[col[keep]]), pa.array(exact[keep])], names=out[0].column_names))
        return pa.concat_tables(out)

    return run


def knn_exact(queries: DataFrame, items: DataFrame, k: int, *, query_slab: int = 32_768, item_slab: int = 8_192) -> DataFrame:
    """aid, aid_next, dist (squared distance) and rank of the k nearest items of each query item.

    Both sides are dealt to (query slab, item slab) pairs, where matrix products compare them; each
    slab pair keeps its own k best, and only those meet in the last ranking.  An item is its own
    neighbour; ties go to smaller ids.
    """
    ship(items.sparkSession)
    n_items, n_queries = _slabs(items, item_slab), _slabs(queries, query_slab)
    q = queries.select(F.col("aid").cast("long"), F.col("vector").alias("v"), _slab("aid", n_queries).alias("qs"))
    q = q.select("aid", "v", "qs", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))).alias("is"))
    i = items.select(F.col("aid").cast("long").alias("aid_next"), F.col("vector").alias("w"), _slab("aid", n_items).alias("is"))
    i = i.select("aid_next", "w", "is", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qs"))
    near = q.groupBy("qs", "is").cogroup(i.groupBy("qs", "is")).applyInArrow(_nearest(k), "aid long, aid_next long, dist double")
    return rank_neighbours(near, k)


def _slabs(table: DataFrame, rows: int) -> int:
    return max(1, -(-table.count() // rows))


def _slab(column: str, n: int) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def rank_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("aid").orderBy("dist", "aid_next")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def knn_ivf(queries: DataFrame, items: DataFrame, config: Config, k: int | None = None) -> DataFrame:
    """As knn_exact over the items of the query's nearest cells only (inverted file).

    At least ivf_probes cells are probed, and as many as it takes to find ivf_recall of the exact
    neighbours of ivf_audit query items.
    """
    k = k or config.knn
    vectors = items.select("aid", array_to_vector("vector").alias("features"))
    cells = KMeans(k=config.ivf_cells, maxIter=10, seed=config.seed, featuresCol="features", predictionCol="cell").fit(vectors)
    centres = [c.tolist() for c in cells.clusterCenters()]  # ivf_cells vectors, whatever the data
    distance = F.array(
        *(
            F.struct(squared_distance(F.col("vector"), F.array(*map(F.lit, c))).alias("d"), F.lit(j).alias("cell"))
            for j, c in enumerate(centres)
        )
    )
    order = F.transform(F.array_sort(distance), lambda x: x["cell"])
    placed = cells.transform(vectors).select(F.col("aid").alias("aid_next"), "cell")
    audited = queries.orderBy(F.xxhash64("aid"), "aid").limit(config.ivf_audit)
    truth = knn_exact(audited, items, k).join(placed, "aid_next").join(audited.select("aid", order.alias("order")), "aid")
    needed = truth.groupBy(F.array_position("order", F.col("cell")).alias("probes")).count().orderBy("probes").collect()  # ivf_cells rows
    total, seen, probes = sum(r["count"] for r in needed), 0, config.ivf_probes
    for r in needed:
        if seen < config.ivf_recall * total:
            probes = max(probes, r.probes)
        seen += r["count"]
    q = queries.select("aid", F.col("vector").alias("v"), F.explode(F.slice(order, 1, probes)).alias("cell"))
    i = placed.join(items.select(F.col("aid").alias("aid_next"), F.col("vector").alias("w")), "aid_next")
    near = q.join(i, "cell").select("aid", "aid_next", squared_distance(F.col("v"), F.col("w")).alias("dist"))
    return rank_neighbours(near, k)


def most_frequent_items(events: DataFrame, n: int) -> DataFrame:
    return events.groupBy("aid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "aid").limit(n)


def frequent_neighbours(events: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """knn_exact among the knn_items most frequent items."""
    chosen = items.join(most_frequent_items(events, config.knn_items).select("aid"), "aid", "left_semi")
    return knn_exact(chosen, chosen, config.knn)


def save_word2vec(model: Word2VecModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_word2vec(path: str) -> Word2VecModel:
    return Word2VecModel.load(path)


def knn_features(neighbours: DataFrame, suffix: str) -> DataFrame:
    """aid, aid_next, dist_w2vec_*, rank_w2vec_*: the distance cut to a whole number, the rank at most 127."""
    rank = F.least(F.col("rank"), F.lit(127)).cast("long")
    return neighbours.select(
        "aid", "aid_next", whole(F.col("dist")).alias(f"dist_w2vec_{suffix}"), rank.alias(f"rank_w2vec_{suffix}")
    )


def similarity(pairs: DataFrame, sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Adds cos_sim_ses_aid (0 without vectors) and eucl_dist_ses_aid (-1 without) to (session, aid_next) rows."""
    s = sessions.select("session", F.col("vector").alias("sv"))
    i = items.select(F.col("aid").alias("aid_next"), F.col("vector").alias("iv"))
    joined = pairs.join(s, "session", "left").join(i, "aid_next", "left")
    sv, iv = F.col("sv"), F.col("iv")
    norms = F.sqrt(dot(sv, sv)) * F.sqrt(dot(iv, iv))
    return joined.withColumns(
        {
            "cos_sim_ses_aid": F.coalesce(F.try_divide(dot(sv, iv), norms), F.lit(0.0)),
            "eucl_dist_ses_aid": F.coalesce(F.sqrt(squared_distance(sv, iv)), F.lit(-1.0)),
        }
    ).drop("sv", "iv")
