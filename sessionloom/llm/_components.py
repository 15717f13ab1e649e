"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm._spark import discard, store


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of the edges; root is the least node reachable.

    Each step is written to the shared folder.  A node with very many neighbours is
    never gathered: a step needs only the least neighbour of each node.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = both.select(F.col("u").alias("node")).unionByName(both.select(F.col("v").alias("node"))).distinct()
    now = store(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        out = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = out.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = out.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", F.col("m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, store(small, "edges")
        discard(last)
        one, two = F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftrightunsigned(F.xxhash64("v", "u"), 40))
        state = now.agg(F.count("*").alias("n"), one.alias("one"), two.alias("two")).first()
        if state == before:
            break
        before = state
    return nodes.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))
