"""Session logs and labels from JSON lines or event tables; sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.config import TYPES

SESSION_LOG = "session long, events array<struct<aid:long,ts:long,type:string>>"
LABEL_LOG = "session long, labels struct<clicks:string,carts:string,orders:string>"


def type_id(name) -> F.Column:
    """0, 1, 2 for clicks, carts, orders; NULL for any other."""
    out = F.lit(None).cast("int")
    for i, t in enumerate(TYPES):
        out = F.when(name == t, i).otherwise(out)
    return out


def flatten_sessions(log: DataFrame) -> DataFrame:
    """session, aid, ts (s), type of each event of nested sessions; times come in ms and are cut to seconds."""
    each = log.select("session", F.explode("events").alias("e"))
    return each.select("session", "e.aid", F.floor(F.col("e.ts") / 1000).cast("long").alias("ts"), type_id(F.col("e.type")).alias("type"))


def flatten_labels(log: DataFrame) -> DataFrame:
    """session, type, aid of nested labels, whose values are an id or a list of ids, as JSON text."""
    pairs = F.array(*(F.struct(F.lit(i).alias("type"), F.col(f"labels.{t}").alias("text")) for i, t in enumerate(TYPES)))
    each = log.select("session", F.explode(pairs).alias("p")).select("session", "p.type", "p.text").where("text is not null")
    listed = F.when(F.trim("text").startswith("["), F.col("text")).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    return each.select("session", "type", F.explode(F.from_json(listed, "array<bigint>")).alias("aid"))


def read_json_sessions(spark: SparkSession, path: str) -> DataFrame:
    return flatten_sessions(spark.read.schema(SESSION_LOG).json(path))


def read_json_labels(spark: SparkSession, path: str) -> DataFrame:
    return flatten_labels(spark.read.schema(LABEL_LOG).json(path))


def convert_json(spark: SparkSession, path: str, out: str, kind: str = "sessions") -> None:
    """JSON lines to Parquet; kind is sessions or labels."""
    readers = {"sessions": read_json_sessions, "labels": read_json_labels}
    if kind not in readers:
        raise ValueError(f"kind must be one of {sorted(readers)}, not {kind!r}")
    readers[kind](spark, path).write.mode("overwrite").parquet(out)


def from_event_table(events: DataFrame) -> DataFrame:
    """The session log of a table (user_id, props with k, ts, event_type): view, click and purchase
    are taken as clicks, carts and orders; others are left out."""
    kind = F.col("event_type")
    type_ = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "purchase", 2)
    return events.where(kind.isin("view", "click", "purchase")).select(
        F.col("user_id").alias("session"),
        F.get_json_object("props", "$.k").cast("long").alias("aid"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        type_.alias("type"),
    )


def from_baskets(lines: DataFrame, basket: str, item: str) -> DataFrame:
    """A log of orders from (basket, item) rows, all at one time."""
    return lines.select(F.col(basket).alias("session"), F.col(item).alias("aid"), F.lit(0).cast("long").alias("ts"), F.lit(2).alias("type"))


def split_last_days(events: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(train, test): events up to `days` before the last one, and those after."""
    end = events.agg((F.max("ts") - days * 86_400).alias("cut"))
    both = events.crossJoin(F.broadcast(end))  # one row
    return both.where("ts <= cut").drop("cut"), both.where("ts > cut").drop("cut")


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV with a header, floating columns rounded."""
    if decimals is not None:
        real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        df = df.select(*(F.round(c, decimals).alias(c) if c in real else c for c in df.columns))
    df.write.mode("overwrite").csv(path, header=True)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("session_type string, labels string").csv(path, header=True)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metrics table as a JSON list on the driver's disk, row by row."""
    with open(path, "w", encoding="utf-8") as f:
        between = "[\n  "
        for r in df.toLocalIterator():
            f.write(between + json.dumps(r.asDict(recursive=True)))
            between = ",\n  "
        f.write("\n]" if between.startswith(",") else "[]")


def split_at_midpoint(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observed, labels): each session's first half by time, and what follows: its first later
    click, and all items later carted or ordered, as (session, type, aid)."""
    own = Window.partitionBy("session")
    order = own.orderBy("ts", "aid", "type")
    placed = events.withColumns({"place": F.row_number().over(order), "n": F.count("*").over(own)})
    observed = placed.where("2 * place <= n + 1").drop("place", "n")
    later = placed.where("2 * place > n + 1")
    first = Window.partitionBy("session", "type").orderBy("place")
    marked = later.withColumn("nth", F.row_number().over(first)).where("type <> 0 or nth = 1")
    return observed, marked.select("session", "type", "aid").distinct()
