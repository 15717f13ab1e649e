"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its
result is written as Parquet and read again.  All stages but the last return the columns
of documents.

1.  toxicity: documents that the classifier scores 0.5 or more go.
2.  near_duplicates: of documents linked by a Jaccard similarity of 0.8 or more on
    five-word shingles, one row of each connected group stays, of the least id.
3.  repeated_passages: strings of 200 bytes or more that occur elsewhere are cut from
    all their places; a document that loses everything goes.
4.  secrets: each secret is replaced by a mark.
5.  packing: documents become pieces in sequences of at most 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import toxicity as tox
from sessionloom.llm._spark import store
from sessionloom.llm.ngram_join import similar_documents
from sessionloom.llm.packing import pack_documents
from sessionloom.llm.queries import table, vocabulary
from sessionloom.llm.secrets import redact
from sessionloom.llm.suffix_dedup import repeated_bytes


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the classifier of sf_dir's labels.  Null and empty texts have the score of
    the intercept alone; without labels of both classes all stay."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return tox.drop_toxic(docs, tox.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, told apart by row and not by id: that of the least id, rows without one last.
    Null and empty texts and texts of blanks are groups by themselves; of such rows with an id and text in
    common the first stays.  Columns of any name stay."""
    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*docs.columns).alias("row"))
    keyed = store(keyed, "keyed")
    ids = keyed.select("row_key", F.col("row.doc_id").alias("doc_id"))
    found = similar_documents(keyed.select("row_key", F.col("row.text").alias("text")), id_col="row_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_key"))
    grouped = found.select(F.col("doc_id").alias("row_key"), "class_id").join(ids, "row_key").groupBy("class_id")
    chosen = keyed.join(grouped.agg(first.alias("x")).select("x.row_key"), "row_key", "left_semi")
    blank = ~F.coalesce(F.col("row.text").rlike(r"[^\x00-\x20]"), F.lit(False)) & F.col("row.doc_id").isNotNull()
    once = chosen.where(blank).groupBy(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    once = once.agg(F.min_by("row", "row_key").alias("row"))
    return chosen.where(~blank).select("row.*").unionByName(once.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters of repeated strings.  Null and empty texts stay as they are; a document that
    loses everything goes; columns of any name stay."""
    others = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    found = repeated_bytes(docs.select("text", others), characters=True)
    cut = F.size("spans") > 0
    left = found.where(~cut | (F.octet_length("kept") > 0))
    left = left.withColumn("text", F.when(cut, F.col("kept").cast("string")).otherwise(F.col("text")))
    n_chars = F.when(cut, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    own = {"text": F.col("text"), "n_chars": n_chars}
    return left.select(*(own.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with "[SECRET]" in the place of each secret, overlapping ones together.  Null texts stay null; no row goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; null and empty texts, and each of repeated rows, have a piece of their own."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packing),
]

# The stages cannot be put in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
