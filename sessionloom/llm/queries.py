"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.bpe_codec import decode_ids, encode_documents
from sessionloom.llm.embedding_dedup import similar_vectors
from sessionloom.llm.ngram_join import similar_documents
from sessionloom.llm.oracle import oracle_sql  # noqa: F401  offered with the queries
from sessionloom.llm.packing import pack_documents
from sessionloom.llm.secrets import find_secrets, joined
from sessionloom.llm.suffix_dedup import repeated_bytes
from sessionloom.llm.token_counts import count_tokens
from sessionloom.llm.token_records import read_records, write_records
from sessionloom.llm.topk_search import top_k
from sessionloom.llm.toxicity import fit, score


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "secrets").select(
        "doc_id",
        *(count(k) for k in ("assign", "access", "hex")),
        F.sha2(joined(F.col("secrets.base")), 256).alias("base_sha256"),
        joined(F.col("secrets.spans")).alias("spans"),
    )


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    decoded = decode_ids(encode_documents(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), words=5, threshold=0.8)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def held_out(doc_id) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_records(write_records(table(spark, sf_dir, "documents"), vocabulary(), end_id=0))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_bpe_codec, op3_embedding_dedup, op4_ngram_join, op5_best_fit_packing, op6_token_counts, op7_top_k_search, op8_toxicity, op9_token_records, op10_suffix_dedup)}
