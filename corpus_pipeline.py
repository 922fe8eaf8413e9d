"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding. Each stage is (spark, docs, sf_dir) -> DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from quirefold.llm.common import Scratch, ascii_lower, small

#: A document is rejected if its language is undetermined or scores below so many times what a text without any sign would.
LEAST_SCORE = 1.04


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, row by row; a null text or one without letters goes."""
    found = language_id.tagged(spark, docs)
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE * F.col("_chance"))).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id. Rows of one id with other texts are other
    documents; of rows that repeat an id and a text, one stays, whichever."""
    kept = exact_dedup.exact_dedup(spark, docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    own = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_sha": F.sha2(ascii_lower(F.col("text")), 256)})
    rows = own.join(kept, own["_id"].eqNullSafe(kept["_id"]) & (own["_sha"] == kept["_digest"]), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (rows.dropDuplicates(["_id", "_sha"]) if repeated else rows).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more), with the smallest id.
    Where an id is null or repeated, each row counts as a document by itself, under a hash of id and text."""
    odd = Scratch(spark, "odd").save(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).where("n > 1 or _id is null").select("_id"), "ids")
    few = small(odd, 100_000)
    own = docs.withColumn("_key", F.col("doc_id").cast("long"))
    if odd.limit(1).count():
        marked = (F.broadcast(odd) if few else odd).withColumn("_odd", F.lit(True))
        own = docs.join(marked, docs["doc_id"].eqNullSafe(marked["_id"]), "left")
        own = own.withColumn("_key", F.when(F.col("_odd"), F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text")).otherwise(F.col("doc_id").cast("long"))).drop("_id", "_odd")
    kept = near_dedup.near_dedup(spark, own.select(F.col("_key").alias("doc_id"), "text"), words=5, percent=80).where("kept").select(F.col("doc_id").alias("_key"))
    return own.join(kept, "_key", "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix; those of sources that end sooner come again, as the target weights ask."""
    return mixing.mix(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and round_trip: whether decoding gave the text's bytes back."""
    return bpe.token_ids(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mixed), ("byte-level BPE", encoded)]

#: Stages that learn, link and schedule have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name.replace(" ", "-"))
    return docs
