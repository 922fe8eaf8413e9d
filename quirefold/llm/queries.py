"""The operators applied to their whole tables, and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.plans import derived

from . import bpe, embedding_dedup, exact_dedup, language_id, lm_scoring, mixing, near_dedup, toxicity, url_filter, warc
from .common import LOWER, UPPER


_table = derived.table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, _table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(spark, _table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(spark, _table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(spark, _table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(spark, _table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "epoch", "block", "slot", "position")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scoring(spark, _table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixity drill: the pages' archive against a second replica with known damage, which the audit must locate."""
    pages = _table(spark, sf_dir, "pages")
    return warc.fixity(spark, warc.archive(pages), warc.drill(pages))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_near_dedup, op4_toxicity, op5_embedding_dedup, op6_mixing, op7_lm_scoring, op8_url_filter, op9_byte_bpe, op10_warc_fixity)}

ORACLES = {
    "op1_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t""",
    "op8_url_filter": url_filter.oracle_sql(),
    "op10_warc_fixity": warc.oracle_sql(),
}
