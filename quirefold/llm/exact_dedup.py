"""Exact deduplication with an extendible-hash index on shared files; DataFrame functions only."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, ascii_lower, small


def directory(keys: DataFrame, n_keys: int, capacity: int) -> tuple[DataFrame, int]:
    """The index's directory over keys(key): rows (slot, bucket, depth) and the global depth.

    Slots are the first global-depth bits of a key. Doubling the directory once splits every bucket that holds more than
    capacity keys; a slot's bucket is the shortest prefix of its bits that is not overfull. Copies share one key, so
    they never force a split. All depths are counted in one aggregation of the deepest histogram, whose rows are
    bounded by 16 n_keys / capacity.
    """
    deepest = 0 if n_keys <= capacity else min(40, math.ceil(math.log2(n_keys / capacity)) + 4)
    shift = lambda bits: F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    slots = keys.select(shift(deepest).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    prefixes = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
    prefixes = prefixes.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {deepest} - depth)"))
    fit = prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == deepest))
    found = prefixes.join(fit, ["depth", "prefix"]).groupBy("slot").agg(F.min(F.struct("depth", "prefix")).alias("at"))
    return found.select("slot", F.expr("shiftleft(1L, at.depth) + at.prefix").alias("bucket"), F.col("at.depth").alias("depth")), deepest


def exact_dedup(
    spark: SparkSession, docs: DataFrame, capacity: int = 4096, key_bits: int = 64, digest=lambda text: F.sha2(text, 256), broadcast_rows: int = 400_000
) -> DataFrame:
    """Groups documents of equal text (A-Z lower-cased, all else byte for byte; null is empty).

    Returns one row per input row: doc_id, keep_id (largest id of the group), group_size, kept (doc_id is keep_id),
    text_sha256. A null id is never the largest unless the group has no other; repeated rows count each; an empty
    table gives an empty result; other columns are ignored.

    1. Index entries (key, digest, id) go to shared files. 2. The directory splits overfull key ranges (buckets).
    3. Texts of keys that occur again are aggregated by bucket, key and text: Spark pre-aggregates in each task before
    the shuffle, and equality there is a comparison of bytes. 4. The owner task of each bucket chains the different
    texts of one key and writes the bucket's page. 5. Entries look up their page. capacity: keys in a bucket;
    key_bits: fewer than 64 force collisions (tests); broadcast_rows: repeated keys up to which they are broadcast; of more,
    a bitmap of 16 MB is, so that texts that occur once are hardly ever shuffled.
    """
    scratch = Scratch(spark, "exact")
    key: Column = F.xxhash64("norm") if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits), 64 - key_bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.col("text")).alias("norm"))
    rows = rows.withColumn("key", key)
    entries = scratch.save(rows.select("doc_id", "key", F.unhex(digest(F.col("norm"))).alias("digest")), "entries")

    keys = scratch.save(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    slots, depth = directory(keys, keys.count(), capacity)
    again = keys.where("n > 1").withColumn("slot", F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long"))
    again = scratch.save(again.join(F.broadcast(slots) if small(slots, 100_000) else slots, "slot").select("key", "bucket"), "repeated")

    word, bit = F.shiftrightunsigned("key", 43), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 37) & 63 as int))")  # of 2^27 bits: 2^21 rows at most
    if small(again, broadcast_rows):
        met = rows.join(F.broadcast(again), "key").groupBy("bucket", "key", "norm")
        groups = met.agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    else:  # too many to broadcast: texts whose key may be among them, as a bitmap tells, are shuffled, then the buckets by key
        maybe = rows.withColumn("_word", word).join(F.broadcast(again.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
        groups = maybe.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).join(again, "key")
    in_page = groups.select("bucket", "key", F.unhex(digest(F.col("norm"))).alias("digest"), F.octet_length("norm").alias("n_bytes"), "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "key").orderBy("digest", "n_bytes", "keep_id")
    pages = scratch.save(in_page.repartition("bucket").withColumn("chained", F.row_number().over(chain)), "pages")
    scratch.drop(keys, again)

    doubtful = pages.groupBy("key", "digest").agg(F.count("*").alias("n")).where("n > 1")
    found = (F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    if doubtful.limit(1).count() == 0:
        out = entries.join(pages.select("key", "digest", "keep_id", "group_size"), ["key", "digest"], "left").select("doc_id", *found, "digest")
    else:  # different texts share a digest too: only their bytes tell them apart
        texts = rows.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = rows.join(texts, ["key", "norm"], "left").select("doc_id", *found, F.unhex(digest(F.col("norm"))).alias("digest"))
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
