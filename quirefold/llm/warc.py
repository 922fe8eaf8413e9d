"""WARC records and a Merkle fixity audit of replicas; DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch


def warc_record(pages: DataFrame) -> Column:
    """A page as the text of one WARC resource record. Nulls in url and html count as empty, a null id as ''."""
    html = F.coalesce("html", F.lit(""))
    head = ("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", F.coalesce(F.col("page_id").cast("string"), F.lit("")), ">\r\nWARC-Target-URI: ", F.coalesce("url", F.lit("")))
    rest = ("\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(html).cast("string"), "\r\n\r\n", html, "\r\n\r\n")
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in (*head, *rest)))


def file_of(page_id: Column, digest: Column, records_per_file: int) -> Column:
    """The file of a page: one for each range of ids; pages without id are dealt over files below 0 by their digest."""
    return F.coalesce(F.floor(page_id / records_per_file), -1 - F.pmod(F.xxhash64(digest), F.lit(4096))).cast("long")


def before(*order: str) -> Column:
    """Bytes of the records before this one in its file."""
    place = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("length").over(place), F.lit(0).cast("long"))


def archive(pages: DataFrame, records_per_file: int = 1000) -> DataFrame:
    """The archive's index: page_id, file, record (place in the file from 0), offset, length, digest of the bytes.

    A file holds the page ids of one range in order of (id, digest), so offsets are running sums over at most about
    records_per_file rows, more where ids repeat; see file_of for pages without id. Only digests are shuffled.
    """
    rows = pages.withColumn("bytes", warc_record(pages)).select("page_id", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    rows = rows.withColumn("file", file_of(F.col("page_id"), F.col("digest"), records_per_file))
    place = F.row_number().over(Window.partitionBy("file").orderBy("page_id", "digest"))
    return rows.select("page_id", "file", (place - 1).cast("long").alias("record"), before("page_id", "digest").alias("offset"), "length", "digest")


def scanned(records: DataFrame) -> DataFrame:
    """What a scan of a replica finds, from records(file, offset, bytes): file, offset, length and digest, its own."""
    return records.select("file", "offset", F.octet_length("bytes").cast("long").alias("length"), F.sha2(F.col("bytes"), 256).alias("digest"))


def merkle_tree(records: DataFrame, scratch: Scratch, depth: int, span: int, fanout: int = 16) -> list[DataFrame]:
    """Levels of the trees over records(file, offset, length, digest): leaves, then depth levels, of which the last has a
    root for each file.

    A leaf stands for a range of span offsets and hashes, in order, offset, length and digest of the records that begin
    in it; a node stands for fanout ranges in a row and hashes their numbers and hashes. Each level is a table in the shared
    folder.
    """
    record = F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))), lambda r: F.concat_ws("|", r["offset"], r["length"], F.coalesce(r["digest"], F.lit(""))))
    leaf = records.groupBy("file", F.floor(F.col("offset") / span).alias("node")).agg(F.sha2(F.array_join(record, "\n"), 256).alias("hash"))
    levels = [scratch.save(leaf, "leaves")]
    for _ in range(depth):
        under = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda n: F.concat_ws("|", n["node"], n["hash"]))
        levels.append(scratch.save(levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(F.sha2(F.array_join(under, "\n"), 256).alias("hash")), "nodes"))
    return levels


def audit(spark: SparkSession, left: list[DataFrame], right: list[DataFrame], scratch: Scratch, fanout: int = 16) -> tuple[DataFrame, list[int]]:
    """Ranges in which two replicas differ: (file, node), found from the roots down; and the nodes met at each level.

    Roots are compared first; below, only children of nodes that differ are compared. A node that one replica lacks
    differs.
    """
    doubt, met = None, []
    for level in range(len(left) - 1, -1, -1):
        a, b = (side[level].select("file", "node", F.col("hash").alias(name)) for side, name in ((left, "a"), (right, "b")))
        if doubt is not None:
            above = doubt.select("file", F.col("node").alias("up"))
            a, b = (side.withColumn("up", F.floor(F.col("node") / fanout)).join(above, ["file", "up"], "left_semi").drop("up") for side in (a, b))
        pairs = a.join(b, ["file", "node"], "full")
        doubt = scratch.save(pairs.where("not a <=> b").select("file", "node"), "doubt")
        met.append(doubt.count())
    return doubt, met


def fixity(spark: SparkSession, index: DataFrame, replica: DataFrame, span: int = 65_536, fanout: int = 16) -> DataFrame:
    """Audits a replica against the archive's index: each record of index with its status, and the replica's extra ones.

    index: page_id, file, record, offset, length, digest; replica: file, offset, length, digest as a scan of its own
    bytes gives them (scanned). Each side has its own Merkle tree over ranges of offsets; records are compared only in
    ranges below roots and nodes that differ. There a record is intact if the replica has the same bytes at the same
    offset, altered if it has others there, moved if its bytes begin at another offset of the file (equal records are
    told apart in order of offsets), else missing. found_at is the offset in the replica. What the replica has besides
    is extra, without page_id and record. A file that only one side has is all missing or all extra. Of records that
    one side has twice at one offset, one is compared. Both empty: an empty result.
    """
    scratch = Scratch(spark, "warc")
    index = scratch.save(index, "index")
    held = scratch.save(replica.select("file", "offset", "length", "digest").dropDuplicates(["file", "offset"]), "replica")
    far = max((side.agg(F.max("offset")).first()[0] or 0) // span for side in (index, held))
    depth = next(d for d in range(64) if fanout**d > far)
    sides = (merkle_tree(side.select("file", "offset", "length", "digest"), scratch, depth, span, fanout) for side in (index, held))
    doubt, _ = audit(spark, *sides, scratch, fanout)
    in_doubt = lambda side: side.withColumn("node", F.floor(F.col("offset") / span)).join(doubt, ["file", "node"], "left_semi")
    at = ["file", "record"]
    asked = in_doubt(index).select(*at, "offset", "length", "digest")
    there = in_doubt(held).select("file", "offset", F.col("length").alias("has"), F.col("digest").alias("as"))
    met = scratch.save(asked.join(there, ["file", "offset"], "full"), "met")
    same = F.col("record").isNotNull() & F.col("has").eqNullSafe(F.col("length")) & F.col("as").eqNullSafe(F.col("digest"))
    nth = F.row_number().over(Window.partitionBy("file", "digest").orderBy("offset"))
    lost = met.where(F.col("record").isNotNull() & ~same).select(*at, "offset", "digest", F.col("as").isNotNull().alias("other")).withColumn("nth", nth)
    stray = met.where(F.col("as").isNotNull() & ~same).select("file", "offset", F.col("as").alias("digest"), "has", F.col("record").isNull().alias("free"))
    stray = stray.withColumn("nth", nth).withColumnRenamed("offset", "found_at")
    pairs = scratch.save(lost.join(stray, ["file", "digest", "nth"], "full"), "pairs")
    found = pairs.where("record is not null").select(
        *at, F.when(F.col("found_at").isNotNull(), "moved").when(F.col("other"), "altered").otherwise("missing").alias("status"), F.coalesce("found_at", F.when(F.col("other"), F.col("offset"))).alias("found_at")
    )
    told = index.join(found, at, "left").select("page_id", *at, "offset", "length", F.col("digest").alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status"), F.when(F.col("status").isNull(), F.col("offset")).otherwise(F.col("found_at")).alias("found_at"))
    kind = index.schema["page_id"].dataType
    extra = pairs.where("record is null and free").select(F.lit(None).cast(kind).alias("page_id"), "file", F.lit(None).cast("long").alias("record"), F.col("found_at").alias("offset"), F.col("has").alias("length"), F.col("digest").alias("record_sha256"), F.lit("extra").alias("status"), "found_at")
    return told.unionByName(extra)


#: A drill's damage: pages whose id leaves the second number modulo the first.
ALTERED, MISSING, MOVED = (97, 5), (389, 7), (211, 3)


def drill(pages: DataFrame, records_per_file: int = 1000, altered: tuple[int, int] = ALTERED, missing: tuple[int, int] = MISSING, moved: tuple[int, int] = MOVED) -> DataFrame:
    """What a scan finds in a second replica, written from pages again with known damage: some records have another last
    byte, some cannot be read, some stand behind their file's end instead of in their place (the first that fits counts,
    in the order missing, moved, altered)."""
    hit = lambda rule: F.coalesce(F.pmod("page_id", F.lit(rule[0])) == rule[1], F.lit(False))
    rows = pages.withColumn("bytes", warc_record(pages))
    worn = F.when(hit(altered) & ~hit(moved), F.concat(F.expr("substring(bytes, 1, length(bytes) - 1)"), F.lit("!"))).otherwise(F.col("bytes"))
    rows = rows.select("page_id", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("sound"), F.sha2(worn, 256).alias("digest"), hit(missing).alias("gone"), hit(moved).alias("away"))
    rows = rows.withColumn("file", file_of(F.col("page_id"), F.col("sound"), records_per_file)).withColumn("offset", before("page_id", "sound"))
    rows = rows.withColumn("end", F.sum("length").over(Window.partitionBy("file"))).where("not gone")
    behind = Window.partitionBy("file", "away").orderBy("page_id", "sound").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.when(F.col("away"), F.col("end") + F.coalesce(F.sum("length").over(behind), F.lit(0))).otherwise(F.col("offset"))
    return rows.select("file", offset.alias("offset"), "length", "digest")


def oracle_sql(records_per_file: int = 1000, altered=ALTERED, missing=MISSING, moved=MOVED) -> str:
    gone, away, worn = (f"page_id % {n} = {k}" for n, k in (missing, moved, altered))
    return f"""
WITH recs AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id::VARCHAR || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS b
  FROM pages),
idx AS (SELECT page_id, CAST(floor(page_id / {records_per_file}) AS BIGINT) AS file, CAST(strlen(b) AS BIGINT) AS length, sha256(b) AS record_sha256 FROM recs),
placed AS (SELECT *, row_number() OVER w - 1 AS record, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(sum(length) OVER (PARTITION BY file) AS BIGINT) AS size, CASE WHEN {gone} THEN 'missing' WHEN {away} THEN 'moved' WHEN {worn} THEN 'altered' ELSE 'intact' END AS status
  FROM idx WINDOW w AS (PARTITION BY file ORDER BY page_id, record_sha256))
SELECT page_id, file, record, "offset", length, record_sha256, status, CASE status WHEN 'missing' THEN NULL WHEN 'moved' THEN size
  + CAST(coalesce(sum(length) OVER (PARTITION BY file, status ORDER BY page_id, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) ELSE "offset" END AS found_at
FROM placed"""
