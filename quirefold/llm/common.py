"""What several operators share: normalised text, tables in the shared folder, components."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Text with A-Z (and nothing else) lower-cased; null becomes empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id as text leaves 1 modulo folds; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where one machine is all there
    is, one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quirefold-")
        atexit.register(shutil.rmtree, found, True)
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written below the shared folder. They cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.kept = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df as a table in the shared folder; by: a column with few values, each a folder that drop_part can delete."""
        self.kept += 1
        path = f"{self.root}/{self.kept}-{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes saved tables that no later result reads."""
        for table in tables:
            self._delete(table._scratch_path)

    def drop_part(self, table: DataFrame, folder: str) -> None:
        """Deletes one folder of a table saved by a column, such as kind=1, that no later result reads."""
        self._delete(f"{table._scratch_path}/{folder}")

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()  # Spark deletes the shuffle files of finished jobs when the driver has collected them


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond them."""
    return df.limit(rows + 1).count() <= rows


def forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of the edges (a, b), some that join the same parts as all of them do, given the parts in root (updated): at most
    one per merge. Whole arrays are merged at a time: every part points to its smallest neighbour until none is left."""
    out = []
    while True:
        ra, rb = root[a], root[b]
        cross = ra != rb
        a, b = a[cross], b[cross]
        if not len(a):
            return np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        hi, lo = np.maximum(ra[cross], rb[cross]), np.minimum(ra[cross], rb[cross])
        order = np.lexsort((lo, hi))
        first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
        out.append(np.stack([a[first], b[first]], 1))
        parent = np.arange(len(root))
        parent[hi[first]] = lo[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root[:] = parent[root]


def contracted(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """edges(a, b) with the parts that a task sees among its own (so many at a time) as stars around their smallest id:
    the same components, shorter ways, nothing shuffled."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.arange(len(ids))
        forest(place[: len(a)], place[len(a) :], root)
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["a", "b"])

    def run(batches):
        a, b, held = [], [], 0
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            held += batch.num_rows
            if held >= most:
                yield stars(np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
        if held:
            yield stars(np.concatenate(a), np.concatenate(b))

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, hub_edges: int = 1000, task_edges: int = 50_000) -> DataFrame:
    """Connected components of edges(a, b): one row (id, component) for each id that an edge names.

    Tasks of about task_edges edges contract their own, which is all if there is one of them; then large-star and
    small-star steps alternate until nothing changes, each round's edges being a table in the shared folder. A step's minimum per id is a grouped aggregate, which Spark combines before
    the shuffle, and reaches the id's edges by a join; the minima of hubs, ids of many edges, are broadcast instead (at
    most 200,000 of them: the bound on edges rises with their number), so no task gathers a hub's edges. component is
    the smallest id.
    """
    size = 0

    def stars(links: DataFrame, larger: bool) -> DataFrame:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if larger:
            both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("g")).withColumn("m", F.least("u", "m"))
        most = max(hub_edges, size // 100_000)
        told = both.join(F.broadcast(least.where(F.col("g") > most).select("u", "m")), "u", "left")
        rest = told.where("m is null").drop("m").join(least.where(F.col("g") <= most).drop("g"), "u")
        spread = told.where("m is not null").unionByName(rest)
        spread = spread.where(F.col("v") > F.col("u") if larger else F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not larger:
            spread = spread.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return spread.where("a <> b")

    def sign(links: DataFrame):
        return links.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))").alias("h")).first()

    def dealt(links: DataFrame) -> DataFrame:
        return contracted(links.coalesce(max(1, -(-size // task_edges))))

    plain = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    size = plain.count()
    now = scratch.save(dealt(plain), "edges")
    scratch.drop(plain)
    seen = sign(now) if size > task_edges else None
    while seen is not None:
        size = seen["n"]
        now, before = scratch.save(dealt(stars(stars(now, True), False).distinct()), "edges"), now
        found = sign(now)
        scratch.drop(before)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
