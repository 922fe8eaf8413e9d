"""Embedding near-duplicates: random-hyperplane sign hashing in tables, exact cosines, components."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, forest


def plan_tables(rows: int, cosine: float, miss: float = 1e-4, bucket: int = 2048) -> tuple[int, int]:
    """Bits of a table's hash, so that a bucket of unrelated vectors has about so many rows, and the number of tables
    after which a pair at the threshold has been missed with at most the given probability. Bits stop at 30, from where
    on (2,000 billion rows) buckets grow; large buckets mean fewer tables, so less to shuffle and more to multiply."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, rows / bucket)))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - together)))


def unit_of(v: np.ndarray) -> np.ndarray:
    """Rows of length one; no overflow on the way."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def embedding_dedup(spark: SparkSession, vectors: DataFrame, cosine: float = 0.9, miss: float = 1e-4, block: int = 4096, seed: int = 5) -> DataFrame:
    """Links vectors whose cosine (in double precision) is at least the threshold.

    Returns for every row vec_id, n_links (other vectors linked directly), component_id (smallest vec_id that links
    reach, its own if none), kept (vec_id is component_id). A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing; vectors of different lengths don't link. Ids name vectors; a row without
    id takes part in no link. An empty table gives an empty result; other columns are ignored.

    Equal vectors are one node with a weight. Each node is dealt to one bucket for each table by the signs of random
    projections; buckets are compared exactly by matrix products, in pairs of blocks of about `block` members, so no
    task holds more than two blocks. A pair counts in the first table where it shares a bucket. A block pair gives
    counts per vector and a spanning forest of its links, so what leaves it is linear in its members. Bits grow with the number
    of vectors and tables with the bits, so that work grows as rows to the power 1.22 or so. A vector of floats is sent
    as floats and widened where it is compared. Rows that repeat an id with other vectors count as one vector each.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = np.float32 if single else np.float64
    scratch = Scratch(spark, "vectors")
    value = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    sound = rows.where(fine & F.col("vec_id").isNotNull())
    nodes = scratch.save(sound.groupBy("v").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("copies")), "nodes")
    bits, tables = plan_tables(nodes.count(), cosine, miss)
    place = np.min_scalar_type(2**bits - 1)

    def hashed(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = part.column("v").to_pylist()
                for size in sorted({len(x) for x in lists}):
                    at = [k for k, x in enumerate(lists) if len(x) == size]
                    own_v = np.array([lists[k] for k in at], np.float64)
                    v = unit_of(own_v)
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, size]).standard_normal((size, bits * tables))
                    signs = (v @ planes[size] > 0).reshape(len(at), tables, bits)
                    sig = (signs * (1 << np.arange(bits))).sum(axis=2).astype(place)
                    own = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("id"), own.column("copies"), pa.array(np.full(len(at), size, np.int32)), pa.array([x.tobytes() for x in own_v.astype(kind)], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(list(sig.astype(np.int32)), pa.list_(pa.int32()))],
                        ["id", "copies", "size", "vector", "sig", "buckets"],
                    )

    node = scratch.save(nodes.mapInArrow(hashed, "id long, copies long, size int, vector binary, sig binary, buckets array<int>"), "hashed")
    spread = node.select("id", "size", F.posexplode("buckets").alias("t", "bucket"))
    counts = spread.groupBy("size", "t", "bucket").agg(F.count("*").alias("g")).where("g > 1")
    counts = scratch.save(counts.select("size", "t", "bucket", F.ceil(F.col("g") / block).cast("int").alias("blocks")), "counts")

    def dealt() -> DataFrame:
        out = node.select("id", "copies", "size", "vector", "sig", F.posexplode("buckets").alias("t", "bucket")).join(counts, ["size", "t", "bucket"])
        out = out.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return out.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")}).drop("other", "blocks")

    def compare(key, table):
        x, y, t, size = (key[i].as_py() for i in (3, 4, 1, 0))
        mine, ids, copies = (table.column(c).to_numpy() for c in ("mine", "id", "copies"))
        unit = unit_of(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(-1, size).astype(np.float64))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), place).reshape(-1, tables)
        left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        edges = []
        for start in range(0, len(left), 256):
            rows_ = left[start : start + 256]
            i, j = np.nonzero(unit[rows_] @ unit[right].T >= cosine)
            i, j = rows_[i], right[j]
            keep = (i != j) if x != y else (i < j)
            i, j = i[keep], j[keep]
            for cut in range(0, len(i), 100_000):
                a, b = i[cut : cut + 100_000], j[cut : cut + 100_000]
                early = (sig[a, :t] == sig[b, :t]).any(axis=1) if t else np.zeros(len(a), bool)
                a, b = a[~early], b[~early]
                n += np.bincount(a, copies[b], len(ids)).astype(np.int64) + np.bincount(b, copies[a], len(ids)).astype(np.int64)
                edges.append(forest(a, b, root))
        edges = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        some = np.flatnonzero(n)
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[some], ids[edges[:, 0]]]), pa.int64()),
                "b": pa.array(np.concatenate([ids[some], ids[edges[:, 1]]]), pa.int64()),
                "n": pa.array(np.concatenate([n[some], np.zeros(len(edges), np.int64)]), pa.int64()),
            }
        )

    met = scratch.save(dealt().groupBy("size", "t", "bucket", "x", "y").applyInArrow(compare, "a long, b long, n long"), "met")
    direct = met.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    labels = components(spark, met.where("a <> b").select("a", "b"), scratch)
    found = node.select("id", "copies").join(direct, "id", "left").join(labels, "id", "left")
    found = found.select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    named = nodes.select("v", "id").join(found, "id").drop("id")
    out = rows.withColumn("v", F.when(fine & F.col("vec_id").isNotNull(), F.col("v"))).join(named, "v", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))

