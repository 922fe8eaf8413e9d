"""Set operations, samples, caps and splits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*cols: str, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows at random, the same for a seed: those of the smallest hashes, by a top-k without a sort of all."""
    return rows.orderBy(hash_order(key, seed=seed), key).limit(n)


def split(rows: DataFrame, key: str, share: float = 0.05, seed: int = 0) -> DataFrame:
    """rows with part 'val' for exactly max(1, int(share n)) of them, those of the smallest hashes, else 'train'.

    Rows are counted per range of hashes (2^16 numbers come to the driver); only the range in which the cut lies is ranked.
    """
    own = rows.withColumns({"_h": F.shiftrightunsigned(hash_order(key, seed=seed), 48), "_order": hash_order(key, seed=seed)})
    counts = sorted((r["_h"], r["n"]) for r in own.groupBy("_h").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    left, cut = max(1, int(total * share)), -1
    for cut, n in counts:
        if n >= left:
            break
        left -= n
    plain = own.where(F.col("_h") != cut).withColumn("part", F.when(F.col("_h") < cut, "val").otherwise("train"))
    place = F.row_number().over(Window.partitionBy("_h").orderBy(F.expr("_order & 281474976710655"), key))
    ranked = own.where(F.col("_h") == cut).withColumn("part", F.when(place <= left, "val").otherwise("train"))
    return plain.unionByName(ranked).drop("_h", "_order")


def capped(rows: DataFrame, group: str, order: list[str], per_group: int, total: int) -> DataFrame:
    """At most per_group rows of each group, and of those the first total ones."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_group).drop("_rn").orderBy(group, *order).limit(total)


def repeated(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """All parts, each so many times."""
    out = [df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(k)))).drop("_k") for df, k in parts if k > 0]
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every


def within_charset(rows: DataFrame, text: str, chars: str) -> DataFrame:
    """Rows whose characters are all in chars."""
    return rows.where(F.size(F.array_except(F.split(text, ""), F.array(F.lit(""), *map(F.lit, sorted(set(chars)))))) == 0)


def first_occurrence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a grouped minimum, so Spark combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key + order]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*key, *(F.col(f"_b.{c}").alias(c) for c in (*order, *rest)))
