"""Mixing sources to target weights with a Pfair schedule."""
from __future__ import annotations

import heapq
import math
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch

#: Blocks of a source whose slots are one row of the plan, and slots that the driver holds before it writes them.
RUN, HELD = 512, 2_000_000


def quotas(weights: list[float], slots: int) -> list[int]:
    """Whole slots per source in a period, in sum exactly slots, at least one each: largest remainders. A rounding, for
    mixes that shall repeat; schedule() takes the weights themselves."""
    if len(weights) > slots:
        raise ValueError("a period needs a slot for each source")
    total = sum(weights)
    if not total > 0 or min(weights) <= 0:
        raise ValueError("target weights must be positive")
    exact = [w / total * slots for w in weights]
    out = [max(1, math.floor(x)) for x in exact]
    order = sorted(range(len(exact)), key=lambda i: (out[i] - exact[i], i))
    for i in order[: max(0, slots - sum(out))]:
        out[i] += 1
    while sum(out) > slots:
        out[max(range(len(out)), key=lambda i: (out[i] - exact[i] if out[i] > 1 else -math.inf, -i))] -= 1
    return out


def whole(weights: list) -> list[int]:
    """Positive integers in exactly the proportion of the weights; a float stands for the fraction that it holds."""
    if not all(w > 0 and math.isfinite(w) for w in weights):
        raise ValueError("target weights must be positive")
    ratios = [w.as_integer_ratio() for w in weights]
    common = math.lcm(*(d for _, d in ratios))
    return [n * (common // d) for n, d in ratios]


def pfair(weights: list, blocks: list[int]):
    """Yields (source, run, slots): the slots of blocks run * RUN, run * RUN + 1, ... of a source, RUN of them or, in
    its last run, the rest. It goes on until each source has had its number of blocks.

    Block i of a source with the share w of all weight is released at floor(i / w) and due by ceil((i + 1) / w), by
    integers and so without rounding; of the released blocks, the one due earliest takes the next slot (ties: the
    smaller source). All shares sum to 1, so every block meets its window, and after t slots, however many, a source has
    had more than w t - 1 and less than w t + 1. Held are one run a source and two heaps of sources.
    """
    share = whole(weights)
    total, had, open_ = sum(share), [0] * len(share), [array("q") for _ in share]
    future, ready = [(0, s) for s in range(len(share))], []
    t, left = 0, sum(b > 0 for b in blocks)
    while left:
        while future and future[0][0] <= t:
            s = heapq.heappop(future)[1]
            heapq.heappush(ready, (-(-(had[s] + 1) * total // share[s]), s))
        due, s = heapq.heappop(ready)
        assert due > t
        open_[s].append(t)
        had[s] += 1
        left -= had[s] == blocks[s]
        if had[s] % RUN == 0:
            yield s, had[s] // RUN - 1, open_[s]
            open_[s] = array("q")
        heapq.heappush(future, (had[s] * total // share[s], s))
        t += 1
    yield from ((s, had[s] // RUN, slots) for s, slots in enumerate(open_) if slots)


def pfair_period(quota: list[int]) -> list[list[int]]:
    """Slots of each source within one period of sum(quota) slots, for weights that are whole slots of a period."""
    slots: list[list[int]] = [[] for _ in quota]
    for s, _, part in pfair(quota, quota):
        slots[s].extend(part)
    return slots


def planned(spark: SparkSession, names: list[str], weights: list, blocks: list[int]) -> tuple[list[int], DataFrame, int]:
    """Blocks that each source has in the mix, the slots (_source, _run, _slots) of all of them, and how many they are."""
    schema, scratch, parts = "_source string, _run long, _slots array<bigint>", Scratch(spark, "mixing"), []
    used, rows, held = [0] * len(names), [], 0

    def table() -> DataFrame:
        columns = [pa.array([names[s] for s, _, _ in rows], pa.string()), pa.array([r for _, r, _ in rows], pa.int64()), pa.array([x for _, _, x in rows], pa.list_(pa.int64()))]
        return spark.createDataFrame(pa.table(columns, ["_source", "_run", "_slots"]), schema)

    for s, run, slots in pfair(weights, blocks):
        used[s] += len(slots)
        rows.append((s, run, slots))
        held += len(slots)
        if held >= HELD:
            parts.append(scratch.save(table(), "slots"))
            rows, held = [], 0
    out = table()
    for part in parts:
        out = out.unionByName(part)
    return used, out, sum(used)


def schedule(spark: SparkSession, docs: DataFrame, weights: dict | None = None, exponent: float = 0.8, block_docs: int = 16, shard_docs: int = 2048) -> DataFrame:
    """docs with where each document stands in the mix: epoch, block, slot, position (of one row per scheduled copy).

    weights: target weight of each source (the key None is the null source); by default the source's number of
    documents to the power exponent. A source is cut into blocks of block_docs documents in a pseudo-random order; a
    slot takes one block. The mix goes on until each source has been used in full, and a source that ends sooner starts
    again (epoch 1, 2, ...), so no document is left out and every prefix keeps the weights to within one block.
    position orders the mix. Repeated rows and null ids are documents like others; an empty table gives an empty mix.

    The whole run is scheduled from the exact weights, on the driver, from the counts of the sources: one step a slot
    (block_docs rows), and the slots go to the shared folder in parts, so the driver holds HELD of them at most. A source
    with a small weight and many documents makes the mix as long as its weight asks. Blocks are numbered in shards of a
    source of about shard_docs rows, so a source that holds a third of all rows is not one task.
    """
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    tie = F.xxhash64("doc_id", *(c for c in ("text",) if c in docs.columns))
    sizes = {r["s"]: r["n"] for r in docs.groupBy(source.alias("s")).agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if weights is None:
        target = [sizes[s] ** exponent for s in names]
    else:
        given = {"null" if k is None else f"s{k}": w for k, w in weights.items()}
        target = [given[s] for s in names]
    blocks = [-(-sizes[s] // block_docs) for s in names]
    used, slots, n_slots = planned(spark, names, target, blocks)
    plan = spark.createDataFrame(list(zip(names, blocks, used)), "_source string, _blocks long, _used long")

    n_shards = max(1, -(-max(sizes.values(), default=1) // shard_docs))
    rows = docs.withColumns({"_source": source, "_tie": tie}).withColumn("_shard", F.pmod(F.xxhash64("_tie", F.lit(7)), F.lit(n_shards)))
    counts = rows.groupBy("_source", "_shard").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_source", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_source", "_shard").orderBy("_tie", "doc_id")))
    # the starts have a row for each shard, the plan one for each source, the slots eight bytes for each; else they are shuffled
    starts = F.broadcast(starts) if len(names) * n_shards <= 200_000 else starts
    plan = F.broadcast(plan) if len(names) <= 50_000 else plan
    slots = F.broadcast(slots) if n_slots <= HELD else slots
    numbered = numbered.join(starts, ["_source", "_shard"]).join(plan, "_source").withColumn("_at", F.col("_start") + F.col("_row") - 1)
    numbered = numbered.withColumn("block", F.floor(F.col("_at") / block_docs))
    copies = numbered.withColumn("epoch", F.explode(F.expr("sequence(0L, floor((_used - 1 - block) / _blocks))")))
    copies = copies.withColumn("_nth", F.col("block") + F.col("epoch") * F.col("_blocks"))
    copies = copies.withColumn("_run", F.floor(F.col("_nth") / RUN)).join(slots, ["_source", "_run"])
    out = copies.withColumn("slot", F.element_at("_slots", (F.pmod("_nth", F.lit(RUN)) + 1).cast("int")))
    out = out.withColumn("position", F.col("slot") * block_docs + F.pmod("_at", F.lit(block_docs)))
    return out.drop("_source", "_shard", "_tie", "_row", "_start", "_blocks", "_used", "_nth", "_run", "_slots", "_at")


def mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The scheduled copies of docs in the order of the mix: each output partition holds runs of consecutive positions."""
    clash = [c for c in ("epoch", "block", "slot", "position") if c in docs.columns]
    plain = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    placed = schedule(spark, plain, **how)
    runs = placed.withColumn("_run", F.floor(F.col("position") / 2048)).repartition("_run").sortWithinPartitions("position")
    return runs.drop("_run", "epoch", "block", "slot", "position").withColumnsRenamed({f"_own_{c}": c for c in clash}).select(*docs.columns)
