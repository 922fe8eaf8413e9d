"""Rate limits, quotas and expiry: order-dependent decisions per key, in batch and as streams."""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructType

DECISION = "key long, event_id long, t double, allowed boolean, retry long"


class SlidingWindow:
    """At most so many accepted events in a window; refused ones don't count. Times must not fall."""

    def __init__(self, window: float, most: int, held=()):
        self.window, self.most, self.held = window, most, deque(held)

    def check(self, t: float) -> tuple[bool, int]:
        while self.held and t - self.held[0] > self.window:
            self.held.popleft()
        if len(self.held) >= self.most:
            return False, max(int(self.window - (t - self.held[0])) + 1, 1)
        self.held.append(t)
        return True, 0


def rate_limit(events: DataFrame, window: float, most: int) -> DataFrame:
    """Decisions over events(key, event_id, t in seconds), each key by itself in order of (t, event_id).

    Keys are grouped by Arrow batches sorted by key, so a key's events stream through one task with a window's state
    only; nothing gathers a key's history.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limiter = None, SlidingWindow(window, most)
        for pdf in batches:
            out = []
            for k, t in zip(pdf.key, pdf.t):
                if k != key:
                    key, limiter = k, SlidingWindow(window, most)
                out.append(limiter.check(t))
            yield pdf[["key", "event_id", "t"]].assign(allowed=[a for a, _ in out], retry=[r for _, r in out])

    return events.select("key", "event_id", "t").repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, DECISION)


def daily_quota(events: DataFrame, limit: int) -> DataFrame:
    """Decisions over events(key, event_id, t, n): a key may use limit units a UTC day; refused events use none; a limit
    of 0 is none. retry: seconds to midnight. A single key for all is the global quota."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, 0
        for pdf in batches:
            out = []
            for k, t, n in zip(pdf.key, pdf.t, pdf.n):
                if (k, t // 86400) != now:
                    now, used = (k, t // 86400), 0
                ok = limit == 0 or used + max(1, n) <= limit
                used += max(1, n) if ok and limit else 0
                out.append((ok, 0 if ok else max(int((t // 86400 + 1) * 86400) - int(t), 1)))
            yield pdf[["key", "event_id", "t"]].assign(allowed=[a for a, _ in out], retry=[r for _, r in out])

    rows = events.select("key", "event_id", "t", "n").withColumn("day", F.floor(F.col("t") / 86400))
    return rows.repartition("key", "day").sortWithinPartitions("key", "day", "t", "event_id").mapInPandas(run, DECISION)


class RateLimitProcessor(StatefulProcessor):
    """The sliding window as a stream: state is the accepted times of a key; expiring, it is dropped when nothing came for
    two windows."""

    def __init__(self, window: float, most: int, expiring: bool = False):
        self.window, self.most, self.expiring = window, most, expiring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", StructType().add("t", DoubleType()), ttlDurationMs=int(2000 * self.window) if self.expiring else None)

    def handleInputRows(self, key, rows, timerValues):
        limiter = SlidingWindow(self.window, self.most, (x[0] for x in self.times.get()) if self.times.exists() else ())
        pdf = pd.concat(rows).sort_values(["t", "event_id"])  # a key's rows may come in several pieces
        out = [limiter.check(t) for t in pdf.t]
        yield pdf[["key", "event_id", "t"]].assign(allowed=[a for a, _ in out], retry=[r for _, r in out])
        if limiter.held:
            self.times.put([(t,) for t in limiter.held])

    def close(self) -> None:
        pass


class QuotaProcessor(StatefulProcessor):
    """The daily quota as a stream: state is a key's day and what it has used; expiring, it is dropped when nothing came for
    two days."""

    def __init__(self, limit: int, expiring: bool = False):
        self.limit, self.expiring = limit, expiring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", StructType().add("day", LongType()).add("used", LongType()), ttlDurationMs=2 * 86_400_000 if self.expiring else None)

    def handleInputRows(self, key, rows, timerValues):
        day, used = self.used.get() if self.used.exists() else (-1, 0)
        pdf = pd.concat(rows).sort_values(["t", "event_id"])
        out = []
        for t, n in zip(pdf.t, pdf.n):
            if t // 86400 != day:
                day, used = int(t // 86400), 0
            ok = self.limit == 0 or used + max(1, n) <= self.limit
            used += int(max(1, n)) if ok and self.limit else 0
            out.append((ok, 0 if ok else max((day + 1) * 86400 - int(t), 1)))
        yield pdf[["key", "event_id", "t"]].assign(allowed=[a for a, _ in out], retry=[r for _, r in out])
        self.used.update((day, used))

    def close(self) -> None:
        pass


def stream_decisions(events: DataFrame, processor: StatefulProcessor) -> DataFrame:
    """A stream of decisions over a stream of events; needs the RocksDB state store. An expiring processor bounds the keys
    that are held by the time on the clock, so its stream goes on until it is stopped."""
    return events.groupBy("key").transformWithStateInPandas(processor, DECISION, "Append", "ProcessingTime" if processor.expiring else "None")


def client_key(peer, forwarded):
    """The last forwarded address, else the peer's, else 'unknown'."""
    parts = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), peer, F.lit("unknown"))


def expired(runs: DataFrame, now: float, ttl: float) -> DataFrame:
    """Runs(run_id, expires, touched) that may be deleted: now is after both their expiry and the last touch + ttl."""
    return runs.where(F.lit(now) > F.greatest(F.col("expires"), F.col("touched") + ttl))


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """Events per window and type; with a watermark upstream the same plan runs as a stream."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def skip_existing(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return inputs.join(done.select(key), key, "left_anti")


def keep_last(log: DataFrame, n: int) -> DataFrame:
    """The last n events of a log by seq, by a top-k, not a sort of the log."""
    return log.orderBy(F.desc("seq")).limit(n)


def gaps_and_islands(rows: DataFrame, by: str, start: str, end: str, gap: float) -> DataFrame:
    """rows with band: a new one begins where start exceeds the largest end before it by more than gap."""
    w = Window.partitionBy(by).orderBy(start, end, "pos")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_new", F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)).withColumn("band", F.sum("_new").over(w)).drop("_new")
