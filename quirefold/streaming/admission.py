"""Admission of requests: a cascade of limits, bounded tables of keys, and runs that resume."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .limits import SlidingWindow


class Admission:
    """The stages that a request passes in turn; a stage that lets it pass is charged, even if a later one refuses.

    Requests come in order of time. limiter: accepted requests of a client in a window; client_pages and all_pages: pages
    a UTC day; runs: accepted runs a day; workers: requests that run at the same time, each for its duration. 0 switches
    a daily limit off.
    """

    def __init__(self, window: float, most: int, client_pages: int, all_pages: int, runs: int, workers: int):
        self.window, self.most, self.limits, self.workers = window, most, (client_pages, all_pages, runs), workers
        self.limiters: dict = {}
        self.day, self.clients, self.used, self.busy = None, {}, [0, 0], []

    def check(self, client, t: float, pages: int, seconds: float) -> str:
        """'admitted', or the stage that refuses."""
        if t // 86400 != self.day:
            self.day, self.clients, self.used = t // 86400, {}, [0, 0]
        limiter = self.limiters.setdefault(client, SlidingWindow(self.window, self.most))
        if not limiter.check(t)[0]:
            return "rate"
        pages = max(1, pages)
        client_pages, all_pages, runs = self.limits
        if client_pages:
            if self.clients.get(client, 0) + pages > client_pages:
                return "client_pages"
            self.clients[client] = self.clients.get(client, 0) + pages
        if all_pages:
            if self.used[0] + pages > all_pages:
                return "all_pages"
            self.used[0] += pages
        if runs:
            if self.used[1] + 1 > runs:
                return "runs"
            self.used[1] += 1
        self.busy = [end for end in self.busy if end > t]
        if len(self.busy) >= self.workers:
            return "busy"
        self.busy.append(t + seconds)
        return "admitted"


def admission(requests: DataFrame, window: float, most: int, client_pages: int, all_pages: int, runs: int, workers: int) -> DataFrame:
    """Verdicts over requests(site, event_id, client, t, pages, seconds), each site by itself in order of (t, event_id): one
    site's limits are shared by all its clients, so its requests stream through one task; sites are independent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, gate = None, None
        for pdf in batches:
            out = []
            for s, client, t, pages, seconds in zip(pdf.site, pdf.client, pdf.t, pdf.pages, pdf.seconds):
                if gate is None or s != site:
                    site, gate = s, Admission(window, most, client_pages, all_pages, runs, workers)
                out.append(gate.check(client, t, int(pages), float(seconds)))
            yield pdf[["site", "event_id"]].assign(verdict=out)

    kinds = dict(requests.dtypes)
    rows = requests.select("site", "event_id", "client", "t", "pages", "seconds").repartition("site").sortWithinPartitions("site", "t", "event_id")
    return rows.mapInPandas(run, f"site {kinds['site']}, event_id {kinds['event_id']}, verdict string")


def tracked_keys(events: DataFrame, now: float, window: float, most: int) -> DataFrame:
    """The keys that a bounded table of limits still holds at a time: those seen within the window, and of these the `most`
    seen last (ties: the larger key). events(key, t)."""
    last = events.where(F.col("t") <= now).groupBy("key").agg(F.max("t").alias("last"))
    return last.where(F.lit(now) - F.col("last") <= window).orderBy(F.desc("last"), F.desc("key")).limit(most)


def pending(inputs: DataFrame, done: DataFrame, key: str, most: int = 0) -> DataFrame:
    """What a run that was stopped still has to do, the first `most` by key; what it did before is never done again."""
    rest = inputs.join(done.select(key).distinct(), key, "left_anti")
    return rest.orderBy(key).limit(most) if most else rest


def resume(spark, inputs: DataFrame, path: str, key: str, work, batch: int) -> int:
    """Does work(rows) for batches of inputs that the results at path lack and appends its rows there, batch by batch, so a
    run that stops loses a batch at most. Returns the number of batches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, n = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    while True:
        done = spark.read.parquet(path) if fs.exists(where) else inputs.limit(0)
        rows = pending(inputs, done, key, batch)
        if not rows.limit(1).count():
            return n
        work(rows).write.mode("append").parquet(path)
        n += 1


def fold_log(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream of memory events to a table, exactly once a batch; indexes are folds of the table (memory.fold), so
    suggestions of a later session see what earlier ones learned."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
