"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out
from .ngrams import gram_hashes
from .shingles import distinct

ORDERS, BITS, THRESHOLD = (3, 4, 5, 6), 22, 0.7


def spaced(text: str) -> str:
    """Lower-cased, with runs of whitespace as one blank and a blank at both ends, so n-grams see word boundaries."""
    return f" {' '.join(text.lower().split())} "


def grams(text: str, window: int = 200_000):
    """Distinct n-gram hashes of a whole text, from overlapping windows of bounded size; may repeat between windows."""
    text, reach = spaced(text), max(ORDERS) - 1
    for start in range(0, max(1, len(text) - reach), window):
        yield from gram_hashes(text[start : start + window + reach], ORDERS)


class NaiveBayesLinear:
    """Logistic regression over presence features x_j r_j with r_j the log ratio of the classes' smoothed frequencies.

    Features are the n-grams that occur in `least` texts or more of a class and whose ratio is `ratio` or more in size:
    the others, by far the most, hardly move a score, and the model, which every executor gets, stays small without them.
    """

    def __init__(self, texts: list[str], toxic: np.ndarray, prior: float, least: int = 3, ratio: float = 2.0, l2: float = 0.02, rounds: int = 600):
        toxic = toxic.astype(bool)
        rows = [distinct(np.concatenate(list(grams(t)))) for t in texts]
        count = {}
        for label in (True, False):
            own = [r for r, y in zip(rows, toxic) if y == label]
            count[label] = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
        keys = distinct(np.concatenate([k[n >= least] for k, n in count.values()]))

        def share(label: bool) -> np.ndarray:
            k, n = count[label]
            at = np.minimum(np.searchsorted(k, keys), max(0, len(k) - 1))
            found = (k[at] == keys) if len(k) else np.zeros(len(keys), bool)
            return (1 + np.where(found, n[at] if len(k) else 0, 0)) / (2 + (toxic == label).sum())

        r = np.log(share(True)) - np.log(share(False))
        strong = np.abs(r) >= ratio
        self.keys, r = keys[strong], r[strong]
        at = [self.places(x) for x in rows]
        owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
        place = np.concatenate(at) if at else np.zeros(0, np.int64)
        x = r[place]
        w, bias = np.zeros(len(r)), 0.0
        step = 4 / max(1e-9, np.bincount(owner, x * x, len(at)).mean() + 1)
        momentum, m_bias = np.zeros(len(r)), 0.0
        for _ in range(rounds):  # gradient descent with momentum on the mean loss
            error = toxic - self.sigmoid(np.bincount(owner, w[place] * x, len(at)) + bias)
            gradient = np.bincount(place, error[owner] * x, len(r)) / len(at) - l2 / len(at) * w
            momentum = 0.9 * momentum + gradient
            m_bias = 0.9 * m_bias + error.mean()
            w, bias = w + step * momentum, bias + step * m_bias
        sampled = toxic.mean()  # the sample has more of the rare label than the table
        self.bias = bias + np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled))
        self.weights = w * r
        self.bitmap = np.zeros(2**BITS, bool)
        self.bitmap[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    @staticmethod
    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at[self.keys[at] == hashes]

    def score(self, text: str) -> float:
        met = [self.places(h[self.bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)]]) for h in grams(text)]
        return float(self.sigmoid(self.weights[distinct(np.concatenate(met))].sum() + self.bias))


def training_sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int) -> tuple[list[str], np.ndarray, float]:
    """About so many labelled texts of each class (and never more than twice that), and the share of toxic ones among
    all labelled training rows. Ids are taken by hash; at most 2 (positives + negatives) of them are broadcast."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [], np.zeros(0), 0.0
    draw = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2**31))
    rate = F.when(F.col("toxic") == 1, min(2**31, -(-positives * 2**31 // counts[1]))).otherwise(min(2**31, -(-negatives * 2**31 // counts[0])))
    ids = marked.where(draw < rate).limit(2 * (positives + negatives))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    table = rows.join(F.broadcast(ids), "doc_id").limit(2 * (positives + negatives)).toArrow()
    found = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))))
    return [t for _, t, _ in found], np.array([y for _, _, y in found]), counts[1] / sum(counts.values())


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 2500, threshold: float = THRESHOLD) -> DataFrame:
    """Scores each whole text: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (score >= threshold).

    Learns from labelled rows whose crc32(id) modulo 3 isn't 1, from samples bounded by positives and negatives; the
    score sees the text alone. Null counts as empty; an empty text has the score of the bias; without both labels
    every score is 0. Nothing is shuffled but label counts; the model is sent to executors.
    """
    texts, toxic, prior = training_sample(docs, labels, positives, negatives)
    model = spark.sparkContext.broadcast(NaiveBayesLinear(texts, toxic, prior)) if len(set(toxic.tolist())) == 2 else None

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                score = [model.value.score(t or "") if model is not None else 0.0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 3).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
