"""Language identification with string kernels, Nystroem landmarks and one-versus-rest kernel ridge regression."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import held_out
from .ngrams import gram_hashes

ORDERS, BITS, WINDOW = (1, 2, 3, 4), 16, 200_000
LETTER = regex.compile(r"\p{L}")


def presence(text: str, mark: np.ndarray) -> np.ndarray:
    """Sorted places of the n-grams (blended spectrum: all orders) that a text has, from overlapping windows; mark is a
    cleared bitmap."""
    text, reach = text.lower(), max(ORDERS) - 1
    for start in range(0, max(1, len(text) - reach), WINDOW):
        for h in gram_hashes(text[start : start + WINDOW + reach], ORDERS):
            mark[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


class KernelModel:
    """k(x, y) = |x and y| / sqrt(|x| |y|) over presence sets; ridge regression in the span of the landmarks."""

    def __init__(self, rows: list[np.ndarray], langs: list[str], landmarks: int = 64, ridge: float = 1e-3):
        self.langs = sorted(set(langs))
        picked: list[int] = []  # in turns from the languages, in the order given
        queues = [[i for i, x in enumerate(langs) if x == lang][::-1] for lang in self.langs]
        while len(picked) < landmarks and any(queues):
            picked += [q.pop() for q in queues if q][: landmarks - len(picked)]
        self.grams = np.zeros((2**BITS, len(picked)), np.float32)
        for k, i in enumerate(picked):
            self.grams[rows[i], k] = 1 / np.sqrt(max(1, len(rows[i])))
        self.weights = np.zeros((len(picked), len(self.langs)))
        among = self.kernel(rows)
        own = among[picked]
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        left = among.T @ among + ridge * len(rows) * own + 1e-8 * np.eye(len(picked))
        self.weights = np.linalg.solve(left, among.T @ target)

    def kernel(self, rows: list[np.ndarray], chunk: int = 40_000) -> np.ndarray:
        """Kernel matrix of presence sets and landmarks: products of a sparse batch with the landmarks' matrix."""
        out = np.zeros((len(rows), self.grams.shape[1]))
        start = 0
        while start < len(rows):
            end, held = start, 0
            while end < len(rows) and (end == start or held + len(rows[end]) <= chunk):
                held += len(rows[end])
                end += 1
            full = [k for k in range(start, end) if len(rows[k])]
            if full:
                at = np.cumsum([0] + [len(rows[k]) for k in full[:-1]])
                out[full] = np.add.reduceat(self.grams[np.concatenate([rows[k] for k in full])], at, axis=0)
            start = end
        return out / np.sqrt(np.maximum(1, [len(r) for r in rows]))[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        mark = np.zeros(2**BITS, bool)
        values = self.kernel([presence(t, mark) for t in texts]) @ self.weights
        odds = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
        best = values.argmax(axis=1)
        return [self.langs[k] for k in best], (odds / odds.sum(axis=1, keepdims=True)).max(axis=1)


def training_sample(docs: DataFrame, per_language: int = 300) -> tuple[list[np.ndarray], list[str]]:
    """Presence sets and languages of about per_language labelled rows (and never more than twice that) of each language.

    Rows are taken by a hash of their id against a rate from the languages' counts, in the order of that hash; the sets
    are made on executors, so what comes to the driver is bounded (2^16 places a row) however long the texts are. Texts
    without letters are left out.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 3))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2**31))
    rate = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(2**31, -(-per_language * 2**31 // n)))))
    taken = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), draw.alias("draw")).where(F.col("draw") < F.try_element_at(rate, F.col("lang")))

    def sets(batches):
        mark = np.zeros(2**BITS, bool)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            able = [k for k, t in enumerate(texts) if LETTER.search(t)]
            own = batch.take(pa.array(able, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("draw"), own.column("lang"), pa.array([presence(texts[k], mark).astype(np.uint16).tobytes() for k in able], pa.binary())], ["draw", "lang", "places"])

    table = taken.mapInArrow(sets, "draw long, lang string, places binary").limit(2 * per_language * len(counts)).toArrow()
    order = sorted(zip(*(table.column(c).to_pylist() for c in ("draw", "places", "lang"))))
    kept: dict[str, int] = {}
    out = []
    for _, places, lang in order:
        kept[lang] = kept.get(lang, 0) + 1
        if kept[lang] <= 2 * per_language:
            out.append((np.frombuffer(places, np.uint16).astype(np.int64), lang))
    return [p for p, _ in out], [x for _, x in out]


def tagged(spark: SparkSession, docs: DataFrame, per_language: int = 300, landmarks: int = 64) -> DataFrame:
    """docs with _lang (und if text has no letter, or there is nothing to learn from), _score (0 to 1; 0 for und) and
    _chance (the score of a text that says nothing: one over the number of languages; 0 without any). Row by row."""
    model = None
    rows, langs = training_sample(docs, per_language)
    if rows:
        model = spark.sparkContext.broadcast(KernelModel(rows, langs, landmarks))
    chance = 1 / len(set(langs)) if rows else 0.0

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or "" for t in part.column(read).to_pylist()]
                able = [k for k, t in enumerate(texts) if model is not None and LETTER.search(t)]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if able:
                    for k, x, s in zip(able, *model.value.predict([texts[k] for k in able])):
                        lang[k], score[k] = x, float(s)
                own = [c for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(lang), pa.array(score, pa.float64()), pa.array([chance] * len(texts), pa.float64())], [*own, "_lang", "_score", "_chance"])

    read = "text" if dict(docs.dtypes)["text"] == "string" else "_text"
    schema = StructType([*docs.schema.fields, StructField("_lang", StringType()), StructField("_score", DoubleType()), StructField("_chance", DoubleType())])
    return (docs if read == "text" else docs.withColumn(read, F.col("text").cast("string"))).mapInArrow(run, schema)


def language_id(spark: SparkSession, docs: DataFrame, per_language: int = 300, landmarks: int = 64) -> DataFrame:
    """Predicts each whole text's language: doc_id, held_out, lang_pred, score (0 to 1), chance (see tagged).

    Learns from documents with a language whose crc32(id) modulo 3 isn't 1, from a sample bounded by per_language; the
    prediction sees the text alone. A text that is null or has no letter is 'und' with score 0, as is every text if
    there is nothing to learn from. Of languages with one score the first by name is taken. Short texts are judged by what n-grams they have; repeated rows are judged each.
    Nothing is shuffled; the model (2^16 x landmarks numbers) is the only thing sent to executors.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    found = tagged(spark, plain, per_language, landmarks)
    return found.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_chance").alias("chance"))
