"""Functions that columns cannot express, over Arrow batches."""
from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from .edits import distances
from .text import DEVA_DIGITS, DIGIT_RUN, LATIN_DIGITS

FOLD, RUN = str.maketrans(DEVA_DIGITS, LATIN_DIGITS), re.compile(DIGIT_RUN)
SIGNS, CONSONANTS = frozenset(map(chr, [*range(0x93E, 0x94E), 0x962, 0x963])), frozenset(map(chr, range(0x915, 0x93A)))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def normalize_word(text: pd.Series) -> pd.Series:
    """NFC, without joiners, stripped."""
    return text.map(lambda x: unicodedata.normalize("NFC", x).replace("\u200c", "").replace("\u200d", "").strip(), na_action="ignore")


@F.pandas_udf(StringType())
def label_nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: " ".join(unicodedata.normalize("NFC", x).split()), na_action="ignore")


@F.pandas_udf(ArrayType(StructType().add("run", StringType()).add("start", IntegerType()).add("end", IntegerType())))
def runs_with_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [{"run": m[0], "start": m.start(), "end": m.end()} for m in RUN.finditer(x or "")])


def word_edits(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two lists, a row of the table at a time."""
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in side], dtype=np.int64) for side in (a, b))
    step = np.arange(len(y) + 1)
    row = step.copy()
    for i, w in enumerate(x):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(np.concatenate([[i + 1], best]) - step) + step
    return int(row[-1])


@F.pandas_udf(DoubleType())
def wer_words(gt: pd.Series, hyp: pd.Series) -> pd.Series:
    """Word error rate of texts of any length."""
    codes: dict[str, int] = {}
    sides = [[np.array([codes.setdefault(w, len(codes)) for w in (t or "").split()], np.int64) for t in texts] for texts in (gt, hyp)]
    n, d = np.array([len(a) for a in sides[0]], np.int64), distances(*sides)
    return pd.Series(np.where(n > 0, d / np.maximum(n, 1), (d > 0).astype(float)))


def error_kind(gt: str | None, hyp: str | None) -> str:
    if gt is None or hyp is None:
        return "other"
    numbers = lambda x: [r.translate(FOLD) for r in RUN.findall(x)]
    own = lambda x, chars: set(x) & chars
    if numbers(gt) != numbers(hyp):
        return "digit"
    if sorted(gt) == sorted(hyp):
        return "order"
    if not set(gt) & set(hyp):
        return "unrelated"
    return "matra" if own(gt, SIGNS) != own(hyp, SIGNS) else "consonant" if own(gt, CONSONANTS) != own(hyp, CONSONANTS) else "other"


@F.pandas_udf(StringType())
def token_error_kinds(gt: pd.Series, hyp: pd.Series) -> pd.Series:
    """Kinds of misread tokens; of equal pairs one is judged."""
    found: dict = {}
    for pair in zip(gt, hyp):
        if pair not in found:
            found[pair] = error_kind(*pair)
    return pd.Series([found[pair] for pair in zip(gt, hyp)], dtype=object)


@F.pandas_udf(StringType())
def ctc_decode(ids: pd.Series, charset: pd.Series) -> pd.Series:
    """Text of a sequence of class ids: repeats collapse, 0 is blank, k is the k-th character of the charset."""

    def one(seq, chars: str) -> str:
        seq = np.asarray(seq, dtype=int)
        keep = np.concatenate([[True], seq[1:] != seq[:-1]]) & (seq > 0) if len(seq) else np.zeros(0, bool)
        return "".join(chars[i - 1] for i in seq[keep])

    return pd.Series([one(s, c) for s, c in zip(ids, charset)])


def sampled_texts(spark, n: int, words: list[str], patterns: list[str], seed: int = 1, shares: tuple[float, float] = (0.25, 0.45), most: int = 60):
    """n synthetic training lines (id, text): a share of long ones of words and patterns that have digits, a share of single
    patterns, the rest runs of two to five words. # in a pattern is a random digit. A line depends on the seed and its id
    alone, not on how rows are dealt."""

    def one(k: int) -> str:
        rng = np.random.default_rng([seed, k])
        pattern = lambda: "".join(str(rng.integers(10)) if c == "#" else c for c in patterns[rng.integers(len(patterns))])
        run = lambda lo, hi: " ".join(words[i] for i in rng.integers(0, len(words), rng.integers(lo, hi + 1)))
        draw = rng.random()
        if draw >= sum(shares):
            return run(2, 5)
        if draw >= shares[0]:
            return pattern()
        text = pattern()
        while True:
            longer = f"{text} {pattern() if rng.random() < 0.5 else run(2, 4)}"
            if len(longer) > most:
                return text
            text = longer

    def run_all(batches):
        for pdf in batches:
            yield pdf.assign(text=[one(int(k)) for k in pdf.id])

    return spark.range(n).mapInPandas(run_all, "id long, text string")
