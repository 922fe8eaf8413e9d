"""Quality measures of readings against truth, as joins and grouped aggregates."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

from .joins import met


def ratio(a: Column, b: Column, empty) -> Column:
    """a / b as double, or empty where b is 0."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a.cast("double") / b)


def bag_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per row of pairs(keys, gt, hyp): distinct truth tokens, read tokens, how many match and how many are invented.

    Tokens are compared by one grouped aggregate of both sides, so a text's length doesn't matter.
    """
    side = lambda text, g, h: F.transform(F.coalesce(T.norm_tokens(F.col(text)), F.array().cast("array<string>")), lambda t: F.struct(t.alias("t"), F.lit(g).alias("g"), F.lit(h).alias("h"), F.lit(0).alias("r")))
    row = F.array(F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("g"), F.lit(0).alias("h"), F.lit(1).alias("r")))  # counts rows of these keys
    each = pairs.select(*keys, F.explode(F.concat(row, side("gt", 1, 0), side("hyp", 0, 1))).alias("_t")).groupBy(*keys, F.col("_t.t").alias("t")).agg(*(f(f"_t.{c}").alias(c) for f, c in ((F.max, "g"), (F.sum, "h"), (F.sum, "r"))))
    sums = each.groupBy(*keys).agg(
        F.sum("g").cast("long").alias("gt_tokens"), F.sum("h").alias("hyp_tokens"),
        F.sum(F.when((F.col("g") == 1) & (F.col("h") > 0), 1).otherwise(0)).alias("matched"), F.sum(F.when(F.col("g") == 0, F.col("h")).otherwise(0)).alias("invented_tokens"), F.sum("r").cast("int").alias("_rows"),
    )
    out = sums.withColumn("_rows", F.explode(F.array_repeat(F.lit(0), F.col("_rows")))).drop("_rows")
    missed = F.when(F.col("gt_tokens") == 0, 0.0).otherwise(1.0 - F.col("matched") / F.col("gt_tokens"))
    return out.withColumns({"miss_rate": missed, "invented_rate": ratio(F.col("invented_tokens"), F.col("hyp_tokens"), 0.0)})


def truth_tokens(texts: DataFrame, page: str, text: str, empty: bool = True) -> DataFrame:
    """Distinct (page, t) normalised tokens of the truth."""
    return texts.select(page, F.explode(T.distinct_tokens(F.col(text), empty)).alias("t")).distinct()


def marked(tokens: DataFrame, truth: DataFrame, page: str = "doc_id") -> DataFrame:
    """tokens with ok: whether the normalised token is among truth(page, t) of its page."""
    known = truth.withColumn("ok", F.lit(True))
    return met(tokens.withColumn("t", T.norm_token(F.col("text"))), known, [page, "t"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def classed(tokens: DataFrame, truth: DataFrame, by: list[str], classes: dict[str, Column], sums: dict[str, Column] | None = None, page: str = "doc_id") -> DataFrame:
    """Tokens counted (n) per by, class and ok: whether the normalised token is among truth(page, t) of its page. Equal tokens
    of a page are counted first, so the join sees each of them once."""
    rows = tokens.select(*by, page, T.norm_token(F.col("text")).alias("t"), *(c.alias(k) for k, c in classes.items()), *(c.alias(f"_{k}") for k, c in (sums or {}).items()))
    extra = [F.sum(f"_{k}").alias(k) for k in sums or {}]
    each = rows.groupBy(*dict.fromkeys([*by, page, "t", *classes])).agg(F.count("*").alias("n"), *extra)
    asked = met(each, truth.select(page, "t").distinct().withColumn("ok", F.lit(True)), [page, "t"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return asked.select(*dict.fromkeys([*by, *classes]), "ok", "n", *(sums or {}))


def line_words(tokens: DataFrame, truth: DataFrame, by: list[str], page: str = "doc_id") -> DataFrame:
    """Tokens(pos, text, granularity, flags) as token_stats counts them: (by, d, f, ok, n). A line of several words counts as
    so many tokens, all of them right if each is in truth(page, t), else all wrong; d: any of them has a digit. Tokens of one
    page and pos are one line, but flagged ones and others two."""
    parts = T.tokens(F.col("text"))
    several = (F.col("granularity") == "line") & (F.size(parts) > 1)
    each = tokens.select(*by, page, "pos", (F.size("flags") > 0).alias("f"), F.explode_outer(F.when(several, parts).otherwise(F.array("text"))).alias("w"))
    each = met(each.withColumn("t", T.norm_token(F.col("w"))), truth.select(page, "t").distinct().withColumn("known", F.lit(True)), [page, "t"], "left")
    keys = list(dict.fromkeys([*by, page]))
    return each.groupBy(*keys, "pos", "f").agg(F.bool_or(T.has_digit(F.col("w"))).alias("d"), F.bool_and(F.coalesce("known", F.lit(False))).alias("ok"), F.count("*").alias("n"))


def token_stats(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of counts(d: has digits, f: flagged, ok, n): errors, flags and both, for all tokens and those with
    digits."""
    d, e, f = F.col("d"), ~F.col("ok"), F.col("f")
    count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    out = counts.groupBy(*by).agg(
        F.sum("n").alias("total"), count(d, "digit_total"), count(e, "errors"), count(f, "flagged"), count(f & e, "flagged_errors"),
        count(f & ~e, "flagged_correct"), count(d & e, "digit_errors"), count(d & e & f, "digit_flagged_errors"), count(d & f, "digit_flagged"),
    )
    c = F.col
    return out.withColumns({
        "coverage": ratio(c("flagged_errors"), c("errors"), 1.0), "false_alarm_rate": ratio(c("flagged_correct"), c("flagged"), 0.0),
        "digit_coverage": ratio(c("digit_flagged_errors"), c("digit_errors"), 1.0),
        "digit_false_alarm_rate": ratio(c("digit_flagged") - c("digit_flagged_errors"), c("digit_flagged"), 0.0),
        "token_error_rate": ratio(c("errors"), c("total"), 0.0),
    })


def queue_stats(tokens: DataFrame, ranks: tuple[int, ...] = (5, 10), page: str = "doc_id") -> DataFrame:
    """Per page of tokens(ok, t, rn: rank in the review queue or null): errors, queue, hits, recall and precision at ranks.

    Rates are null where their denominator is 0.
    """
    wrong = (F.col("t") != "") & ~F.col("ok")
    held = F.col("rn").isNotNull()
    aggs = [F.count(F.when(wrong, 1)).alias("errors"), F.count(F.when(held, 1)).alias("queue")]
    for k in ranks:
        aggs.append(F.count(F.when(wrong & (F.col("rn") <= k), 1)).alias(f"hits_{k}"))
    out = tokens.groupBy(page).agg(*aggs)
    for k in ranks:
        top = F.least(F.col("queue"), F.lit(k))
        out = out.withColumn(f"recall_{k}", ratio(F.col(f"hits_{k}"), F.col("errors"), None)).withColumn(f"precision_{k}", ratio(F.col(f"hits_{k}"), top, None))
    return out


def agreement(readings: DataFrame, page: str = "doc_id") -> DataFrame:
    """Per page of readings(page, reading, text): tokens in any reading, in every reading, and their ratio."""
    each = readings.select(page, "reading", F.explode(T.distinct_tokens(F.col("text"))).alias("t"))
    n = readings.groupBy(page).agg(F.countDistinct("reading").alias("readings"))
    seen = each.groupBy(page, "t").agg(F.countDistinct("reading").alias("k")).join(n, page)
    got = seen.groupBy(page).agg(F.count("*").alias("union_tokens"), F.count(F.when(F.col("k") == F.col("readings"), 1)).alias("agreed_tokens"))
    out = n.join(got, page, "left").fillna(0, ["union_tokens", "agreed_tokens"])
    return out.withColumn("agreement_rate", ratio(F.col("agreed_tokens"), F.col("union_tokens"), 0.0))


def hallucination(restored: DataFrame, known: DataFrame, page: str = "doc_id") -> DataFrame:
    """Tokens of restored(page, text) that are not among known(page, t): counts, digit counts and rates over max(n, 1)."""
    each = restored.select(page, F.explode(T.tokens(F.col("text"))).alias("text"))
    digit = T.has_digit(F.col("text"))
    got = marked(each, known.distinct(), page).groupBy(page).agg(F.count("*").alias("tokens"), F.count(F.when(~F.col("ok"), 1)).alias("invented"), F.count(F.when(~F.col("ok") & digit, 1)).alias("invented_digits"))
    out = restored.select(page).join(got, page, "left").fillna(0, ["tokens", "invented", "invented_digits"])
    n = F.greatest(F.col("tokens"), F.lit(1))
    return out.withColumns({"invented_rate": F.col("invented") / n, "invented_digit_rate": F.col("invented_digits") / n})


def ece_tokens(tokens: DataFrame, truth: DataFrame, by: list[str], bins: int = 10, calibrated: str | None = None, page: str = "doc_id") -> DataFrame:
    """Expected calibration error of tokens(conf), right if their page's truth(page, t) has them, in left-closed bins; a
    calibrated 0 counts as missing. Tokens are counted per bin before they meet the truth."""
    conf = F.col("conf") if calibrated is None else F.coalesce(F.nullif(F.col(calibrated), F.lit(0.0)), F.col("conf"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf / 100))
    counts = classed(tokens, truth, by, {"b": F.least(F.floor(p * bins), F.lit(bins - 1))}, {"s": p}, page)
    binned = counts.groupBy(*by, "b").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("c"), (F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a"))
    return binned.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def ece_fit(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """The same over rows(p, ok) in right-closed bins, p = 0 left out of the bins but not of the total."""
    return _ece(rows.withColumn("b", F.when(F.col("p") > 0, F.ceil(F.col("p") * bins))), by)


def _ece(rows: DataFrame, by: list[str]) -> DataFrame:
    binned = rows.groupBy(*by, "b").agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg(F.col("ok").cast("double")).alias("a"))
    gap = F.when(F.col("b").isNotNull(), F.col("n") * F.abs(F.col("c") - F.col("a"))).otherwise(0.0)
    return binned.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def rank_auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve of rows(score, label 0/1), ties by average rank; 0.5 if one label is missing.

    Scores are counted per value first; the running count is over distinct values, not rows.
    """
    values = rows.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    before = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    neg = F.col("n") - F.col("p")
    auc = F.when((F.col("p") == 0) | (neg == 0), 0.5).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg))
    return out.select(*by, "n", auc.alias("auc"))


def pava(values: list[float], weights: list[float]) -> tuple[list[float], list[float]]:
    """Pools adjacent means until they never fall."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v * w, w])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            s, w = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w
    return [s / w for s, w in pools], [w for _, w in pools]


def equal_count_bins(rows: DataFrame, bins: int, by: list[str], order: list[str]) -> DataFrame:
    """Means of rows(conf 0-100, ok) in bins of equal counts, in the order given, which begins with conf: x, y, n for each
    bin; the first bins are one larger where they don't come out even.

    Rows are numbered among those of their group and conf only; where a conf begins follows from counts per conf.
    """
    key = [*by, order[0]]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    own = F.row_number().over(Window.partitionBy(*key).orderBy(*order[1:])) - 1
    at, size, odd = F.col("_start") + F.col("_k"), F.floor(F.col("_all") / bins), F.col("_all") % bins
    large = odd * (size + 1)
    place = F.when(at < large, F.floor(at / (size + 1))).otherwise(F.floor((at - large) / F.greatest(size, F.lit(1))) + odd) + 1
    cut = rows.withColumn("_k", own).join(starts, key).withColumn("bin", place.cast("int"))
    return cut.groupBy(*by, "bin").agg(F.avg(F.col("conf") / 100).alias("x"), F.avg(F.col("ok").cast("double")).alias("y"), F.count("*").alias("n"))


def fit_isotonic(binned: DataFrame, by: list[str]) -> DataFrame:
    """One calibration (xs, ys) for each group of equal_count_bins: x of the bins, y pooled (so ys may be shorter)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        ys, _ = pava(pdf.y.tolist(), pdf.n.tolist())
        head = {k: pdf[k].iloc[0] for k in by}
        return pd.DataFrame([{**head, "xs": [round(x, 6) for x in pdf.x], "ys": [round(y, 6) for y in ys]}])

    kinds = dict(binned.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "xs array<double>", "ys array<double>"])
    return binned.groupBy(*by).applyInPandas(fit, schema)


#: 0.25 to 19.75 by 0.25 and 20 to 120 by 1, of both signs.
TEMPERATURES = sorted(sign * t for sign in (-1, 1) for t in [k / 4 for k in range(1, 80)] + [float(k) for k in range(20, 121)])


def fit_temperature(rows: DataFrame, by: list[str], grid: list[float] = TEMPERATURES) -> DataFrame:
    """The temperature of a grid with the least mean log loss of rows(p, label); a value's rows are counted first, so
    the grid meets distinct (p, label) pairs only."""
    pairs = rows.groupBy(*by, "p", "label").agg(F.count("*").alias("n"))
    grid_rows = pairs.withColumn("temperature", F.explode(F.array(*map(F.lit, grid))))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    q = 1 / (1 + F.exp(-F.log(p / (1 - p)) / F.col("temperature")))
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), q))
    loss = -(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))
    each = grid_rows.groupBy(*by, "temperature").agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("nll"))
    best = each.groupBy(*by).agg(F.min(F.struct(F.round("nll", 12).alias("nll"), "temperature")).alias("best"))
    return best.select(*by, F.col("best.temperature").alias("temperature"), F.col("best.nll").alias("nll"))


def bootstrap_ci(values: list[float], draws: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Percentile bootstrap interval of the mean; NaN without values, the value itself if there is one."""
    v = np.asarray([x for x in values if x is not None and x == x], dtype=float)
    if len(v) < 2:
        return (float(v[0]), float(v[0])) if len(v) else (float("nan"), float("nan"))
    rng = np.random.default_rng(seed)
    rows = max(1, 4_000_000 // len(v))  # the index matrix comes in slices of bounded size, from one stream
    means = np.concatenate([v[rng.integers(0, len(v), size=(min(rows, draws - i), len(v)))].mean(axis=1) for i in range(0, draws, rows)])
    lo, hi = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(lo), float(hi)


def bootstrap_by(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Interval of the mean of a measure for each group, over the rows in a stated order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = bootstrap_ci(pdf.sort_values(order)[value].tolist())
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, "n": int(pdf[value].notna().sum()), "lo": lo, "hi": hi}])

    kinds = dict(rows.dtypes)
    return rows.groupBy(*by).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in by), "n long", "lo double", "hi double"]))


def gate(arms: DataFrame, key: str, off: str, on: str, measure: str, other: str, least_gain: float = 0.0, most_loss: float = 0.0) -> DataFrame:
    """A paired A/B gate over arms(key, arm, measures): deltas, both clauses and whether both hold."""
    take = lambda arm, m: F.max(F.when(F.col("arm") == arm, F.col(m)))
    out = arms.groupBy(key).agg((take(on, measure) - take(off, measure)).alias("gain"), (take(off, other) - take(on, other)).alias("loss"))
    ok = (F.col("gain") >= least_gain).alias("gain_ok"), (F.col("loss") <= most_loss).alias("loss_ok")
    return out.select(key, "gain", "loss", *ok, ((F.col("gain") >= least_gain) & (F.col("loss") <= most_loss)).alias("pass"))
