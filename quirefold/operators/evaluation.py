"""Evaluation of readings: validity of the truth, digit errors, models, gates and sessions, as grouped aggregates."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions.edits import opcodes

from . import flags as FL
from .joins import met as met_by_page
from .metrics import ratio


def count_if(clause: Column, name: str) -> Column:
    return F.count(F.when(clause, 1)).alias(name)


def validity_report(texts: DataFrame, by: list[str], order: str, text: str = "text", first: int = 20) -> DataFrame:
    """Per group of texts: tokens, Devanagari tokens, invalid ones, their share, and the first invalid ones in order.

    Examples come from the first texts that have any, so a group's list is bounded however many texts it has.
    """
    rows = texts.select(*by, order, T.devanagari_validity(F.col(text)).alias("v"))
    n = lambda name: F.sum(f"v.{name}").alias(name)
    sums = rows.groupBy(*by).agg(F.count("*").alias("texts"), count_if(F.col("v.invalid_tokens") > 0, "texts_with_invalid"), n("tokens"), n("devanagari_tokens"), n("invalid_tokens"))
    place = Window.partitionBy(*by).orderBy(order)
    bad = rows.where("v.invalid_tokens > 0").withColumn("k", F.row_number().over(place)).where(F.col("k") <= first)
    found = bad.groupBy(*by).agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "v.examples"))), lambda x: x["examples"])), 1, first).alias("examples"))
    out = sums.join(found, by, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    return out.withColumn("invalid_token_rate", ratio(F.col("invalid_tokens"), F.col("devanagari_tokens"), 0.0))


def valid_truth_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per row of pairs(keys, gt, hyp): recall over the truth's valid tokens, each as often as it occurs, and the share of
    read tokens that are neither valid nor invalid truth. Tokens of both sides meet in one grouped aggregate."""
    side = lambda text, read: F.transform(T.tokens(F.col(text)), lambda w: F.struct(w.alias("w"), F.lit(read).alias("read")))
    none = F.array().cast("array<struct<w:string,read:boolean>>")
    each = pairs.select(*keys, F.inline(F.concat(F.coalesce(side("gt", False), none), F.coalesce(side("hyp", True), none))))
    kind = F.when(F.col("read"), "h").when(T.invalid_devanagari(F.col("w")), "i").otherwise("v")
    each = each.select(*keys, T.norm_token(F.col("w")).alias("t"), kind.alias("kind")).where("t <> ''")
    met = each.groupBy(*keys, "t").agg(*(F.count(F.when(F.col("kind") == c, 1)).alias(c) for c in "vih"))
    sums = met.groupBy(*keys).agg(
        F.sum("v").alias("gt_valid_tokens"), F.sum("i").alias("gt_invalid_tokens"), F.sum("h").alias("hyp_tokens"),
        F.sum(F.when(F.col("h") > 0, F.col("v")).otherwise(0)).alias("matched"), F.sum(F.when(F.col("v") + F.col("i") == 0, F.col("h")).otherwise(0)).alias("unmatched_tokens"),
    )
    out = pairs.select(*keys).join(sums, keys, "left").fillna(0)
    return out.withColumns({"valid_recall": ratio(F.col("matched"), F.col("gt_valid_tokens"), 0.0), "unmatched_rate": ratio(F.col("unmatched_tokens"), F.col("hyp_tokens"), 0.0)})


KINDS = ("digit", "order", "matra", "consonant", "other", "missing", "invented", "segmentation")


def token_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Kinds of differences of pairs(keys, gt, hyp) by an alignment of their tokens: (keys, op, gt, hyp) for each run of
    tokens that differs, gt and hyp joined by blanks; see diff_kinds."""
    kinds = dict(pairs.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a, b = list(row["g"]), list(row["h"])
                for op, i, j, k, n in opcodes(a, b):
                    if op != "equal":
                        out.append((*(row[c] for c in keys), op, j - i, n - k, " ".join(a[i:j]), " ".join(b[k:n])))
            yield pd.DataFrame(out, columns=[*keys, "op", "n_gt", "n_hyp", "gt", "hyp"])

    norm = lambda c: T.norm_tokens(F.col(c))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "op string, n_gt long, n_hyp long, gt string, hyp string"])
    return pairs.select(*keys, norm("gt").alias("g"), norm("hyp").alias("h")).mapInPandas(run, schema)


def diff_kinds(diffs: DataFrame, by: list[str]) -> DataFrame:
    """Counts of token_diff's rows per group: one token for one has a kind (unrelated ones are missing and invented), lost
    and added tokens count each, anything else is a segmentation error."""
    one = (F.col("op") == "replace") & (F.col("n_gt") == 1) & (F.col("n_hyp") == 1)
    kind = F.when(one, T.token_error_kind(F.col("gt"), F.col("hyp")))
    n = lambda clause, amount=1: F.sum(F.when(clause, amount).otherwise(0))
    rows = diffs.withColumn("kind", kind)
    apart = F.col("kind") == "unrelated"
    aggs = [n(F.col("kind") == k).alias(k) for k in KINDS[:5]]
    aggs.append((n(F.col("op") == "delete", F.col("n_gt")) + n(apart)).alias("missing"))
    aggs.append((n(F.col("op") == "insert", F.col("n_hyp")) + n(apart)).alias("invented"))
    aggs.append(n((F.col("op") == "replace") & ~one).alias("segmentation"))
    return rows.groupBy(*by).agg(*aggs)


def digit_errors(tokens: DataFrame, texts: DataFrame, page: str = "doc_id") -> DataFrame:
    """tokens with digit_error: whether a token's digits aren't those of any digit token of its page's texts(page, text)."""
    known = texts.select(page, F.explode(T.digit_tokens(F.col("text"))).alias("w")).select(page, T.digit_string(F.col("w")).alias("ds")).where("ds <> ''").distinct().withColumn("known", F.lit(True))
    own = tokens.withColumn("ds", F.when(T.has_digit(F.col("text")), T.digit_string(F.col("text"))))
    wrong = F.coalesce(F.col("ds") != "", F.lit(False)) & F.col("known").isNull()
    return met_by_page(own, known, [page, "ds"], "left").withColumn("digit_error", wrong).drop("known", "ds")


def digit_queue(tokens: DataFrame, ranks: tuple[int, ...] = (5, 10), page: str = "doc_id") -> DataFrame:
    """Per page of tokens(digit_error, rn: rank in the review queue or null): digit errors, queue, and hits and length of
    the queue's top."""
    aggs = [count_if(F.col("digit_error"), "digit_errors"), count_if(F.col("rn").isNotNull(), "queue")]
    for k in ranks:
        aggs += [count_if(F.col("digit_error") & (F.col("rn") <= k), f"hits_{k}"), count_if(F.col("rn") <= k, f"top_{k}")]
    return tokens.groupBy(page).agg(*aggs)


def digit_summary(pages: DataFrame, by: list[str], ranks: tuple[int, ...] = (5, 10), only_with_errors: bool = True) -> DataFrame:
    """Digit recall and precision at ranks over digit_queue's pages: all of them, or those with digit errors only (two
    conventions; the second leaves the queues of pages without errors out of the precision)."""
    rows = pages.where("digit_errors > 0") if only_with_errors else pages
    aggs = [F.count("*").alias("pages"), F.sum("digit_errors").alias("digit_errors")]
    for k in ranks:
        aggs += [ratio(F.sum(f"hits_{k}"), F.sum("digit_errors"), None).alias(f"digit_recall_{k}"), ratio(F.sum(f"hits_{k}"), F.sum(f"top_{k}"), None).alias(f"digit_precision_{k}")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def lexicon_sweep(tokens: DataFrame, shares: list[float], weights: list[float], page: str = "doc_id", top: int = 10) -> DataFrame:
    """Queue quality of each configuration (share, weight) of the unknown-word flag: tokens(flags without it, words, oov,
    wrong, digit_error) are flagged where at least that share of their words is unknown. One pass for all configurations:
    tokens meet the grid, queues are ranked per configuration and page."""
    grid = [(s, w) for s in shares for w in weights]
    configs = F.array(*(F.struct(F.lit(float(s)).alias("share"), F.lit(float(w)).alias("weight")) for s, w in grid))
    rows = tokens.select(page, "pos", "y0", "x0", "flags", "words", "oov", "wrong", "digit_error", FL.risk(F.col("flags")).alias("risk")).withColumn("_g", F.explode(configs)).select("*", "_g.share", "_g.weight").drop("_g")
    unknown = (F.col("oov") > 0) & (F.col("oov") >= F.col("share") * F.col("words"))
    rows = rows.withColumn("unknown", unknown).withColumn("risk", F.col("risk") + F.when(unknown, F.col("weight")).otherwise(0.0))
    held = unknown | (F.size("flags") > 0)
    place = Window.partitionBy("share", "weight", page, held).orderBy(F.desc("risk"), "y0", "x0", "pos")
    rows = rows.withColumn("rn", F.when(held, F.row_number().over(place)))
    near = F.col("rn") <= top
    out = rows.groupBy("share", "weight").agg(
        F.count("*").alias("tokens"), count_if(unknown, "unknown_word_tokens"), count_if(held, "flagged_tokens"), count_if(F.col("wrong"), "token_errors"),
        count_if(F.col("wrong") & near, "token_hits"), count_if(F.col("digit_error"), "digit_errors"), count_if(F.col("digit_error") & near, "digit_hits"), count_if(near, "top"),
    )
    c = F.col
    return out.withColumns({
        "token_recall": ratio(c("token_hits"), c("token_errors"), None), "token_precision": ratio(c("token_hits"), c("top"), None),
        "digit_recall": ratio(c("digit_hits"), c("digit_errors"), None), "digit_precision": ratio(c("digit_hits"), c("top"), None),
    })


def line_scores(lines: DataFrame, by: list[str]) -> DataFrame:
    """Scores of lines(gt, hyp) per group: mean and median error, share that is hopeless (1 or more), exact lines, digits
    right among lines with digits, empty readings."""
    rows = lines.withColumns({"cer": T.cer(F.col("gt"), F.col("hyp")), "digits": T.digit_string(F.col("gt")) != "", "right": T.digit_string(F.col("gt")) == T.digit_string(F.col("hyp"))})
    share = lambda clause: F.avg(clause.cast("double"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("lines"), F.avg("cer").alias("cer"), F.percentile("cer", F.lit(0.5)).alias("cer_median"), share(F.col("cer") >= 1).alias("catastrophic_rate"),
        share(F.col("cer") == 0).alias("exact_match"), count_if(F.col("digits"), "digit_lines"), F.avg(F.when(F.col("digits"), F.col("right").cast("double"))).alias("digit_exact_rate"),
        count_if(F.trim(F.regexp_replace("hyp", T.WHITE, " ")) == "", "empty_outputs"),
    )


def gate_lines(lines: DataFrame, by: list[str]) -> DataFrame:
    """A recogniser gate's measures over lines(gt, hyp) whose truth isn't blank."""
    rows = lines.where(T.normalize(F.col("gt")) != "")
    digits = F.size(T.digit_tokens(F.col("gt"))) > 0
    right = (T.digit_string(F.col("gt")) == T.digit_string(F.col("hyp"))).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("lines"), count_if(digits, "digit_lines"), F.avg(F.when(digits, right)).alias("digit_exact"), F.avg(T.cer(F.col("gt"), F.col("hyp"))).alias("cer"), F.avg(T.cer_bag(F.col("gt"), F.col("hyp"))).alias("bagcer"))


def line_summary(lines: DataFrame, by: list[str]) -> DataFrame:
    """Evaluation of lines(gt, hyp, seconds): errors of characters and of the digit tokens of lines that have some, exact
    lines, empty readings, seconds a line."""
    digits = F.size(T.digit_tokens(F.col("gt"))) > 0
    rows = lines.withColumn("cer", T.cer(F.col("gt"), F.col("hyp")))
    return rows.groupBy(*by).agg(
        F.count("*").alias("lines"), F.avg("cer").alias("cer"), F.percentile("cer", F.lit(0.5)).alias("cer_median"), F.avg((F.col("cer") == 0).cast("double")).alias("exact_match"),
        count_if(digits, "digit_lines"), F.avg(F.when(digits, T.digit_cer(F.col("gt"), F.col("hyp")))).alias("digit_cer"), F.avg("seconds").alias("seconds_per_line"), count_if(T.normalize(F.col("hyp")) == "", "empty_outputs"),
    )


def arms(methods: list[str], backends: list[str], photo: bool = False) -> list[tuple[str, str]]:
    """Methods with backends, without the photo method unless it is asked for."""
    return [(m, b) for m in methods if photo or m != "photo" for b in backends]


def peer_inventions(readings: DataFrame, truth: DataFrame, page: str = "doc_id") -> DataFrame:
    """Per method and backend of readings(page, backend, method, text): tokens, and those that are neither in truth(page, t)
    nor in any other method's reading of the page by that backend, all and with digits. Methods meet in one grouped
    aggregate per token, so no two readings are joined."""
    each = readings.select(page, "backend", "method", F.explode(T.tokens(F.col("text"))).alias("w")).withColumn("t", T.norm_token(F.col("w")))
    sums = each.groupBy(page, "backend", "t", "method").agg(F.count("*").alias("n"), count_if(T.has_digit(F.col("w")), "d"))
    token = Window.partitionBy(page, "backend", "t")
    alone = met_by_page(sums.withColumn("methods", F.count("*").over(token)), truth.select(page, "t").distinct().withColumn("known", F.lit(1)), [page, "t"], "left")
    odd = F.col("known").isNull() & (F.col("methods") == 1)
    out = alone.groupBy("backend", "method").agg(F.sum("n").alias("tokens"), F.sum(F.when(odd, F.col("n")).otherwise(0)).alias("invented"), F.sum(F.when(odd, F.col("d")).otherwise(0)).alias("invented_digits"))
    return out.withColumn("invented_rate", F.col("invented") / F.greatest(F.col("tokens"), F.lit(1)))


def arm_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Evaluation per method and backend over pages(cer, tokens, errors, flagged_errors, digit_errors, digit_flagged,
    digit_flagged_errors, seconds): means of pages, and rates as ratios of sums."""
    s = lambda c: F.sum(c)
    return rows.groupBy(*by).agg(
        F.count("*").alias("pages"), F.avg("cer").alias("cer"), F.percentile("cer", F.lit(0.5)).alias("cer_median"), s("tokens").alias("tokens"), s("errors").alias("errors"),
        ratio(s("flagged_errors"), s("errors"), 1.0).alias("coverage"), ratio(s("digit_flagged_errors"), s("digit_errors"), 1.0).alias("digit_coverage"),
        ratio(s("digit_flagged") - s("digit_flagged_errors"), s("digit_flagged"), 0.0).alias("digit_false_alarm_rate"), F.avg("seconds").alias("seconds"),
    )


def angle_histogram(pages: DataFrame) -> DataFrame:
    """Pages per decided angle, null as 'None'."""
    return pages.groupBy(F.coalesce(F.col("angle").cast("string"), F.lit("None")).alias("angle")).agg(F.count("*").alias("pages"))


def audit_rates(pages: DataFrame, by: list[str]) -> DataFrame:
    """Behaviour without scores over pages(suspect, changed, flagged, tokens, seconds)."""
    share = lambda clause: F.avg(clause.cast("double"))
    middle = lambda c: F.percentile(c, F.lit(0.5)).alias(f"{c}_median")
    return pages.groupBy(*by).agg(F.count("*").alias("pages"), share(F.col("suspect")).alias("suspect_rate"), share(~F.col("changed")).alias("identity_rate"), share(F.col("flagged") > 0).alias("flagged_rate"), middle("tokens"), middle("seconds"))


#: Slack of the routed page's error and seconds a page.
CER_SLACK, COST_SECONDS = 1.02, 1.0


def router_gates(cer_plain: Column, cer_routed: Column, psnr_routed: Column, psnr_naive: Column, invented: Column, seconds: Column) -> dict[str, Column]:
    """A routed page's gates: its text isn't worse, what isn't text is closer to the photo, nothing is invented, it is fast."""
    return {"text": cer_routed <= cer_plain * CER_SLACK + 1e-9, "non_text": psnr_routed + 1e-9 >= psnr_naive, "invented_ok": invented == 0, "cost": seconds <= COST_SECONDS}


def router_summary(pages: DataFrame, by: list[str]) -> DataFrame:
    """Means over pages, and whether each gate holds on all of them."""
    gates = ("text", "non_text", "invented_ok", "cost")
    out = pages.groupBy(*by).agg(F.count("*").alias("pages"), *(F.avg(c).alias(c) for c in ("cer_plain", "cer_routed", "psnr_naive")), F.sum("invented").alias("invented"), *(F.bool_and(g).alias(g) for g in gates))
    passed = F.col(gates[0])
    for g in gates[1:]:
        passed = passed & F.col(g)
    return out.withColumn("pass", passed)


def anchor_scores(verified: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages that a human verified(page, gt) against rows(page, worksheet, hyp): character, bag and digit errors of those
    on the worksheet, with status 'scored'; others are 'stale', as their selection has passed."""
    met = verified.join(rows, "page").withColumn("status", F.when(F.col("worksheet"), "scored").otherwise("stale"))
    scored = lambda c: F.when(F.col("worksheet"), c)
    gt, hyp = T.normalize(F.col("gt")), F.col("hyp")
    return met.select("page", "status", scored(T.cer(gt, hyp)).alias("cer"), scored(T.cer_bag(gt, hyp)).alias("cer_bag"), scored(T.digit_cer(gt, hyp)).alias("digit_cer"))


def anchor_summary(scores: DataFrame, rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row: verified pages and their mean errors; pages that readings agree on, and how far."""
    a = scores.agg(count_if(F.col("status") == "scored", "verified_pages"), F.avg("cer").alias("cer"), F.avg("cer_bag").alias("cer_bag"), F.avg("digit_cer").alias("digit_cer"))
    agreed = rows.where(F.col("agreement_rate") >= threshold)
    b = agreed.agg(F.count("*").alias("consensus_pages"), F.avg("agreement_rate").alias("consensus_mean_agreement"))
    return a.join(F.broadcast(b))  # one row each


def orientation_votes(lines: DataFrame, page: str, sure: float = 0.9) -> DataFrame:
    """Per page of lines(label, score): share that votes for a half turn, share that does so surely, and votes."""
    turned = F.col("label") == "180"
    return lines.groupBy(page).agg(F.avg(turned.cast("double")).alias("turned"), F.avg((turned & (F.col("score") >= sure)).cast("double")).alias("surely"), F.count("*").alias("votes"))


def arm_measures(tokens: DataFrame, flag: str, by: list[str], ranks: tuple[int, ...] = (5, 10), page: str = "doc_id") -> DataFrame:
    """An experiment's arm over tokens(flags, digit_error, rn): how often a flag fires, on digits, and rightly; its precision
    and its recall over digit errors; the queue's."""
    own = F.array_contains("flags", flag)
    digit = own & T.has_digit(F.col("text"))
    aggs = [count_if(F.col("digit_error"), "digit_errors"), count_if(F.col("rn").isNotNull(), "queue"), count_if(own, "flagged"), count_if(digit, "flagged_digits"), count_if(digit & F.col("digit_error"), "true_flagged")]
    for k in ranks:
        aggs += [count_if(F.col("digit_error") & (F.col("rn") <= k), f"hits_{k}"), count_if(F.col("rn") <= k, f"top_{k}")]
    out = tokens.groupBy(*by).agg(F.countDistinct(page).alias("pages"), *aggs)
    c = F.col
    rates = {"flag_precision": ratio(c("true_flagged"), c("flagged_digits"), None), "flag_digit_recall": ratio(c("true_flagged"), c("digit_errors"), None)}
    for k in ranks:
        rates |= {f"digit_recall_{k}": ratio(c(f"hits_{k}"), c("digit_errors"), None), f"digit_precision_{k}": ratio(c(f"hits_{k}"), c(f"top_{k}"), None)}
    return out.withColumns(rates)


def policy_measures(pages: DataFrame, by: list[str]) -> DataFrame:
    """A reader policy over pages(cer, cer_bag, digit_exact, flagged, invented, digit_inventions, digit_inventions_flagged)."""
    s = lambda c: F.sum(c).alias(c)
    out = pages.groupBy(*by).agg(F.count("*").alias("pages"), F.avg("cer").alias("cer"), F.avg("cer_bag").alias("cer_bag"), F.avg(F.col("digit_exact").cast("double")).alias("digit_exact_pages"), s("flagged"), s("invented"), s("digit_inventions"), s("digit_inventions_flagged"))
    return out.withColumn("silent_inventions", F.col("digit_inventions") - F.col("digit_inventions_flagged"))
