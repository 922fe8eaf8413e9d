"""Review sessions: edits, corrections against a queue, their records, exports and reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T

from . import flags as FL
from .metrics import ratio

BOX = ("x0", "y0", "x1", "y1")
KIND, VERSION = "corrections", 1


def error(*parts) -> Column:
    return F.raise_error(F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))


def compose(edits: DataFrame, queue: DataFrame, keys: list[str]) -> DataFrame:
    """Corrections from edits(keys, line, index, action, text) and the queue(keys, index, text, box) they are about, which
    gives the box and the original. An index that isn't in the queue is an error that names the edit's line."""
    asked = queue.select(*keys, "index", F.col("text").alias("original"), *BOX)
    met = edits.withColumnRenamed("text", "typed").join(asked, [*keys, "index"], "left")
    known = F.when(F.col("original").isNotNull(), F.col("original")).otherwise(error("line ", F.col("line").cast("string"), ": index ", F.col("index").cast("string"), " is not in the queue").cast("string"))
    met = met.withColumn("original", known)
    return met.select(*keys, "index", "original", T.canonical_label(F.col("action"), F.col("original"), F.col("typed")).alias("corrected"), "action", *BOX)


def fresh_entries(parsed: DataFrame, raw: DataFrame, seen: DataFrame, run: str = "run") -> DataFrame:
    """Of parsed(run, index, original, corrected, action) those that seen doesn't have, nulls being equal, with what the
    last raw(run, seq, index, suggested) entry of their index says."""
    four = ("index", "original", "corrected", "action")
    old = seen.select(F.col(run).alias("_run"), *(F.col(c).alias(f"_{c}") for c in four))
    same = F.col(run) == F.col("_run")
    for c in four:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    last = raw.where("index is not null").groupBy(run, "index").agg(F.max_by("suggested", "seq").alias("suggested"))
    return parsed.join(old, same, "left_anti").join(last, [run, "index"], "left")


def readings_or_truth(pages: DataFrame, readings: DataFrame, page: str = "page") -> DataFrame:
    """pages(page, gt) with the anchor's reading where there is one that isn't blank, else the file's truth; pages without
    either are left out."""
    own = F.when(T.normalize(F.col("reading")) != "", F.col("reading"))
    met = pages.join(readings.select(page, "reading"), page, "left").withColumn("gt", F.coalesce(own, F.col("gt"), F.lit(""))).drop("reading")
    return met.where(T.normalize(F.col("gt")) != "")


def targets(queue: DataFrame, applied: DataFrame, keys: list[str]) -> DataFrame:
    """queue(keys, index, text) with the text that its reviewer settled on: the correction, or the original where it was
    confirmed; null where nobody acted."""
    acts = applied.select(*keys, "index", "action", "original", "corrected")
    met = queue.join(acts, [*keys, "index"], "left")
    return met.withColumn("target", F.when(F.col("action") == "changed", F.coalesce("corrected", F.lit(""))).when(F.col("action").isNotNull(), F.coalesce("original", "text"))).drop("action", "original", "corrected")


def session_queue(tokens: DataFrame, frozen: DataFrame, page: str = "doc_id") -> DataFrame:
    """Queue snapshots of pages for a review session: index, text, flags, conf and risk to two places, box and rank. Pages
    of a frozen evaluation set, frozen(page), are refused."""
    rows = FL.review_queue(tokens.join(frozen.select(page).distinct(), page, "left_anti"), page)
    return rows.select(page, F.col("pos").alias("index"), "text", "flags", F.round("conf", 2).alias("conf"), F.round("risk", 2).alias("risk"), *BOX, "rn")


def session_stats(queue: DataFrame, statuses: DataFrame, keys: list[str], bar: float = 0.2) -> DataFrame:
    """Per session: rows queued, corrections changed, confirmed and skipped (statuses(keys, status)), the share of the queue
    that was acted on, and whether that reaches the bar."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    acts = statuses.groupBy(*keys).agg(n("changed"), n("confirmed"), n("skipped"))
    out = queue.groupBy(*keys).agg(F.count("*").alias("queued")).join(acts, keys, "left").fillna(0, ["changed", "confirmed", "skipped"])
    acted = F.col("changed") + F.col("confirmed")
    return out.withColumns({"acted_fraction": ratio(acted, F.col("queued"), None), "bar_met": acted >= bar * F.col("queued")})


def session_report(stats: DataFrame) -> DataFrame:
    """One row over all sessions of session_stats."""
    s = lambda c: F.sum(c).alias(c)
    acted = F.sum(F.col("changed") + F.col("confirmed"))
    return stats.agg(F.count("*").alias("sessions"), s("queued"), s("changed"), s("confirmed"), s("skipped"), acted.alias("acted"), ratio(acted, F.sum("queued"), None).alias("acted_fraction"), F.count(F.when(F.col("bar_met"), 1)).alias("sessions_meeting_bar"))


def import_labels(tokens: DataFrame, page: str = "doc_id") -> DataFrame:
    """Training labels from reviewed tokens: a human's corrections that aren't empty and have digits, with file names."""
    rows = tokens.where((F.col("corrected_by") == "human") & (F.coalesce("text", F.lit("")) != "") & T.has_digit(F.col("text")))
    return rows.select(label_name(F.col(page), F.col("pos")).alias("file"), "text", page, "pos")


def label_name(page: Column, index: Column) -> Column:
    return F.concat(page.cast("string"), F.lit("_"), F.lpad(index.cast("string"), 4, "0"), F.lit(".png"))


def shared_labels(corrections: DataFrame, shared: DataFrame, page: str = "doc_id") -> DataFrame:
    """Labels (file, text) of the corrections whose index their owner shared(page, index), and no others; without a box
    there is no crop and no label."""
    rows = corrections.join(shared.select(page, "index").distinct(), [page, "index"], "left_semi").where("x0 is not null")
    empty = F.lit("")
    changed = (F.col("action") != "confirmed") & (F.coalesce("corrected", empty) != "")
    label = F.when(changed, F.col("corrected")).otherwise(F.coalesce(F.nullif("original", empty), F.col("corrected")))
    return rows.select(label_name(F.col(page), F.col("index")).alias("file"), label.alias("text"))


def corrections_record(applied: DataFrame, page: str = "doc_id") -> DataFrame:
    """One JSON record per page of applied(page, index, original, corrected, action, box, status): kind, version, counts of
    statuses and the corrections in order of index."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    box = F.when(F.col("x0").isNotNull(), F.array(*BOX))
    item = F.struct("index", box.alias("bbox"), "original", "corrected", "action")
    got = applied.groupBy(page).agg(n("changed"), n("confirmed"), n("skipped"), F.array_sort(F.collect_list(item)).alias("applied"))
    body = F.struct(F.lit(KIND).alias("kind"), F.lit(VERSION).alias("version"), F.col(page).alias("page"), F.struct("changed", "confirmed", "skipped").alias("stats"), "applied")
    return got.select(page, F.to_json(body).alias("json"))


def run_summary(tokens: DataFrame, corrected: DataFrame, page: str = "doc_id") -> DataFrame:
    """Per page: tokens, rows to review, counts of flags and the transcript. Where a page has corrected tokens they are the
    truth, and its original ones don't count."""
    mine = tokens.join(corrected.select(page).distinct(), page, "left_anti")
    cols = [page, "pos", "text", "flags"]
    rows = mine.select(*cols).unionByName(corrected.select(*cols))
    held = rows.groupBy(page).agg(
        F.count("*").alias("n_tokens"), F.count(F.when(F.size("flags") > 0, 1)).alias("review"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text")))), lambda t: t["text"]), "\n").alias("transcript"),
    )
    flags = rows.select(page, F.explode("flags").alias("flag")).groupBy(page, "flag").agg(F.count("*").alias("n"))
    flags = flags.groupBy(page).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("flags_summary"))
    return held.join(flags, page, "left")


def status_line(tokens: DataFrame, page: str = "doc_id") -> DataFrame:
    """One line per page of tokens(flags), with pages' conflicts, suspicion and seconds where tokens carry them."""
    has = lambda f: F.count(F.when(F.array_contains("flags", f), 1))
    got = tokens.groupBy(page).agg(F.count("*").alias("n"), has("low_conf").alias("low"), has("digit_conflict").alias("conflicts"), F.count(F.when(F.size("flags") > 0, 1)).alias("review"), F.max("suspect").alias("suspect"), F.max("seconds").alias("seconds"))
    text = lambda c: F.col(c).cast("string")
    dot = " · "
    return got.select(page, F.concat(text("n"), F.lit(f" tokens{dot}"), text("low"), F.lit(f" low-confidence{dot}"), text("conflicts"), F.lit(f" digit conflicts{dot}"), text("review"), F.lit(" to review"), F.when(F.col("suspect"), f"{dot}orientation?").otherwise(""), F.lit(dot), F.format_string("%.1fs", "seconds")).alias("status"))


def repass_default(asked: Column, lang: Column) -> Column:
    """Whether digits are read again: as asked, else on Devanagari pages."""
    return F.coalesce(asked, T.language_alias(F.coalesce(lang, F.lit(""))) == "devanagari")
