"""Evidence from re-reads and second models, page decisions and upload checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

from . import flags as FL


def digit_repass(tokens: DataFrame, reads: DataFrame, bar: float = 95.0, most: int = 40, page: str = "doc_id") -> DataFrame:
    """The first `most` digit tokens of a page below the bar, joined to reads(page, pos, read): other digits are a conflict."""
    w = Window.partitionBy(page).orderBy("pos")
    asked = tokens.where(T.has_digit(F.col("text")) & (F.col("conf") < bar)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")
    met = asked.join(reads, [page, "pos"], "left")
    conflict = F.col("read").isNotNull() & (T.digits_only(F.col("read")) != T.digits_only(F.col("text")))
    return met.withColumns({"conflict": F.coalesce(conflict, F.lit(False)), "alt_text": F.when(conflict, F.col("read"))})


def suspects(tokens: DataFrame, most: int = 12, aspect: float = 8.0, page: str = "doc_id") -> DataFrame:
    """Flagged digit tokens whose box isn't too wide, the riskiest ones of a page."""
    wide = (F.col("x1") - F.col("x0")) <= aspect * (F.col("y1") - F.col("y0"))
    w = Window.partitionBy(page).orderBy(F.desc("risk"), "y0", "x0", "pos")
    rows = tokens.where(T.has_digit(F.col("text")) & (F.size("flags") > 0) & (F.col("y1") > F.col("y0")) & wide).withColumn("risk", FL.risk(F.col("flags")))
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def verifier_conflicts(asked: DataFrame, reads: DataFrame, page: str = "doc_id") -> DataFrame:
    """Suspects whose second reading has digits, and other ones: read becomes alt_text."""
    d = T.digits_only(F.col("read"))
    return asked.join(reads, [page, "pos"]).where((d != "") & (d != T.digits_only(F.col("text")))).withColumn("alt_text", F.trim("read"))


def multi_read(asked: DataFrame, reads: DataFrame, page: str = "doc_id") -> DataFrame:
    """Per suspect the panel's verdict over reads(page, pos, source, read): agree, split or unreadable."""
    d = T.digits_only(F.col("read"))
    own = T.digits_only(F.col("text"))
    met = asked.join(reads, [page, "pos"], "left").groupBy(page, "pos").agg(F.count(F.when(d != "", 1)).alias("valid"), F.count(F.when((d != "") & (d != own), 1)).alias("other"))
    return met.withColumn("verdict", F.when(F.col("valid") == 0, "unreadable").when(F.col("other") > 0, "split").otherwise("agree"))


def page_shape(tokens: DataFrame, page: str = "doc_id") -> DataFrame:
    """Per page: whether it is made of text lines (median aspect of 5 and a quarter of the width), and the share of
    upright boxes, 0 with fewer than five tokens."""
    w, h = F.col("x1") - F.col("x0"), F.greatest(F.col("y1") - F.col("y0"), F.lit(1))
    got = tokens.groupBy(page).agg(F.count("*").alias("n"), F.percentile(w / h, F.lit(0.5)).alias("aspect"), F.percentile(w, F.lit(0.5)).alias("width"), F.max("x1").alias("page_width"), F.avg((h / F.greatest(w, F.lit(1)) >= 1.5).cast("double")).alias("tall"))
    tall = F.when(F.col("n") < 5, 0.0).otherwise(F.col("tall"))
    return got.select(page, ((F.col("aspect") >= 5) & (F.col("width") >= 0.25 * F.col("page_width"))).alias("line_like"), tall.alias("vertical"), (tall >= 0.6).alias("suspect"))


def osd_rotation(rotate: Column, confidence: Column, side: Column) -> Column:
    """What an orientation report asks for: small pages are skipped, low confidence and half turns don't count."""
    return F.when(side < 1500, "skipped").when(confidence < 3, "low_confidence").when(rotate == 180, "not_applied").when(rotate == 0, "upright").otherwise("rotate")


def upload_error(name: Column, content: Column, most: int = 20_000_000, megapixels: int = 40, least: int = 64) -> Column:
    """The first rule that an upload breaks, or null: extension, empty, size, magic, and of images whose header tells their
    size (PNG, BMP) decode, megapixels, small."""
    from quirefold.functions.images import image_size

    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    head = F.hex(F.substring(content, 1, 4))
    side = image_size(content)
    magic = F.when(ext == "pdf", head == "25504446").when(ext == "png", head == "89504E47").when(ext.isin("jpg", "jpeg"), head.startswith("FFD8FF")).otherwise(F.lit(True))
    return F.when(~ext.isin("pdf", "png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp"), "extension").when(F.octet_length(content) == 0, "empty").when(F.octet_length(content) > most, "size").when(~magic, "magic").when(ext.isin("png", "bmp") & side.isNull(), "decode").when(side["width"] * side["height"] > megapixels * 1_000_000, "megapixels").when((side["width"] < least) | (side["height"] < least), "small")


def digit_added(engine: Column, reader: Column) -> Column:
    return ~T.has_digit(engine) & T.has_digit(reader)


def reader_plausible(text: Column) -> Column:
    return F.length(text).between(1, 64)


def router_verdict(**clauses: Column) -> list[Column]:
    """The clauses and whether all hold."""
    every = list(clauses.values())
    passed = every[0]
    for c in every[1:]:
        passed = passed & c
    return [*(c.alias(k) for k, c in clauses.items()), passed.alias("pass")]


def confusion_chips(queue: DataFrame, values: DataFrame, most: int = 10, page: str = "doc_id") -> DataFrame:
    """Chips for the riskiest digit tokens of queue(page, pos, text, rn); values(page, value) occur on the page."""
    w = Window.partitionBy(page).orderBy("rn")
    top = queue.where(T.has_digit(F.col("text"))).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    known = values.groupBy(page).agg(F.collect_set("value").alias("page_values"))
    return top.join(known, page, "left").select(page, "pos", "text", T.digit_confusions(F.col("text"), F.coalesce("page_values", F.array().cast("array<string>"))).alias("chips"))


def error_taxonomy(pairs: DataFrame, book: str, page: str) -> DataFrame:
    """Counts per kind of error of pairs(book, page, gt, hyp) for each page, each book and all: a rollup."""
    kinds = pairs.where("gt <> hyp").withColumn("kind", T.token_error_kind(F.col("gt"), F.col("hyp")))
    return kinds.rollup(book, page, "kind").agg(F.count("*").alias("n")).where("kind is not null or " + book + " is null").select(book, page, "kind", "n")


def near_best(configs: DataFrame, key: str, recall: str, precision: str, baseline: float, slack: float = 0.005) -> DataFrame:
    """The configuration of the best recall among those whose precision is within slack of the baseline's; ties within
    slack of the best recall go to the higher precision, then the larger key."""
    fit = configs.where(F.col(precision) >= baseline - slack)
    best = fit.agg(F.max(recall).alias("_best"))
    return fit.join(F.broadcast(best), F.col(recall) >= F.col("_best") - slack).agg(F.max_by(F.struct(key, recall, precision), F.struct(precision, key)).alias("b")).select("b.*")


def verifier_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of rows(truth, engine, verifier): conflicts and who is right."""
    c = F.col
    conflict = c("verifier") != c("engine")
    n = lambda x, name: F.count(F.when(conflict & x, 1)).alias(name)
    out = rows.groupBy(*by).agg(F.count(F.when(conflict, 1)).alias("conflicts"), n(c("engine") == c("truth"), "engine_right"), n(c("verifier") == c("truth"), "fixes"), n((c("engine") != c("truth")) & (c("verifier") != c("truth")), "both_wrong"))
    return out.withColumn("precision", F.when(c("conflicts") > 0, (c("conflicts") - c("engine_right")) / c("conflicts")))
