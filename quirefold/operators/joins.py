"""Joins of tokens, corrections, boxes and manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how), how being inner or left, for rows that are dealt by the first key, the page. A join on
    several keys would shuffle both sides; here both sides' rows of a page come together by a join on the page alone, and
    by the other keys in a grouped aggregate. No union of dealt rows: Spark 4.1 may take one as dealt that isn't."""
    page, rest = keys[0], keys[1:]
    mine, theirs = ([c for c in df.columns if c not in keys] for df in (left, right))
    kind = lambda df, cols: "struct<" + ",".join(f"`{c}`:{t}" for c, t in df.dtypes if c in cols) + ">"
    none = lambda df, cols: F.lit(None).cast(kind(df, cols))
    pack = lambda df, a, b, name: df.groupBy(page).agg(F.collect_list(F.struct(*rest, a.alias("_l"), b.alias("_r"))).alias(name))
    pages = pack(left, F.struct(*mine), none(right, theirs), "_a").join(pack(right, none(left, mine), F.struct(*theirs), "_b"), page, how)
    rows = pages.select(page, F.inline(F.concat("_a", F.when(F.col("_b").isNotNull(), F.col("_b")).otherwise(F.slice("_a", 1, 0)))))
    whole = F.lit(True)
    for k in rest:
        whole = whole & F.col(k).isNotNull()
    rows = rows.groupBy(*keys).agg(F.collect_list("_l").alias("_l"), F.collect_list(F.when(whole, F.col("_r"))).alias("_r")).where(F.size("_l") > 0)
    expand = F.explode if how == "inner" else F.explode_outer
    rows = rows.select(*keys, F.explode("_l").alias("_l"), "_r").select(*keys, "_l", expand("_r").alias("_r"))
    return rows.select(*keys, *(F.col(f"_l.{c}").alias(c) for c in mine), *(F.col(f"_r.{c}").alias(c) for c in theirs))


def centre(prefix: str = "") -> tuple[Column, Column]:
    c = lambda n: F.col(f"{prefix}{n}")
    return (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def cells(x: Column, y: Column, reach: Column, size: int) -> Column:
    """Grid cells of a size that a square around a point touches."""
    span = lambda v: F.sequence(F.floor((v - reach) / size), F.floor((v + reach) / size))
    return F.flatten(F.transform(span(x), lambda i: F.transform(span(y), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def nearest_digit_conflicts(primary: DataFrame, other: DataFrame, tolerance: float = 1.0, page: str = "doc_id", cell: int = 64) -> DataFrame:
    """Digit tokens whose nearest digit token of another stream, within max(8, height x tolerance), has other digits.

    The nearest one decides, the first on ties; only then its digits are compared. Candidates meet through grid cells,
    so a page's tokens aren't compared in all pairs: a token beyond the tolerance can't be the answer.
    Returns (page, pos, text, alt_text).
    """
    x, y = centre()
    left = primary.where(T.has_digit(F.col("text"))).select(page, "pos", "text", x.alias("cx"), y.alias("cy"), F.greatest(F.lit(8.0), (F.col("y1") - F.col("y0")) * F.lit(tolerance)).alias("tol"))
    left = left.withColumn("cell", F.explode(cells(F.col("cx"), F.col("cy"), F.col("tol"), cell)))
    right = other.where(T.has_digit(F.col("text"))).select(page, F.col("pos").alias("opos"), F.col("text").alias("alt_text"), x.alias("ox"), y.alias("oy"))
    right = right.withColumn("cell", F.struct(F.floor(F.col("ox") / cell).alias("i"), F.floor(F.col("oy") / cell).alias("j")))
    met = left.join(right, [page, "cell"]).withColumn("d", distance(F.col("cx"), F.col("cy"), F.col("ox"), F.col("oy"))).where("d <= tol")
    best = met.groupBy(page, "pos").agg(F.min(F.struct("d", "opos", "alt_text", "text")).alias("b"))
    return best.select(page, "pos", F.col("b.text").alias("text"), F.col("b.alt_text").alias("alt_text")).where(T.digits_only(F.col("text")) != T.digits_only(F.col("alt_text")))


def match_corrections(tokens: DataFrame, corrections: DataFrame, page: str = "doc_id") -> DataFrame:
    """corrections(page, seq, index, original, corrected, action, x0..y1) with pos of the token that each one is for.

    First the token at the index, if the original is empty or equal, or the boxes' centres are within max(8, 3/4
    height); else the first token of the page with the original's text whose centre lies in the padded box; else null.
    """
    t = tokens.select(page, "pos", F.col("text").alias("now"), *(F.col(k).alias(f"t{k}") for k in ("x0", "y0", "x1", "y1")))
    box = F.col("x0").isNotNull()
    by_index = met(corrections, t.withColumn("index", F.col("pos")), [page, "index"], "left")
    tx, ty = centre("t")
    cx, cy = centre()
    close = box & (distance(cx, cy, tx, ty) <= F.greatest(F.lit(8.0), 0.75 * F.greatest(F.lit(1), F.col("ty1") - F.col("ty0"))))
    fits = F.coalesce(F.col("pos").isNotNull() & ((F.coalesce("original", F.lit("")) == "") | (F.col("original") == F.col("now")) | close), F.lit(False))
    first = by_index.withColumn("pos", F.when(fits, F.col("pos"))).drop("now", "tx0", "ty0", "tx1", "ty1")
    open_ = first.where(F.col("pos").isNull() & box).select(page, "seq", "original", "x0", "y0", "x1", "y1")
    pad = F.greatest(F.lit(8.0), 0.5 * (F.col("y1") - F.col("y0")))
    same = ((F.coalesce("original", F.lit("")) == "") | (F.col("original") == F.col("now")))
    inside = tx.between(F.col("x0") - pad, F.col("x1") + pad) & ty.between(F.col("y0") - pad, F.col("y1") + pad)
    side = 64  # padded boxes and centres meet through the cells of a grid, not as all pairs of a page
    span = lambda lo, hi: F.sequence(F.floor(lo / side), F.floor(hi / side))
    wide = open_.withColumn("i", F.explode(span(F.col("x0") - pad, F.col("x1") + pad))).withColumn("j", F.explode(span(F.col("y0") - pad, F.col("y1") + pad)))
    found = met(wide, t.withColumns({"i": F.floor(tx / side), "j": F.floor(ty / side)}), [page, "i", "j"]).where(same & inside).groupBy(page, "seq").agg(F.min("pos").alias("by_box"))
    return met(first, found, [page, "seq"], "left").withColumn("pos", F.coalesce("pos", "by_box")).drop("by_box")


def apply_corrections(tokens: DataFrame, corrections: DataFrame, page: str = "doc_id") -> DataFrame:
    """tokens with the matched corrections applied (the last one of a token wins) and status: changed, confirmed or null."""
    matched = match_corrections(tokens, corrections, page).where("pos is not null")
    last = matched.groupBy(page, "pos").agg(F.max(F.struct("seq", "corrected", "action")).alias("c"))
    out = met(tokens, last, [page, "pos"], "left")
    keep = F.col("c").isNotNull() & ((F.col("c.action") == "confirmed") | (F.col("c.corrected") == F.col("text")))
    status = F.when(keep, "confirmed").when(F.col("c").isNotNull(), "changed")
    new = F.when(status == "changed", F.col("c.corrected")).otherwise(F.col("text"))
    return out.withColumns({"status": status, "orig_text": F.when(status == "changed", F.col("text")), "new_text": new}).drop("c")


def line_of_token(tokens: DataFrame, lines: DataFrame, page: str = "doc_id") -> DataFrame:
    """tokens with line_no: the first line of lines(page, line_no, lx0..ly1) that holds the token's centre, or -1."""
    cx, cy = centre()
    band = 64
    each = lines.withColumn("band", F.explode(F.sequence(F.floor(F.col("ly0") / band), F.floor(F.col("ly1") / band))))
    t = tokens.withColumn("band", F.floor(cy / band))
    hit = cx.between(F.col("lx0"), F.col("lx1")) & cy.between(F.col("ly0"), F.col("ly1"))
    found = met(t, each, [page, "band"]).where(hit).groupBy(page, "pos").agg(F.min("line_no").alias("line_no"))
    return met(tokens, found, [page, "pos"], "left").withColumn("line_no", F.coalesce("line_no", F.lit(-1)).cast("long"))


BOX = ("x0", "y0", "x1", "y1")


def in_bands(rows: DataFrame, top: str, bottom: str, height: int = 64) -> DataFrame:
    """rows once for each band of the page that they touch."""
    return rows.withColumn("band", F.explode(F.sequence(F.floor(F.col(top) / height), F.floor(F.greatest(top, bottom) / height))))


def meets() -> Column:
    return (F.col("x0") <= F.col("lx1")) & (F.col("lx0") <= F.col("x1")) & (F.col("y0") <= F.col("ly1")) & (F.col("ly0") <= F.col("y1"))


def overlapping(tokens: DataFrame, boxes: DataFrame, page: str = "doc_id") -> DataFrame:
    """Tokens whose box meets any box (lx0..ly1) of the page, edges included. They meet through bands of height."""
    met = in_bands(tokens.select(page, "pos", *BOX), "y0", "y1").join(in_bands(boxes, "ly0", "ly1"), [page, "band"]).where(meets())
    return tokens.join(met.select(page, "pos").distinct(), [page, "pos"], "left_semi")


def digit_inventions(tokens: DataFrame, lines: DataFrame, page: str = "doc_id") -> DataFrame:
    """Digit tokens that meet lines (line_text, lx0..ly1) of the page, none of which has digits."""
    rows = in_bands(tokens.where(T.has_digit(F.col("text"))), "y0", "y1")
    met = rows.join(in_bands(lines, "ly0", "ly1"), [page, "band"]).where(meets()).groupBy(page, "pos").agg(F.bool_or(T.has_digit(F.col("line_text"))).alias("any"), F.first("text").alias("text"), F.first("flags").alias("flags"))
    return met.where(~F.col("any")).select(page, "pos", "text", (F.size("flags") > 0).alias("flagged"))


def page_override(pages: DataFrame, settings: DataFrame, page: str, value: str, default: str = "*") -> DataFrame:
    """pages with a setting of their own or else the default row's."""
    own = settings.where(F.col(page) != default).select(page, F.col(value).alias("own"))
    rest = settings.where(F.col(page) == default).select(F.first(value).alias("rest"))
    return pages.join(own, page, "left").join(F.broadcast(rest), how="left").withColumn(value, F.coalesce("own", "rest")).drop("own", "rest")


def audit_manifest(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """manifest(path, bytes, sha256) against disk(path, length, digest): missing, then size, then hash drift, else ok."""
    status = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("digest") != F.col("sha256"), "hash").otherwise("ok")
    return manifest.join(disk, "path", "left").select("path", status.alias("status"))


def round_robin(rows: DataFrame, group: str, order: list[str], budget: int) -> DataFrame:
    """The first rows of each group in turns, groups by name, until the budget is used."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= budget).orderBy("turn", group).limit(budget)


def merged_lexicon(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two lexicons (word) with where each word is from."""
    left, right = a.select("word").distinct().withColumn("in_a", F.lit(True)), b.select("word").distinct().withColumn("in_b", F.lit(True))
    return left.join(right, "word", "full").select("word", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
