"""Curation of training and evaluation sets: plans, caps, gates, exclusions and imports as filters, windows and anti joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T


def ordinals(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with n: their place, from 0, in order of (group, order). Places are counted within groups; a group's start is
    the sum of the groups before it, so no window sees all rows."""
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # a row for each group
    starts = sizes.select(group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return inside.join(starts, group).withColumn("n", (F.col("_start") + F.col("_k")).cast("long")).drop("_k", "_start")


def dataset_plan(pages: DataFrame, levels: list[str], per_doc: int = 0, total: int = 0, seed: int = 1234, degrade: bool = True) -> DataFrame:
    """Pages(doc, page, text) of a dataset: those with text, at most per_doc of a document and total in all (0: no limit), in
    order; the k-th gets the level levels[k % n] and the seed seed + k, or level 'real' where nothing is degraded."""
    rows = pages.where(F.coalesce("text", F.lit("")) != "")
    if per_doc:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("doc").orderBy("page"))).where(F.col("_k") <= per_doc).drop("_k")
    if total:
        rows = rows.orderBy("doc", "page").limit(total)
    rows = ordinals(rows, "doc", "page")
    level = F.element_at(F.array(*map(F.lit, levels)), (F.col("n") % len(levels) + 1).cast("int")) if degrade else F.lit("real")
    return rows.select("doc", "page", "text", level.alias("level"), (F.col("n") + seed).alias("seed"))


def streamed_pages(rows: DataFrame, order: str, offset: int = 0, most: int = 0, least: int = 20) -> DataFrame:
    """Records from place offset on that have an image and a truth of at least so many characters, the first `most`."""
    out = rows.where((F.col(order) >= offset) & F.col("image").isNotNull() & (F.length("gt") >= least))
    return out.orderBy(order).limit(most) if most else out


def line_crops(rows: DataFrame, order: str, most: int = 0) -> DataFrame:
    """Line records with a transcription that isn't blank and an image, the first `most`."""
    text = T.normalize_lines(F.coalesce("ocr", F.lit("")))
    out = rows.withColumn("gt", text).where((F.col("gt") != "") & F.col("image").isNotNull())
    return out.orderBy(order).limit(most) if most else out


def basename(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)


def unfrozen(pages: DataFrame, frozen: DataFrame) -> DataFrame:
    """pages(source, page) that no frozen set's entries(source, page) use, by the file's name whatever its folder."""
    used = frozen.where("source is not null").select(basename(F.col("source")).alias("_name"), F.coalesce("page", F.lit(-1)).cast("long").alias("_page")).distinct()
    return pages.join(used, (basename(F.col("source")) == F.col("_name")) & (F.col("page").cast("long") == F.col("_page")), "left_anti")


def pages_after(frozen: DataFrame, sizes: DataFrame, per_doc: int) -> DataFrame:
    """The pages of each source to label next: up to per_doc after the last frozen one, as far as sizes(source, pages) goes."""
    last = frozen.groupBy(basename(F.col("source")).alias("source")).agg((F.max("page") + 1).cast("long").alias("start"))
    met = last.join(sizes.select(basename(F.col("source")).alias("source"), "pages"), "source")
    end = F.least(F.col("pages"), F.col("start") + per_doc) - 1
    return met.where(end >= F.col("start")).select("source", F.explode(F.sequence("start", end)).alias("page"))


def labelable(text: Column) -> Column:
    return text.rlike("[ऀ-ॿ]") | T.has_digit(text)


def aligned_labels(pairs: DataFrame, page: str = "page", own: Column | None = None, least: int = 3, most: int = 48) -> DataFrame:
    """Aligned pairs(page, i, text) with kept: the length fits, the text is of the script (own; Devanagari by default), and
    it is the page's first of that text."""
    text = T.normalize(F.col("text"))
    fits = F.length(text).between(least, most) & (text.rlike("[ऀ-ॿ]") if own is None else own)
    rows = pairs.withColumns({"text": text, "_fits": fits})
    first = F.row_number().over(Window.partitionBy(page, "text", "_fits").orderBy("i")) == 1
    return rows.withColumn("kept", F.col("_fits") & first).drop("_fits")


def montage_reason(text: Column, least: int = 3, most: int = 48, able: Column | None = None) -> Column:
    """Why a read line is dropped, the first reason that holds, or null: empty, length, chars."""
    text = T.normalize(text)
    return F.when(text == "", "empty").when(~F.length(text).between(least, most), "length").when(~(labelable(text) if able is None else able), "chars")


def label_run(pages: DataFrame, done: DataFrame, tokens: DataFrame, own: Column, share: float, page: str = "page") -> DataFrame:
    """What a labelling run does with each of its pages that isn't done yet: 'skipped' where less than so large a share of
    its tokens is of the script, else 'todo'. Runs can be stopped and started: what they report is done."""
    todo = pages.join(done.select(page), page, "left_anti")
    shares = tokens.groupBy(page).agg(F.avg(own.cast("double")).alias("share"))
    met = todo.join(shares, page, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return met.withColumn("status", F.when(F.col("share") < share, "skipped").otherwise("todo"))


def digit_crops(tokens: DataFrame, most: int, ratio: float = 0.5, seed: int = 42, page: str = "doc_id") -> DataFrame:
    """The first tokens of each page that are mostly digits, as rows of a review sheet; a page's degradation has its seed."""
    rows = tokens.withColumn("text", T.sanitize_field(F.col("text"))).where(T.is_digit_crop(F.col("text"), ratio))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(page).orderBy("pos"))).where(F.col("_k") <= most)
    page_seed = (F.lit(seed) + F.crc32(F.col(page).cast("string").cast("binary"))).bitwiseAND(0x7FFFFFFF)
    return rows.select(F.concat(F.col(page).cast("string"), F.lit("_c"), F.format_string("%02d", "pos")).alias("crop_id"), page, F.col("text").alias("engine_guess"), page_seed.alias("seed"))


def sheet_import(rows: DataFrame, crops: DataFrame) -> DataFrame:
    """A reviewed sheet's rows(crop_id, true_text) against crops(crop_id, readable): the label, or the first reason why there
    is none. Rows without an id are left out."""
    met = rows.where(F.trim(F.coalesce("crop_id", F.lit(""))) != "").withColumn("crop_id", F.trim("crop_id")).join(crops.select("crop_id", "readable"), "crop_id", "left")
    text = T.sanitize_field(F.col("true_text"))
    reason = (
        F.when(F.col("readable").isNull(), "missing_crop").when(F.col("true_text").isNull(), "malformed_tsv_row").when(text == "", "rejected_blank")
        .when(~T.has_digit(text), "no_digit").when(~F.col("readable"), "unreadable_crop")
    )
    return met.select("crop_id", F.when(reason.isNull(), text).alias("text"), reason.alias("reason"))


def word_set(words: DataFrame, fits: Column) -> DataFrame:
    """Different words that fit, and as a single number in every row how many of the given rows do not; a word given twice
    is no loss."""
    dropped = words.agg(F.count(F.when(~fits, 1)).alias("dropped"))
    return words.where(fits).select("word").distinct().join(F.broadcast(dropped))


def words_to_learn(texts: DataFrame, lexicon: DataFrame, words: Column, least: int = 4) -> DataFrame:
    """Different words of confirmed texts that are long enough and outside the lexicon(word); nothing without a lexicon."""
    each = texts.select(F.explode(words).alias("word")).where(F.length("word") >= least).distinct()
    some = lexicon.limit(1).select(F.lit(1).alias("_some"))
    return each.join(lexicon.select("word").distinct(), "word", "left_anti").join(F.broadcast(some)).select("word")


def digit_runs(texts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Different runs of at least so many digits per key, in Devanagari digits."""
    folded = F.translate("text", T.LATIN_DIGITS, T.DEVA_DIGITS)
    return texts.select(*keys, F.explode(F.regexp_extract_all(folded, F.lit(f"[०-९]{{{least},}}"), F.lit(0))).alias("run")).distinct()


def harvest_report(sources: DataFrame, reason: Column) -> DataFrame:
    """sources with accepted and the reason why not."""
    return sources.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def anchor_status(pages: DataFrame, threshold: float = 0.95, budget: int = 8) -> DataFrame:
    """pages(doc, page, agreement_rate) of an anchor set: 'consensus' where readings agree, 'worksheet' for the first pages
    of the others, taken in turns from documents by name, least agreement first, until the budget is used, else 'rest'."""
    low = pages.where(F.col("agreement_rate") < threshold)
    turn = Window.partitionBy("doc").orderBy("agreement_rate", "page")
    picked = low.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= budget).orderBy("turn", "doc").limit(budget).select("doc", "page", F.lit(True).alias("_picked"))
    met = pages.join(F.broadcast(picked), ["doc", "page"], "left")
    return met.withColumn("status", F.when(F.col("agreement_rate") >= threshold, "consensus").when(F.col("_picked"), "worksheet").otherwise("rest")).drop("_picked")


def new_stubs(picked: DataFrame, existing: DataFrame, page: str = "page") -> DataFrame:
    """Texts to pre-fill for the picked pages, never over one that exists."""
    return picked.join(existing.select(page), page, "left_anti").withColumn("text", F.concat("text", F.lit("\n")))


def padded(pad: int, width: Column, height: Column) -> dict[str, Column]:
    """A box grown by pad, within the page."""
    return {
        "x0": F.greatest(F.lit(0), F.col("x0") - pad), "y0": F.greatest(F.lit(0), F.col("y0") - pad), "x1": F.least(width, F.col("x1") + pad), "y1": F.least(height, F.col("y1") + pad),
    }


def digit_lines(lines: DataFrame, order: list[str], width: Column, height: Column, most: int = 150, pad: int = 4) -> DataFrame:
    """The first lines, in order, that have digits and a box that isn't empty, with padded boxes (0: all of them)."""
    rows = lines.where(T.digit_string(F.col("text")) != "").withColumns(padded(pad, width, height)).where("x1 > x0 and y1 > y0")
    return rows.orderBy(*order).limit(most) if most else rows


def book_split(pages: DataFrame, holdout: list[str], ink: float = 0.02) -> DataFrame:
    """pages(book, ink) with part, by book; blank pages, with less ink, are left out."""
    return pages.where(F.col("ink") >= ink).withColumn("part", F.when(F.col("book").isin(holdout), "holdout").otherwise("train"))


def split_summary(pages: DataFrame) -> DataFrame:
    return pages.groupBy("part").agg(F.count("*").alias("pages"), F.countDistinct("book").alias("books"))


def gate_pages(pages: DataFrame, readings: DataFrame, boxes: DataFrame, pad: int = 3, page: str = "page") -> DataFrame:
    """Lines of the pages that have a reading: (page, gt, padded box). A box is not cut at the page's far edges."""
    met = pages.join(readings.select(page, F.col("reading").alias("gt")), page).join(boxes, page)
    return met.withColumns({"x0": F.greatest(F.lit(0), F.col("x0") - pad), "y0": F.greatest(F.lit(0), F.col("y0") - pad), "x1": F.col("x1") + pad, "y1": F.col("y1") + pad})


def without_flag(flags: Column, flag: str = "unknown_word") -> Column:
    return F.array_remove(flags, flag)


def entry_files(entries: DataFrame, folder: str, roles: tuple[str, ...] = ("clean", "degraded", "gt", "image")) -> DataFrame:
    """Files of dataset entries in long form: (id, role, path), for the roles that an entry has."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("path")) for r in roles)))
    return entries.select("id", each.alias("f")).where("f.path <> ''").select("id", "f.role", F.concat(F.lit(folder.rstrip("/") + "/"), F.replace("f.path", F.lit("\\"), F.lit("/"))).alias("path"))


def manifest_header(files: DataFrame, content: str = "content") -> DataFrame:
    """What a frozen set's manifest says about itself, with the digest of the file."""
    at = lambda n: F.get_json_object(F.col(content), f"$.{n}")
    return files.select(*(at(n).alias(n) for n in ("name", "license", "provenance")), at("n_entries").cast("long").alias("n_entries"), at("freeze_version").cast("long").alias("freeze_version"), F.sha2(F.col(content).cast("binary"), 256).alias("manifest_sha256"))


def profile_pages(pages: DataFrame, start: int, most: int = 0, doc: str = "doc", page: str = "page") -> DataFrame:
    """Each document's pages from start on, the first `most`."""
    rows = pages.where(F.col(page) >= start)
    if not most:
        return rows
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where(F.col("_k") <= most).drop("_k")


def licence_report(packages: DataFrame, known: dict[str, str]) -> DataFrame:
    """packages(name, licence) with the licence that is known by name, else the one stated, else 'unknown'."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else F.create_map().cast("map<string,string>")
    return packages.withColumn("licence", F.coalesce(F.try_element_at(table, F.lower("name")), F.nullif(F.trim("licence"), F.lit("")), F.lit("unknown")))
