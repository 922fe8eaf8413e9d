"""Writers' rows: OCR results, transcripts, reports and manifests as text, ready for write.text or write.json."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_text(tokens: DataFrame, page: str = "doc_id", order: str = "pos", text: str = "text", sep: str = "\n") -> DataFrame:
    """One text per page: its tokens that aren't empty, in order. A page's tokens come together, as its file needs."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return tokens.where(F.col(text) != "").groupBy(page).agg(F.array_join(F.transform(rows, lambda t: t[text]), sep).alias("text"))


def markdown(pages: DataFrame, page: str = "doc_id") -> DataFrame:
    """A section per page; vertical bars are escaped."""
    return pages.select(page, F.concat(F.lit("## Page "), F.col(page).cast("string"), F.lit("\n\n"), F.replace("text", F.lit("|"), F.lit("\\|")), F.lit("\n")).alias("text"))


def manifest(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, bytes and sha256 of files."""
    return files.select(F.col(path).alias("path"), F.octet_length(content).cast("long").alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def run_report(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"))


def composition(rows: DataFrame, source: str, text: str) -> DataFrame:
    """What a training set is made of: per source rows, characters and the share of rows with digits."""
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"), F.avg(F.col(text).rlike(r"\p{Nd}").cast("double")).alias("digit_share"))


def worksheet(texts: DataFrame, known: DataFrame, page: str = "doc_id") -> DataFrame:
    """texts(page, text) as HTML, blanks collapsed, with those tokens marked that are outside known(page, t: normalised)."""
    from quirefold.functions.text import norm_token, tokens

    each = texts.select(page, F.posexplode(tokens(F.col("text"))).alias("k", "w")).withColumn("t", norm_token(F.col("w")))
    met = each.join(known.select(page, "t").distinct().withColumn("known", F.lit(True)), [page, "t"], "left")
    html = F.col("w")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        html = F.replace(html, F.lit(char), F.lit(entity))
    odd = F.col("known").isNull() & (F.col("t") != "")
    rows = F.array_sort(F.collect_list(F.struct("k", F.when(odd, F.concat(F.lit("<mark>"), html, F.lit("</mark>"))).otherwise(html).alias("h"))))
    return met.groupBy(page).agg(F.array_join(F.transform(rows, lambda r: r["h"]), " ").alias("html"))


def ocr_result(tokens: DataFrame, page: str = "doc_id") -> DataFrame:
    """One JSON result per page: its review queue (riskiest first, with index and risk) and all tokens in order, numbers to
    two places; alternatives only where there are some."""
    from quirefold.operators.flags import review_queue

    alt = [F.col("alt_text")] if "alt_text" in tokens.columns else []
    conf, box = F.round("conf", 2).alias("conf"), F.array("x0", "y0", "x1", "y1").alias("bbox")
    queue = review_queue(tokens, page).groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.struct(F.col("pos").alias("index"), "text", box, conf, F.round("risk", 2).alias("risk"), "flags", *alt).alias("t")))), lambda x: x["t"]).alias("review"))
    every = tokens.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("text", conf, box, "flags", *alt).alias("t")))), lambda x: x["t"]).alias("tokens"))
    met = every.join(queue, page, "left").withColumn("review", F.coalesce("review", F.array().cast(dict(queue.dtypes)["review"])))
    return met.select(page, F.to_json(F.struct("review", "tokens")).alias("json"))


def transcript(tokens: DataFrame, backend: str, page: str = "doc_id") -> DataFrame:
    """Markdown of each page: where it is from and what is in doubt, its texts, and a table of the review queue if there is
    one. The same tokens always give the same bytes."""
    from quirefold.operators.flags import review_queue

    has = lambda f: F.count(F.when(F.array_contains("flags", f), 1)).cast("string")
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    alt = F.coalesce(F.nullif(F.col("alt_text"), F.lit("")), F.lit(None)) if "alt_text" in tokens.columns else F.lit(None).cast("string")
    row = F.concat(F.lit("| `"), cell(F.col("text")), F.lit("` | "), F.array_join("flags", ", "), F.lit(" | "), F.when(alt.isNotNull(), F.concat(F.lit("`"), cell(alt), F.lit("`"))).otherwise("—"), F.lit(" | "), F.round("conf", 0).cast("long").cast("string"), F.lit(" |"))
    queue = review_queue(tokens, page).withColumn("row", row).groupBy(page).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    got = tokens.groupBy(page).agg(
        F.count("*").cast("string").alias("tokens"), has("low_conf").alias("low"), has("digit_conflict").alias("conflicts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text")))), lambda t: t["text"]), "\n").alias("body"),
    ).join(queue, page, "left")
    head = F.concat(F.lit(f"*{backend} · "), F.col("tokens"), F.lit(" tokens · "), F.col("low"), F.lit(" low-confidence · "), F.col("conflicts"), F.lit(" digit conflicts · "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" to review*\n\n"))
    table = F.when(F.col("n") > 0, F.concat(F.lit("\n\n## Review queue\n\n| token | flags | alternative | conf |\n|---|---|---|---|\n"), F.col("rows"))).otherwise("")
    return got.select(page, F.concat(head, "body", table, F.lit("\n")).alias("text"))


def combined(transcripts: DataFrame, document: str, title: str, page: str = "doc_id") -> DataFrame:
    """One Markdown text per document of transcripts(document, page, text): a section for each page, numbered in order."""
    parts = F.array_sort(F.collect_list(F.struct(page, "text")))
    body = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), p["text"])), "\n")
    return transcripts.groupBy(document).agg(F.concat(F.lit(f"# {title}\n\n"), body).alias("text"))


def corpus_file(lines: DataFrame, group: str, order: str) -> DataFrame:
    """One text per group of lines(group, text), a sentence a line, with its digest."""
    rows = F.array_sort(F.collect_list(F.struct(order, "text")))
    text = F.concat(F.array_join(F.transform(rows, lambda r: r["text"]), "\n"), F.lit("\n"))
    return lines.groupBy(group).agg(F.count("*").alias("lines"), text.alias("text")).withColumn("sha256", F.sha2("text", 256))


def lexicon_file(words: DataFrame, header: str) -> DataFrame:
    """Lines of a word list: a comment, then the different words in order. Ranges of words, so no task has them all."""
    head = words.sparkSession.createDataFrame([(0, f"# {header}")], "k int, line string")
    return head.unionByName(words.select(F.lit(1).alias("k"), F.col("word").alias("line")).distinct()).orderBy("k", "line").select("line")


def review_sheet(rows: DataFrame, measure: str, order: list[str]) -> DataFrame:
    """rows with the worst first, ready for write.csv."""
    return rows.orderBy(F.desc(measure), *order)


def append_events(events: DataFrame, path: str) -> None:
    """Appends events to a log of JSON lines; earlier ones are never touched."""
    events.write.mode("append").json(path)


def clear_events(spark, path: str) -> int:
    """Deletes a log of JSON lines; returns how many events it had, 0 if there was none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return 0
    n = spark.read.text(path).where("trim(value) <> ''").count()
    fs.delete(where, True)
    return n


def export_bundle(tokens: DataFrame, path: str, backend: str, txt: bool = True, json: bool = True, md: bool = True, page: str = "doc_id") -> dict[str, str]:
    """Writes the outputs that are asked for, each a table of (page, text) below path, which must not have them yet; returns
    where they are."""
    makers = {"txt": (txt, lambda: ordered_text(tokens, page)), "json": (json, lambda: ocr_result(tokens, page)), "md": (md, lambda: transcript(tokens, backend, page))}
    out = {}
    for name, (wanted, make) in makers.items():
        if wanted:
            out[name] = f"{path.rstrip('/')}/{name}"
            make().write.mode("errorifexists").parquet(out[name])
    return out


def labels_zip(labels: DataFrame, group: str) -> DataFrame:
    """One zip archive per group of labels(group, file, text, image: bytes or null): labels.tsv and the images under crops/."""
    import io
    import zipfile

    import pandas as pd

    kinds = dict(labels.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("file"), io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("labels.tsv", "".join(f"{f}\t{t}\n" for f, t in zip(pdf.file, pdf.text)))
            for f, image in zip(pdf.file, pdf.image):
                if image is not None:
                    z.writestr(f"crops/{f}", bytes(image))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "content": [out.getvalue()]})

    return labels.groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, content binary")


def npz_file(lines: DataFrame, group: str) -> DataFrame:
    """One NPZ per group of lines(group, row, image: bytes, height, width, text), all of one size: images and texts."""
    import io
    import zipfile

    import numpy as np

    from quirefold.operators.layout import per_page

    def one(height, width, image, text):
        # as savez_compressed, but fast: a long line makes every text as wide, nearly all of it zeros
        out, shape = io.BytesIO(), (len(text), int(height[0]), int(width[0]))
        parts = {"images": np.frombuffer(b"".join(image.to_pylist()), np.uint8).reshape(shape), "texts": np.array(text.to_pylist())}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            for name, part in parts.items():
                with z.open(f"{name}.npy", "w", force_zip64=True) as f:
                    np.lib.format.write_array(f, part, allow_pickle=False)
        return [[out.getvalue()]]

    return per_page(lines, group, ["height", "width", "image", "text"], ["row"], one, "content binary")
