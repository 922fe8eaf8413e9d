"""Readers of page transcriptions, engine output, corrections and harvested pages. Each takes a table of file contents, as
spark.read.text(wholetext) or binaryFile gives them, and returns rows; malformed parts are left out."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T


def plain_xml(xml: Column) -> Column:
    """XML without namespace declarations and prefixes."""
    xml = F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', "")
    return F.regexp_replace(F.regexp_replace(xml, r"<(/?)\w+:", "<$1"), r"\s\w+:(\w+=)", " $1")


def alto_lines(files: DataFrame, xml: str = "content") -> DataFrame:
    """Lines of ALTO files: text and box; lines without text are left out. Other columns stay."""
    found = F.regexp_extract_all(plain_xml(F.col(xml)), F.lit(r"(?s)<TextLine\b[^>]*?>.*?</TextLine>"), F.lit(0))
    line = files.select(*(c for c in files.columns if c != xml), F.posexplode(found).alias("line_no", "_line"))
    num = lambda a: F.expr(f"cast(xpath_double(_line, 'TextLine/@{a}') as int)")
    text = F.array_join(F.expr("xpath(_line, 'TextLine/String/@CONTENT')"), " ")
    out = line.withColumns({"text": T.normalize(text), "x0": num("HPOS"), "y0": num("VPOS"), "x1": num("HPOS") + num("WIDTH"), "y1": num("VPOS") + num("HEIGHT")})
    return out.where("text <> ''").drop("_line")


def page_lines(files: DataFrame, xml: str = "content") -> DataFrame:
    """Lines of PAGE-XML files: the first text that isn't empty and the hull of the first polygon."""
    found = F.regexp_extract_all(plain_xml(F.col(xml)), F.lit(r"(?s)<TextLine\b[^>]*?>.*?</TextLine>"), F.lit(0))
    line = files.select(*(c for c in files.columns if c != xml), F.posexplode(found).alias("line_no", "_line"))
    texts = F.filter(F.transform(F.expr("xpath(_line, '//Unicode/text()')"), T.normalize), lambda t: t != "")
    points = F.split(F.expr("xpath_string(_line, 'TextLine/Coords/@points')"), " ")
    axis = lambda k: F.transform(points, lambda p: F.try_element_at(F.split(p, ","), F.lit(k)).cast("int"))
    out = line.withColumns({"text": F.try_element_at(texts, F.lit(1)), "x0": F.array_min(axis(1)), "y0": F.array_min(axis(2)), "x1": F.array_max(axis(1)), "y1": F.array_max(axis(2))})
    return out.where("text is not null").drop("_line")


def tesseract_tsv(files: DataFrame, content: str = "content") -> DataFrame:
    """Words of Tesseract's TSV: rows of level 5 with text and twelve fields."""
    row = files.select(*(c for c in files.columns if c != content), F.posexplode(F.split(content, "\r?\n")).alias("row", "_row")).where("row > 0")
    row = row.withColumn("f", F.split("_row", "\t")).where(F.size("f") >= 12)
    at = lambda i, kind: F.expr(f"try_cast(f[{i}] as {kind})")
    out = row.select(*(c for c in row.columns if c not in ("_row", "f")), F.trim(F.col("f")[11]).alias("text"), at(10, "double").alias("conf"), at(6, "int").alias("x0"), at(7, "int").alias("y0"), (at(6, "int") + at(8, "int")).alias("x1"), (at(7, "int") + at(9, "int")).alias("y1"), at(0, "int").alias("level"))
    return out.where("level = 5 and text <> ''").drop("level")


def tesseract_osd(text: Column) -> Column:
    """struct(rotate, confidence, script) of Tesseract's orientation report; rotate falls back to 360 - orientation."""
    grab = lambda label: F.nullif(F.regexp_extract(text, label + r":\s*([\w.]+)", 1), F.lit(""))
    turn = F.pmod(F.lit(360) - grab("Orientation in degrees").cast("int"), F.lit(360))
    return F.struct(F.coalesce(grab("Rotate").cast("int"), turn).alias("rotate"), grab("Orientation confidence").cast("double").alias("confidence"), grab("Script").alias("script"))


OCR_JSON = "struct<backend:string,tokens:array<struct<text:string,conf:double,bbox:array<int>,granularity:string,flags:array<string>,alt_text:string>>>"


def ocr_json(files: DataFrame, content: str = "content") -> DataFrame:
    """Tokens of OCR results with defaults for what is missing."""
    page = files.select(*(c for c in files.columns if c != content), F.from_json(content, OCR_JSON).alias("p"))
    tok = page.select(*(c for c in page.columns if c != "p"), F.col("p.backend").alias("backend"), F.posexplode("p.tokens").alias("pos", "t"))
    box = lambda k, n: F.coalesce(F.try_element_at("t.bbox", F.lit(k)), F.lit(0)).alias(n)
    return tok.select(*(c for c in tok.columns if c != "t"), F.coalesce("t.text", F.lit("")).alias("text"), F.coalesce("t.conf", F.lit(0.0)).alias("conf"), box(1, "x0"), box(2, "y0"), box(3, "x1"), box(4, "y1"), F.coalesce("t.granularity", F.lit("line")).alias("granularity"), F.coalesce("t.flags", F.array().cast("array<string>")).alias("flags"), F.col("t.alt_text").alias("alt_text"))


CORRECTION = "array<struct<index:int,original:string,corrected:string,action:string,bbox:array<int>>>"


def corrections_json(files: DataFrame, content: str = "content", most: int = 500, longest: int = 200) -> DataFrame:
    """Corrections of files that map pages to lists, or are a list for every page ('*'). Too many entries or too long a
    text is an error; a box that isn't four numbers is null; an unknown action is 'changed'."""
    keep = [c for c in files.columns if c != content]
    bare = F.trim(content).startswith("[")
    body = F.when(bare, F.create_map(F.lit("*"), F.from_json(content, CORRECTION))).otherwise(F.from_json(content, f"map<string,{CORRECTION}>"))
    rows = files.select(*keep, F.explode(body).alias("page", "list"))
    rows = rows.withColumn("list", F.when(F.size("list") <= most, F.col("list")).otherwise(F.raise_error(F.lit("too many corrections")).cast(CORRECTION)))
    each = rows.select(*keep, "page", F.posexplode("list").alias("seq", "c"))
    text = F.when(F.length("c.corrected") <= longest, F.col("c.corrected")).when(F.col("c.corrected").isNull(), F.lit("")).otherwise(F.raise_error(F.lit("a correction is too long")).cast("string"))
    box = F.when(F.size("c.bbox") == 4, F.col("c.bbox"))
    return each.select(*keep, "page", "seq", F.col("c.index").alias("index"), F.coalesce("c.original", F.lit("")).alias("original"), text.alias("corrected"), F.when(F.col("c.action") == "confirmed", "confirmed").otherwise("changed").alias("action"), *(box[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


def json_lines(files: DataFrame, schema: str, content: str = "content") -> DataFrame:
    """Objects of a JSON-lines log in order; blank, invalid and non-object lines are skipped."""
    rows = files.select(*(c for c in files.columns if c != content), F.posexplode(F.split(content, "\n")).alias("seq", "_row")).where("trim(_row) like '{%'")
    return rows.withColumn("e", F.from_json("_row", schema)).where(F.expr("try_parse_json(_row) is not null")).select(*(c for c in rows.columns if c != "_row"), "e.*")


def links(pages: DataFrame, html: str = "html", url: str = "url", ending: str | None = None, first: int | None = None) -> DataFrame:
    """Links of pages in order, each once, made absolute against the page's url: page columns, k, link."""
    found = F.regexp_extract_all(F.col(html), F.lit("(?i)href\\s*=\\s*[\"']([^\"'#]+)"), F.lit(1))
    root, scheme = F.regexp_extract(url, "^(\\w+://[^/?#]+)", 1), F.regexp_extract(url, "^(\\w+:)", 1)
    folder = F.regexp_extract(url, "^(\\w+://[^?#]*/)", 1)
    base = F.when((folder == "") | (F.length(folder) <= F.length(root)), F.concat(root, F.lit("/"))).otherwise(folder)
    absolute = lambda x: F.when(x.rlike("^\\w+://"), x).when(x.startswith("//"), F.concat(scheme, x)).when(x.startswith("/"), F.concat(root, x)).otherwise(F.concat(base, x))
    every = F.array_distinct(F.transform(found, absolute))
    if ending:
        every = F.filter(every, lambda x: F.lower(F.regexp_replace(x, "[?#].*$", "")).endswith(ending))
    if first:
        every = F.slice(every, 1, first)
    return pages.select(*(c for c in pages.columns if c != html), F.posexplode(every).alias("k", "link"))


def page_title(html: Column) -> Column:
    return T.normalize(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def truth_text(record: Column) -> Column:
    """Truth of a record with words, or the first of text, label and ground_truth that isn't blank."""
    one = lambda n: F.nullif(F.trim(F.get_json_object(record, f"$.{n}")), F.lit(""))
    words = F.from_json(F.get_json_object(record, "$.words"), "array<string>")
    return T.normalize_lines(F.when(F.size(words) > 0, F.array_join(words, "\n")).otherwise(F.coalesce(one("text"), one("label"), one("ground_truth"), F.lit(""))))


def word_list(files: DataFrame, content: str = "content") -> DataFrame:
    """Words of a list: what comes before the first blank; comments and empty lines are left out."""
    row = files.select(F.explode(F.split(content, "\n")).alias("r")).where("trim(r) <> '' and not ltrim(r) like '#%'")
    return row.select(F.split_part(F.trim("r"), F.lit(" "), F.lit(1)).alias("word")).distinct()


def manifest_paths(files: DataFrame, content: str = "content") -> DataFrame:
    """Entries of a dataset manifest in long form: entry, role, path with forward slashes; a path may be an object."""
    entry = files.select(F.posexplode(F.from_json(F.get_json_object(content, "$.entries"), "array<map<string,string>>")).alias("entry", "m"))
    each = entry.select("entry", F.explode("m").alias("role", "v"))
    return each.select("entry", "role", F.replace(F.coalesce(F.get_json_object("v", "$.path"), F.col("v")), F.lit("\\"), F.lit("/")).alias("path"))


def inputs(files: DataFrame, root: Column, extensions: tuple[str, ...], recursive: bool = False, path: str = "path") -> DataFrame:
    """The paths in files(path) that are a run's inputs: root itself if it is a file, else those below it (directly, unless
    recursive) that end in one of the extensions, whatever the case. Order them by path."""
    p, folder = F.col(path), F.regexp_replace(root, "/+$", "")
    inside = p.startswith(F.concat(folder, F.lit("/"))) & F.lower(p).rlike(r"\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$")
    direct = F.lit(True) if recursive else ~F.substring(p, F.length(folder) + 2, F.length(p)).contains("/")
    return files.where((p == folder) | (inside & direct))


def list_inputs(spark, root: str, extensions: tuple[str, ...], recursive: bool = False) -> DataFrame:
    """path and length of the input files at or below root, read as a listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    plain = files.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    return inputs(plain, F.lit(root), extensions, recursive).orderBy("path")


def json_leaves(content: DataFrame, column: str, out: str = "text") -> DataFrame:
    """content with the text leaves of a JSON value in its order, one a line, normalised: those below gt_parse where there
    is one. What is no JSON is taken as text; null gives an empty text."""
    import json

    def leaves(node):
        if isinstance(node, dict):
            for v in node.values():
                yield from leaves(v)
        elif isinstance(node, list):
            for v in node:
                yield from leaves(v)
        elif isinstance(node, str) and node.strip():
            yield node.strip()

    @F.pandas_udf("string")
    def joined(raw):
        def one(x):
            if not x:
                return ""
            try:
                data = json.loads(x)
            except ValueError:
                return x
            return "\n".join(leaves(data.get("gt_parse", data) if isinstance(data, dict) else data))

        return raw.map(one)

    return content.withColumn(out, T.normalize_lines(joined(F.col(column))))


def first_field(*fields: Column) -> Column:
    """The first of a record's fields that holds something."""
    return F.coalesce(*(F.nullif(f.cast("string"), F.lit("")) for f in fields))


def transcription_of(names: DataFrame, images: DataFrame, archive: str = "archive") -> DataFrame:
    """images(archive, stem) with the member of names(archive, name) that transcribes them: .../alto/<stem>.xml, else
    .../page/<stem>.xml; those without any are left out."""
    layout = F.when(F.col("name").contains("/alto/"), 0).when(F.col("name").contains("/page/"), 1)
    found = names.where(F.col("name").endswith(".xml")).select(archive, "name", F.regexp_extract("name", r"([^/]*)\.xml$", 1).alias("stem"), layout.alias("_layout")).where("_layout is not null")
    best = found.groupBy(archive, "stem").agg(F.min(F.struct("_layout", "name")).alias("b")).select(archive, "stem", F.col("b.name").alias("transcription"))
    return images.join(best, [archive, "stem"])


def rescaled(box: str, scale: Column) -> Column:
    """A coordinate in the image's pixels, where image and transcription differ in size by more than a hundredth."""
    return F.when(F.abs(scale - 1.0) > 0.01, (F.col(box) * scale).cast("int")).otherwise(F.col(box).cast("int"))


def zip_members(files: DataFrame, content: str = "content") -> DataFrame:
    """Members (name, member: bytes) of zip archives; what is no archive gives none. A file is one task's, as zips are."""
    import io
    import zipfile

    import pyarrow as pa

    keep = [c for c in files.columns if c != content]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with zipfile.ZipFile(io.BytesIO(row[content])) as z:
                        found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, TypeError):
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([*(pa.array([row[c]] * len(found), batch.schema.field(c).type) for c in keep), pa.array([n for n, _ in found]), pa.array([b for _, b in found], pa.binary())], [*keep, "name", "member"])

    kinds = dict(files.dtypes)
    return files.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "name string, member binary"]))


def valid_books(members: DataFrame, archive: str = "archive") -> DataFrame:
    """Archives of members(archive, name) that have page images and transcriptions."""
    image, xml = F.lower("name").endswith(".jpg"), F.col("name").contains("/alto/") & F.col("name").endswith(".xml")
    return members.groupBy(archive).agg(F.bool_or(image).alias("images"), F.bool_or(xml).alias("xml")).where("images and xml").select(archive)


def lexicon(files: DataFrame, word, content: str = "content") -> DataFrame:
    """Different words of word lists, one a line, that pass word (a column of the line to the word, or null); comments and
    empty lines are left out."""
    line = files.select(F.explode(F.split(content, "\r?\n")).alias("line")).where("trim(line) <> '' and not ltrim(line) like '#%'")
    return line.select(word(F.trim("line")).alias("word")).where("word is not null").distinct()


def calibrations(files: DataFrame, content: str = "content") -> DataFrame:
    """Isotonic calibrations of JSON files: x and y arrays; a malformed file, or one without, is left out."""
    got = F.from_json(F.get_json_object(content, "$.isotonic"), "struct<x:array<double>,y:array<double>>")
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, got.alias("i")).where("i.x is not null and i.y is not null").select(*keep, F.col("i.x").alias("xs"), F.col("i.y").alias("ys"))


def unpacked_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Lines (line, text) of xz or gzip files, or plain ones, as their first bytes tell; wrong bytes become U+FFFD. A file is
    read piece by piece."""
    import codecs
    import lzma
    import zlib

    import pyarrow as pa

    keep = [c for c in files.columns if c != content]

    def pieces(raw: bytes, size: int = 1 << 20):
        if raw[:6] == b"\xfd7zXZ\x00":
            unpack = lzma.LZMADecompressor().decompress
        elif raw[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(47).decompress
        else:
            unpack = bytes
        for i in range(0, len(raw), size):
            yield unpack(raw[i : i + size])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                decode, rest, at = codecs.getincrementaldecoder("utf-8")("replace"), "", 0
                for piece in [*pieces(row[content] or b""), None]:
                    text = rest + (decode.decode(b"", True) if piece is None else decode.decode(piece))
                    lines = text.split("\n")
                    rest = lines.pop() if piece is not None or lines[-1] == "" else ""
                    if lines:
                        yield pa.RecordBatch.from_arrays([*(pa.array([row[c]] * len(lines), batch.schema.field(c).type) for c in keep), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines)], [*keep, "line", "text"])
                        at += len(lines)

    kinds = dict(files.dtypes)
    return files.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "line long, text string"]))


def headwords(files: DataFrame, content: str = "content") -> DataFrame:
    """Words of dictionary dumps in order: JSON lists, or objects with words, entries or data, of texts or objects with word;
    gzip or plain."""
    text = unpacked_lines(files, content)
    keep = [c for c in files.columns if c != content]
    whole = text.groupBy(*keep).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda t: t["text"]), "\n").alias("j"))
    some = lambda n: F.nullif(F.get_json_object("j", f"$.{n}"), F.lit("[]"))
    items = F.from_json(F.when(F.ltrim("j").startswith("["), F.col("j")).otherwise(F.coalesce(some("words"), some("entries"), some("data"))), "array<string>")
    each = whole.select(*keep, F.posexplode(items).alias("k", "item"))
    return each.select(*keep, "k", F.when(F.col("item").startswith("{"), F.get_json_object("item", "$.word")).otherwise(F.col("item")).alias("word")).where("word is not null")


def label_rows(files: DataFrame, content: str = "content") -> DataFrame:
    """(name, text) of label files, split at the first tab; lines without a tab or a text are left out."""
    line = files.select(*(c for c in files.columns if c != content), F.posexplode(F.split(content, "\n")).alias("line", "r")).where(F.instr("r", "\t") > 0)
    at = F.instr("r", "\t")
    return line.select(*(c for c in line.columns if c != "r"), F.substring("r", F.lit(1), at - 1).alias("name"), F.substring(F.col("r"), at + 1, F.length("r")).alias("text")).where("text <> ''")


def corpus_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Lines of a corpus, stripped; empty ones are left out."""
    line = files.select(*(c for c in files.columns if c != content), F.posexplode(F.split(content, "\n")).alias("line", "t"))
    return line.withColumn("text", F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).drop("t").where("text <> ''")


def npz_rows(files: DataFrame, content: str = "content") -> DataFrame:
    """Rows (row, image: bytes, height, width, text) of NPZ files with arrays images and texts."""
    import io

    import numpy as np
    import pyarrow as pa

    keep = [c for c in files.columns if c != content]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with np.load(io.BytesIO(row[content]), allow_pickle=False) as z:
                    images, texts = z["images"], z["texts"].tolist()
                n = len(texts)
                if n:
                    yield pa.RecordBatch.from_arrays([*(pa.array([row[c]] * n, batch.schema.field(c).type) for c in keep), pa.array(range(n), pa.int64()), pa.array([x.tobytes() for x in images], pa.binary()), pa.array([images.shape[1]] * n, pa.int32()), pa.array([images.shape[2]] * n, pa.int32()), pa.array(texts)], [*keep, "row", "image", "height", "width", "text"])

    kinds = dict(files.dtypes)
    return files.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "row long, image binary, height int, width int, text string"]))


def edits_tsv(files: DataFrame, content: str = "content") -> DataFrame:
    """A reviewer's edits (line, index, action, text), tab by tab; comments and empty lines are skipped. A line that isn't
    index, action and perhaps text, or has another action than changed or confirmed, is an error that names it."""
    row = files.select(*(c for c in files.columns if c != content), F.posexplode(F.split(content, "\r?\n")).alias("line", "r")).withColumn("line", F.col("line") + 1)
    row = row.where("trim(r) <> '' and not ltrim(r) like '#%'").withColumn("f", F.split("r", "\t"))
    wrong = lambda what: F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(f": {what}")))
    index = F.when(F.size("f") < 2, wrong("expected index, action and text").cast("int")).otherwise(F.coalesce(F.expr("try_cast(trim(f[0]) as int)"), wrong("bad index").cast("int")))
    named = F.coalesce(F.nullif(F.trim(F.get("f", 1)), F.lit("")), F.lit("changed"))
    action = F.when(named.isin("changed", "confirmed"), named).otherwise(wrong("bad action").cast("string"))
    return row.select(*(c for c in row.columns if c not in ("r", "f")), index.alias("index"), action.alias("action"), F.coalesce(F.get("f", 2), F.lit("")).alias("text"))


def handles(pages: DataFrame, html: str = "html", pattern: str = r'href="(/handle/\d+/\d+)"') -> DataFrame:
    """The different item paths of a search page, in order: page columns, k, handle."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)))
    return pages.select(*(c for c in pages.columns if c != html), F.posexplode(found).alias("k", "handle"))


def item_page(html: Column) -> Column:
    """struct(title, pdf_url) of an item page's citation metadata, each the first that isn't empty, else ''."""
    entity = {"&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}

    def first(name):
        found = F.filter(F.regexp_extract_all(html, F.lit(f'<meta\\s+name="{name}"\\s+content="([^"]*)"'), F.lit(1)), lambda x: x != "")
        out = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))
        for k, v in entity.items():
            out = F.replace(out, F.lit(k), F.lit(v))
        return F.trim(out)

    return F.struct(first("citation_title").alias("title"), first("citation_pdf_url").alias("pdf_url"))


SEARCH = "struct<_embedded:struct<searchResult:struct<_embedded:struct<objects:array<struct<_embedded:struct<indexableObject:struct<uuid:string,handle:string,metadata:map<string,array<struct<value:string>>>>>>>>>>>"


def search_items(files: DataFrame, content: str = "content") -> DataFrame:
    """Items (uuid, handle, title) of a repository's JSON search responses."""
    found = F.from_json(F.col(content), SEARCH)["_embedded"]["searchResult"]["_embedded"]["objects"]
    each = files.select(*(c for c in files.columns if c != content), F.posexplode(found).alias("k", "o"))
    item = F.col("o")["_embedded"]["indexableObject"]
    empty = F.lit("")
    title = F.try_element_at(F.try_element_at(item["metadata"], F.lit("dc.title")), F.lit(1))["value"]
    return each.select(*(c for c in each.columns if c != "o"), F.coalesce(item["uuid"], empty).alias("uuid"), F.coalesce(item["handle"], empty).alias("handle"), F.coalesce(title, empty).alias("title"))


BITSTREAMS = "array<struct<name:string,sizeBytes:long,_links:struct<content:struct<href:string>>>>"


def original_pdf(content: Column) -> Column:
    """struct(name, bytes, url) of the first PDF in an item's ORIGINAL bundles, whose list may be nested once more; null
    without any."""
    bundles = F.from_json(F.get_json_object(content, "$._embedded.bundles"), "array<string>")
    own = F.filter(bundles, lambda b: F.get_json_object(b, "$.name") == "ORIGINAL")
    plain = lambda b: F.get_json_object(b, "$._embedded.bitstreams")
    nested = lambda b: F.coalesce(F.get_json_object(b, "$._embedded.bitstreams._embedded.bitstreams"), plain(b))
    bits = F.flatten(F.transform(own, lambda b: F.coalesce(F.from_json(nested(b), BITSTREAMS), F.array().cast(BITSTREAMS))))
    first = F.try_element_at(F.filter(bits, lambda x: F.lower(x["name"]).endswith(".pdf")), F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["name"].alias("name"), F.coalesce(first["sizeBytes"], F.lit(0)).alias("bytes"), F.coalesce(first["_links"]["content"]["href"], F.lit("")).alias("url")))


def archive_pdf(files: Column) -> Column:
    """The PDF to take of an archive item's files (JSON list): the first with a text layer, else the first by name, or null."""
    each = F.from_json(files, "array<struct<name:string,format:string>>")
    layered = F.filter(each, lambda f: f["format"].isin("Text PDF", "Additional Text PDF"))
    named = F.filter(each, lambda f: F.lower(f["name"]).endswith(".pdf"))
    pick = F.coalesce(F.try_element_at(layered, F.lit(1)), F.try_element_at(named, F.lit(1)))
    return pick["name"]


def dataverse_files(content: Column) -> Column:
    """Files (name, id, size) of a dataset's latest version, by name."""
    each = F.from_json(F.get_json_object(content, "$.data.latestVersion.files"), "array<struct<dataFile:struct<id:long,filename:string,filesize:long>>>")
    rows = F.transform(each, lambda f: F.struct(f["dataFile"]["filename"].alias("name"), f["dataFile"]["id"].alias("id"), F.coalesce(f["dataFile"]["filesize"], F.lit(0)).alias("size")))
    return F.array_sort(rows)


def download(open_url, url: str, path: str, retries: int = 3, chunk: int = 1 << 20, wait: float = 0.0) -> int:
    """Fetches url by open_url (a readable for it) into path: into path.part first, which replaces path when it is whole, so
    a file is never half there. Returns its bytes; after so many failures the last error is raised."""
    import os
    import time

    for attempt in range(retries):
        try:
            size = 0
            with open_url(url) as source, open(f"{path}.part", "wb") as out:
                while block := source.read(chunk):
                    size += out.write(block)
            os.replace(f"{path}.part", path)
            return size
        except OSError:
            if attempt == retries - 1:
                raise
            time.sleep(wait * (attempt + 1))
    raise ValueError("no attempt was allowed")


def strips(height: int, count: int, overlap: int = 48) -> list[tuple[int, int]]:
    """Rows (from, to) of a page cut into strips that overlap, for readers with a limited resolution."""
    if count <= 1:
        return [(0, height)]
    step = max(1, height // count)
    return [(y, min(height, y + step + overlap)) for y in range(0, height, step)]


def joined_strips(reads: DataFrame, page: str = "page", lines: bool = False) -> DataFrame:
    """One text per page of reads(page, strip, text): strips in order, empty ones left out, and with blanks collapsed unless
    lines are to be kept."""
    rows = F.array_sort(F.collect_list(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct("strip", F.trim("text").alias("text")))))
    whole = F.array_join(F.transform(rows, lambda r: r["text"]), "\n")
    return reads.groupBy(page).agg((F.regexp_replace(whole, r"(?U)^\s+|\s+$", "") if lines else T.normalize(whole)).alias("text"))
