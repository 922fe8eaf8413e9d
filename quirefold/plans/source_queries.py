"""Queries of readers and writers, over the pages and documents or over small files given as literals."""
from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.sources import documents as R
from quirefold.sources import sinks as S

from . import derived as D

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


LINK = """WITH l AS (SELECT page_id, url, list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''#]+)', 1), lambda x: CASE WHEN regexp_matches(x, '^\\w+://') THEN x WHEN starts_with(x, '//') THEN regexp_extract(url, '^(\\w+:)', 1) || x
  WHEN starts_with(x, '/') THEN regexp_extract(url, '^(\\w+://[^/?#]+)', 1) || x ELSE regexp_extract(url, '^(\\w+://[^?#]*/)', 1) || x END) AS ls FROM pages),
e AS (SELECT page_id, ls[i] AS link, i FROM l, unnest(range(1, len(ls) + 1)) AS r(i)), f AS (SELECT page_id, link, min(i) AS i FROM e GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS k, link FROM f"""


@query("src_links", LINK)
def links(spark, sf):
    return R.links(D.table(spark, sf, "pages")).select("page_id", F.col("k").cast("long").alias("k"), "link")


@query("src_page_title", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS title FROM pages")
def title(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", R.page_title(F.col("html")).alias("title"))


@query("src_event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props(spark, sf):
    return D.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


ALTO = """<alto xmlns="http://x/ns#"><Layout><Page><TextLine HPOS="10" VPOS="20" WIDTH="30" HEIGHT="8"><String CONTENT="Total"/><SP/><String CONTENT="42"/></TextLine><TextLine HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"></TextLine></Page></Layout></alto>"""
PAGE = """<p:PcGts xmlns:p="http://y"><p:TextLine id="a"><p:Coords points="5,6 50,6 50,16 5,17"/><p:TextEquiv><p:Unicode> first  line </p:Unicode></p:TextEquiv></p:TextLine><p:TextLine><p:Coords points="0,0 1,1"/><p:TextEquiv><p:Unicode></p:Unicode></p:TextEquiv></p:TextLine></p:PcGts>"""
TSV = "level\tpage\tb\tp\tl\tw\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t91.5\tTotal\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\tbad"


def one_file(spark, content):
    return D.literals(spark, [("f", content)], "name string, content string")


@query("src_alto", "SELECT 'f' AS name, 0 AS line_no, 'Total 42' AS text, 10 AS x0, 20 AS y0, 40 AS x1, 28 AS y1")
def alto(spark, sf):
    return R.alto_lines(one_file(spark, ALTO))


@query("src_page_xml", "SELECT 'f' AS name, 0 AS line_no, 'first line' AS text, 5 AS x0, 6 AS y0, 50 AS x1, 17 AS y1")
def page_xml(spark, sf):
    return R.page_lines(one_file(spark, PAGE))


@query("src_tesseract_tsv", "SELECT 'f' AS name, 1 AS row, 'Total' AS text, 91.5::DOUBLE AS conf, 10 AS x0, 20 AS y0, 40 AS x1, 28 AS y1")
def tsv(spark, sf):
    return R.tesseract_tsv(one_file(spark, TSV))


@query("src_tesseract_osd", "SELECT 90 AS rotate, 2.5::DOUBLE AS confidence, 'Latin' AS script")
def osd(spark, sf):
    return one_file(spark, "Orientation in degrees: 270\nOrientation confidence: 2.5\nScript: Latin\n").select(R.tesseract_osd(F.col("content")).alias("o")).select("o.*")


@query("src_ocr_json", "SELECT * FROM (VALUES (0, 'a', 50.0::DOUBLE, 1, 2, 3, 4, 'x'), (1, '', 0.0, 0, 0, 0, 0, '')) AS v(pos, text, conf, x0, y0, x1, y1, flags)")
def ocr(spark, sf):
    rows = R.ocr_json(one_file(spark, '{"backend":"b","tokens":[{"text":"a","conf":50.0,"bbox":[1,2,3,4],"flags":["x"]},{}]}'))
    return rows.select("pos", "text", "conf", "x0", "y0", "x1", "y1", F.array_join("flags", "|").alias("flags"))


@query("src_corrections", "SELECT * FROM (VALUES ('p1', 0, 3, 'a', 'b', 'changed', 1), ('*', 0, 1, '', 'c', 'confirmed', -1)) AS v(page, seq, \"index\", original, corrected, action, x0)")
def corrections(spark, sf):
    text = '{"p1":[{"index":3,"original":"a","corrected":"b","action":"odd","bbox":[1,2,3,4]}],"*":[{"index":1,"corrected":"c","action":"confirmed","bbox":[1]}]}'
    return R.corrections_json(one_file(spark, text)).select("page", "seq", "index", "original", "corrected", "action", F.coalesce("x0", F.lit(-1)).alias("x0"))


@query("src_json_lines", "SELECT * FROM (VALUES (0, 'word', 'a'), (3, 'value', NULL)) AS v(seq, kind, word)")
def jsonl(spark, sf):
    return R.json_lines(one_file(spark, '{"kind":"word","word":"a"}\n\n{broken\n{"kind":"value"}\n[1]'), "kind string, word string").select("seq", "kind", "word")


@query("src_truth_text", "SELECT * FROM (VALUES ('{\"words\":[\"a\",\"b\"]}', 'a' || chr(10) || 'b'), ('{\"label\":\" x \"}', 'x'), ('{}', '')) AS v(r, t)")
def truth(spark, sf):
    return D.literals(spark, [('{"words":["a","b"]}',), ('{"label":" x "}',), ("{}",)], "r string").select("r", R.truth_text(F.col("r")).alias("t"))


@query("src_word_list", "SELECT * FROM (VALUES ('alpha'), ('beta')) AS v(word)")
def words(spark, sf):
    return R.word_list(one_file(spark, "# head\nalpha 3\n\nbeta\nalpha 4"))


@query("src_manifest", "SELECT * FROM (VALUES (0, 'gt', 'a/b.txt'), (0, 'image', 'c.png'), (1, 'gt', 'd.txt')) AS v(entry, role, path)")
def manifest_rows(spark, sf):
    return R.manifest_paths(one_file(spark, '{"entries":[{"gt":"a\\\\b.txt","image":{"path":"c.png"}},{"gt":"d.txt"}]}'))


@query("snk_ordered_text", f"WITH {D.TOK} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest FROM tok GROUP BY doc_id")
def ordered_text(spark, sf):
    return S.ordered_text(D.tok(spark, sf)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("snk_markdown", "SELECT doc_id, md5('## Page ' || doc_id || chr(10) || chr(10) || replace(text, '|', '\\|') || chr(10)) AS digest FROM documents")
def markdown(spark, sf):
    return S.markdown(D.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("snk_manifest", "SELECT page_id::VARCHAR AS path, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages")
def manifest(spark, sf):
    return S.manifest(D.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), "html"), "path", "html")


@query("snk_composition", "SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, avg(CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0::DOUBLE ELSE 0 END) AS digit_share FROM documents GROUP BY source")
def composition(spark, sf):
    return S.composition(D.table(spark, sf, "documents"), "source", "text")


@query("snk_run_report", "SELECT CASE WHEN text IS NULL THEN 'error' WHEN length(text) < 100 THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def report(spark, sf):
    status = F.when(F.col("text").isNull(), "error").when(F.length("text") < 100, "skipped").otherwise("ok")
    return S.run_report(D.table(spark, sf, "documents").withColumn("status", status))
