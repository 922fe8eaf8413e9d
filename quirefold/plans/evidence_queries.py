"""Queries of evidence, gates and summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import evidence as E
from quirefold.operators import flags as FL
from quirefold.operators import joins as J
from quirefold.operators import metrics as M

from . import derived as D
from .token_queries import READ, marked, tok

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def reads(spark, sf):
    return D.tok(spark, sf).where(T.has_digit(F.col("text"))).select("doc_id", "pos", D.second(F.col("text")).alias("read"))


HD = "regexp_matches(text, '[0-9]')"
OTHER = "regexp_replace(text, '[^0-9]', '', 'g') <> regexp_replace(translate(text, 'aeot130', 'eoat310'), '[^0-9]', '', 'g')"


@query("flg_digit_repass", f"WITH {D.TOK}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM tok WHERE {HD} AND conf < 95) SELECT doc_id, pos, {OTHER} AS conflict FROM k WHERE k <= 40")
def repass(spark, sf):
    return E.digit_repass(tok(spark, sf), reads(spark, sf)).select("doc_id", "pos", "conflict")


SUS = f"WITH {D.FLAGGED}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY risk DESC, y0, x0, pos) AS k FROM flagged WHERE {HD} AND len(flags) > 0 AND x1 - x0 <= 8 * (y1 - y0))"


@query("flg_digit_verifier", SUS + f" SELECT doc_id, pos, translate(text, 'aeot130', 'eoat310') AS alt_text FROM s WHERE k <= 12 AND {OTHER}")
def verifier(spark, sf):
    return E.verifier_conflicts(E.suspects(tok(spark, sf)), reads(spark, sf)).select("doc_id", "pos", "alt_text")


@query("flg_multi_read", SUS + f" SELECT doc_id, pos, 1::BIGINT AS valid, CASE WHEN {OTHER} THEN 'split' ELSE 'agree' END AS verdict FROM s WHERE k <= 12")
def panel(spark, sf):
    return E.multi_read(E.suspects(tok(spark, sf)), reads(spark, sf)).select("doc_id", "pos", "valid", "verdict")


@query("flg_page_shape", f"WITH {D.TOK}, s AS (SELECT doc_id, count(*) AS n, median((x1 - x0) / 30.0::DOUBLE) AS a, median((x1 - x0)::DOUBLE) AS w, max(x1) AS pw, avg(CASE WHEN 30.0 / greatest(x1 - x0, 1) >= 1.5 THEN 1.0::DOUBLE ELSE 0 END) AS t FROM tok GROUP BY doc_id) SELECT doc_id, a >= 5 AND w >= 0.25 * pw AS line_like, CASE WHEN n < 5 THEN 0.0::DOUBLE ELSE t END AS vertical, n >= 5 AND t >= 0.6 AS suspect FROM s")
def shape(spark, sf):
    return E.page_shape(D.tok(spark, sf))


TURNS = [(90, 5.0, 2000), (180, 5.0, 2000), (0, 9.0, 2000), (270, 1.0, 2000), (90, 9.0, 900)]


@query("flg_osd_rotation", f"SELECT rotate, confidence, side, CASE WHEN side < 1500 THEN 'skipped' WHEN confidence < 3 THEN 'low_confidence' WHEN rotate = 180 THEN 'not_applied' WHEN rotate = 0 THEN 'upright' ELSE 'rotate' END AS verdict FROM (SELECT rotate, confidence::DOUBLE AS confidence, side FROM {D.values(TURNS, 'rotate, confidence, side')})")
def osd(spark, sf):
    return D.literals(spark, TURNS, "rotate int, confidence double, side int").withColumn("verdict", E.osd_rotation(F.col("rotate"), F.col("confidence"), F.col("side")))


@query("flg_infer_angle", """WITH r AS (SELECT event_id, a.auto, event_id % 11 <> 3 AND event_id % 9 >= 5 AS known, value % 1 AS share, event_id % 10 >= 4 AS sure, event_id % 7 >= 5 AS up FROM events, (VALUES (TRUE), (FALSE)) AS a(auto)),
k AS (SELECT *, CASE WHEN known AND share >= 0.6 AND sure THEN 1 WHEN up THEN 2 WHEN known AND share >= 0.5 THEN 3 ELSE 4 END AS k FROM r)
SELECT event_id, auto, CASE WHEN k = 4 THEN 'upright' WHEN NOT auto THEN 'off' WHEN k = 1 THEN 'votes-180' WHEN k = 2 THEN 'probe-needed' ELSE 'vote-ambiguous' END AS source, CASE WHEN k = 1 AND auto THEN 180 ELSE 0 END AS angle, CASE k WHEN 1 THEN 180 WHEN 2 THEN 90 WHEN 3 THEN 180 END AS raw FROM k""")
def angle(spark, sf):
    c = F.col("event_id")
    share, up = F.when(c % 11 != 3, F.col("value") % 1), F.when(c % 7 >= 5, 0.7).otherwise(0.1)
    every = [D.table(spark, sf, "events").select("event_id", F.lit(auto).alias("auto"), FL.infer_angle(share, c % 10 / 10, up, c % 9, auto).alias("v")) for auto in (True, False)]
    return every[0].unionByName(every[1]).select("event_id", "auto", "v.*")


UPS = [("a.pdf", "%PDF-1"), ("b.exe", "MZ"), ("c.png", ""), ("d.pdf", "nope"), ("e.bmp", "x"), ("f.webp", "RIFF")]


@query("flg_upload_error", f"SELECT name, CASE WHEN NOT regexp_matches(name, '\\.(pdf|png|jpg|jpeg|tif|tiff|webp|bmp)$') THEN 'extension' WHEN strlen(content) = 0 THEN 'empty' WHEN name LIKE '%.pdf' AND NOT starts_with(content, '%PDF') THEN 'magic' WHEN name LIKE '%.bmp' THEN 'decode' END AS error FROM {D.values(UPS, 'name, content')}")
def uploads(spark, sf):
    return D.literals(spark, UPS, "name string, content string").select("name", E.upload_error(F.col("name"), F.col("content").cast("binary")).alias("error"))


@query("flg_reader_plausible", f"WITH {D.TOK} SELECT doc_id, count(*) FILTER (length(text) BETWEEN 1 AND 64) AS plausible, count(*) FILTER (NOT {HD} AND regexp_matches(text || (pos % 3), '[12]')) AS added FROM tok GROUP BY doc_id")
def plausible(spark, sf):
    more = F.when(F.col("pos") % 3 > 0, F.concat("text", (F.col("pos") % 3).cast("string"))).otherwise(F.col("text"))
    return D.tok(spark, sf).groupBy("doc_id").agg(F.count(F.when(E.reader_plausible(F.col("text")), 1)).alias("plausible"), F.count(F.when(E.digit_added(F.col("text"), more), 1)).alias("added"))


@query("flg_confusion_chips")
def chips(spark, sf):
    rows = tok(spark, sf)
    queue = FL.review_queue(rows)
    values = rows.where(T.has_digit(F.col("text"))).select("doc_id", T.memory_digits(F.col("text")).alias("value")).distinct()
    return E.confusion_chips(queue, values).select("doc_id", "pos", "text", F.array_join("chips", "|").alias("chips"))


RUN = "[0-9](?:[0-9.,:/-]*[0-9])?"


@query("agg_error_taxonomy_rollup", f"""WITH {D.TOK}, e AS (SELECT lang, source, CASE WHEN coalesce(array_to_string(regexp_extract_all(text, '{RUN}'), ' '), '') <> coalesce(array_to_string(regexp_extract_all(h, '{RUN}'), ' '), '') THEN 'digit' WHEN list_sort(string_split(text, '')) = list_sort(string_split(h, '')) THEN 'order'
  WHEN len(list_intersect(string_split(text, ''), string_split(h, ''))) = 0 THEN 'unrelated' ELSE 'other' END AS kind FROM (SELECT *, translate(text, 'aeot130', 'eoat310') AS h FROM tok) WHERE text <> h)
SELECT lang, source, kind, count(*) AS n FROM e GROUP BY ROLLUP (lang, source, kind) HAVING kind IS NOT NULL OR lang IS NULL""")
def taxonomy(spark, sf):
    pairs = D.tok(spark, sf).select("lang", "source", F.col("text").alias("gt"), D.second(F.col("text")).alias("hyp"))
    return E.error_taxonomy(pairs, "lang", "source")


GRIDS = [(1, 0.50, 0.80), (2, 0.61, 0.79), (3, 0.612, 0.797), (4, 0.9, 0.5)]


@query("agg_near_best", "SELECT 3 AS config, 0.612::DOUBLE AS recall, 0.797::DOUBLE AS precision")
def near_best(spark, sf):
    return E.near_best(D.literals(spark, GRIDS, "config int, recall double, precision double"), "config", "recall", "precision", 0.8)


@query("agg_verifier_table", f"WITH {D.TOK}, r AS (SELECT lang, text AS truth, translate(text, 'aeot130', 'eoat310') AS engine, translate(text, 'rnls24', 'nrsl42') AS verifier FROM tok) SELECT lang, count(*) FILTER (verifier <> engine) AS conflicts, count(*) FILTER (verifier <> engine AND engine = truth) AS engine_right, count(*) FILTER (verifier <> engine AND verifier = truth) AS fixes, count(*) FILTER (verifier <> engine AND engine <> truth AND verifier <> truth) AS both_wrong, (count(*) FILTER (verifier <> engine) - count(*) FILTER (verifier <> engine AND engine = truth))::DOUBLE / nullif(count(*) FILTER (verifier <> engine), 0) AS precision FROM r GROUP BY lang")
def verifier_table(spark, sf):
    return E.verifier_table(D.tok(spark, sf).select("lang", F.col("text").alias("truth"), D.second(F.col("text")).alias("engine"), D.third(F.col("text")).alias("verifier")), ["lang"])


@query("agg_ab_gate", f"""WITH {READ}, s AS (SELECT lang, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(CASE WHEN len(flags) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS fl FROM marked GROUP BY lang), o AS (SELECT lang, avg(CASE WHEN len(flags) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS fl FROM flagged GROUP BY lang)
SELECT s.lang, 1.0::DOUBLE - acc AS gain, s.fl - o.fl AS loss, 1.0::DOUBLE - acc >= 0.1 AS gain_ok, s.fl - o.fl <= 0.0 AS loss_ok, 1.0::DOUBLE - acc >= 0.1 AND s.fl - o.fl <= 0.0 AS pass FROM s JOIN o USING (lang)""")
def ab_gate(spark, sf):
    share = lambda df, arm: df.groupBy("lang").agg(F.avg(F.col("ok").cast("double")).alias("acc"), F.avg((F.size("flags") > 0).cast("double")).alias("fl")).withColumn("arm", F.lit(arm))
    on = share(tok(spark, sf).withColumn("ok", F.lit(True)), "on")
    return M.gate(share(marked(spark, sf), "off").unionByName(on), "lang", "off", "on", "acc", "fl", 0.1, 0.0)


@query("flg_router_verdict", "SELECT source, count(*) > 10 AS enough, avg(length(text)) > 500 AS long, count(*) > 10 AND avg(length(text)) > 500 AS pass FROM documents GROUP BY source")
def router(spark, sf):
    s = D.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("l"))
    return s.select("source", *E.router_verdict(enough=F.col("n") > 10, long=F.col("l") > 500))


@query("join_page_override", "SELECT lang, CASE lang WHEN 'de' THEN 'own' ELSE 'rest' END AS mode, count(*) AS n FROM documents GROUP BY ALL")
def override(spark, sf):
    settings = D.literals(spark, [("de", "own"), ("*", "rest")], "lang string, mode string")
    return J.page_override(D.table(spark, sf, "documents").select("lang"), settings, "lang", "mode").groupBy("lang", "mode").agg(F.count("*").alias("n"))


@query("join_overlap_semi", f"WITH {D.TOK} SELECT doc_id, count(*) AS n FROM tok WHERE y0 // 40 % 2 = 0 AND x0 <= 500 GROUP BY doc_id")
def overlap(spark, sf):
    rows = D.tok(spark, sf)
    lines = rows.where(F.floor(F.col("y0") / 40) % 2 == 0).select("doc_id", F.lit(0).alias("lx0"), F.col("y0").alias("ly0"), F.lit(500).alias("lx1"), (F.col("y0") + 5).alias("ly1")).distinct()
    return J.overlapping(rows, lines).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("join_parameter_sweep", f"WITH {D.FLAGGED}, g AS (SELECT * FROM (VALUES (30), (60), (90)) AS v(bar)) SELECT bar, lang, count(*) FILTER (conf < bar) AS low, count(*) AS n FROM flagged, g GROUP BY ALL")
def sweep(spark, sf):
    rows = D.tok(spark, sf).groupBy("lang", "conf").agg(F.count("*").alias("k"))  # a value's tokens first, then the grid
    grid = rows.withColumn("bar", F.explode(F.array(*map(F.lit, (30, 60, 90)))))
    return grid.groupBy("bar", "lang").agg(F.sum(F.when(F.col("conf") < F.col("bar"), F.col("k")).otherwise(0)).alias("low"), F.sum("k").alias("n"))


@query("join_paired_ab", f"WITH {D.LINES} SELECT lang, count(*) AS n, count(*) FILTER (text <> translate(text, 'aeot130', 'eoat310')) AS changed FROM lines GROUP BY lang")
def paired(spark, sf):
    rows = D.lines(spark, sf)
    on = rows.select("doc_id", "ln", D.second(F.col("text")).alias("other"))
    return rows.join(on, ["doc_id", "ln"]).groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("text") != F.col("other"), 1)).alias("changed"))


@query("join_digit_inventions", f"WITH {D.FLAGGED} SELECT doc_id, pos, text, len(flags) > 0 AS flagged FROM flagged WHERE {HD} AND (y0 // 40) % 2 = 0")
def inventions(spark, sf):
    rows = tok(spark, sf)
    odd = F.floor(F.col("y0") / 40) % 2 == 1
    lines = rows.select("doc_id", F.lit(0).alias("lx0"), F.col("y0").alias("ly0"), F.lit(5000).alias("lx1"), (F.col("y0") + 30).alias("ly1"), F.when(odd, "7").otherwise("none").alias("line_text")).distinct()
    return J.digit_inventions(rows, lines)


@query("agg_textbook_profile", "SELECT source, count(*) AS pages, sum(CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END)::DOUBLE / count(*) AS with_digits, median(length(text)) AS median_chars FROM documents GROUP BY source")
def profile(spark, sf):
    return D.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("pages"), (F.count(F.when(T.has_digit(F.col("text")), 1)) / F.count("*")).alias("with_digits"), F.percentile(F.length("text"), F.lit(0.5)).alias("median_chars"))


@query("agg_majority_vote", "WITH c AS (SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS total FROM documents GROUP BY source, lang) SELECT source, lang FROM c WHERE n >= 0.6 * total")
def majority(spark, sf):
    c = D.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    t = c.groupBy("source").agg(F.sum("n").alias("total"), F.max(F.struct("n", "lang")).alias("b"))
    return t.where("b.n >= 0.6 * total").select("source", F.col("b.lang").alias("lang"))
