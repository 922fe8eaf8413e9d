"""Queries of review sessions, their records, and curation."""
from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import curation as C
from quirefold.operators import flags as FL
from quirefold.operators import metrics as M
from quirefold.operators import review as R
from quirefold.sources import sinks as S

from . import derived as D
from .text_queries import NORM, PUNCT, W, sql_norm_tokens
from .token_queries import CORR, QUEUE, corrections, readings, tok

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def held(spark, sf):
    """Flagged tokens, as a session's queue names them."""
    return tok(spark, sf).where(F.size("flags") > 0).withColumn("index", F.col("pos"))


def docs(spark, sf):
    return D.table(spark, sf, "documents")


HELD = D.FLAGGED + ", held AS (SELECT * FROM flagged WHERE len(flags) > 0)"
SECOND = D.SECOND.format("text")


@query("join_compose", f"WITH {HELD} SELECT doc_id, pos AS index, text AS original, CASE WHEN pos % 2 = 0 THEN {SECOND} ELSE text END AS corrected, CASE WHEN pos % 2 = 0 THEN 'changed' ELSE 'confirmed' END AS action, x0 FROM held WHERE pos % 3 = 0")
def compose(spark, sf):
    queue = held(spark, sf)
    edits = queue.where("pos % 3 = 0").select("doc_id", (F.col("pos") + 1).alias("line"), "index", F.when(F.col("pos") % 2 == 0, "changed").otherwise("confirmed").alias("action"), D.second(F.col("text")).alias("text"))
    return R.compose(edits, queue, ["doc_id"]).select("doc_id", "index", "original", "corrected", "action", "x0")


@query("join_fresh_entries", f"""WITH {D.TOK}, {CORR}, p AS (SELECT doc_id AS run, seq, index, CASE WHEN seq % 6 = 1 THEN NULL ELSE original END AS original, corrected, action FROM corr),
seen AS (SELECT * FROM p WHERE seq % 4 = 1), raw AS (SELECT run, index, arg_max('s' || (seq % 5), seq) AS suggested FROM p WHERE seq % 2 = 0 GROUP BY ALL)
SELECT p.run, p.seq, p.index, p.corrected, suggested FROM p LEFT JOIN raw USING (run, index)
WHERE NOT EXISTS (FROM seen s WHERE s.run = p.run AND s.index IS NOT DISTINCT FROM p.index AND s.original IS NOT DISTINCT FROM p.original AND s.corrected IS NOT DISTINCT FROM p.corrected AND s.action IS NOT DISTINCT FROM p.action)""")
def fresh(spark, sf):
    p = corrections(spark, sf).withColumnRenamed("doc_id", "run").withColumn("original", F.when(F.col("seq") % 6 != 1, F.col("original")))
    raw = p.where("seq % 2 = 0").select("run", "seq", "index", F.concat(F.lit("s"), (F.col("seq") % 5).cast("string")).alias("suggested"))
    return R.fresh_entries(p, raw, p.where("seq % 4 = 1")).select("run", "seq", "index", "corrected", "suggested")


@query("join_readings_or_truth", f"SELECT doc_id AS page, md5(CASE WHEN doc_id % 6 = 3 THEN {SECOND} ELSE text END) AS digest FROM documents WHERE regexp_replace(text, '{W}', '', 'g') <> ''")
def readings_or_truth(spark, sf):
    pages = docs(spark, sf).select(F.col("doc_id").alias("page"), F.col("text").alias("gt"))
    reads = pages.where("page % 3 = 0").select("page", F.when(F.col("page") % 2 == 0, "  ").otherwise(D.second(F.col("gt"))).alias("reading"))
    return R.readings_or_truth(pages, reads).select("page", F.md5(F.col("gt").cast("binary")).alias("digest"))


@query("join_targets", f"WITH {HELD} SELECT doc_id, pos AS index, CASE pos % 4 WHEN 0 THEN {SECOND} WHEN 1 THEN text END AS target FROM held")
def targets(spark, sf):
    queue = held(spark, sf).select("doc_id", "index", "text")
    acts = queue.where("index % 4 < 2").select("doc_id", "index", F.when(F.col("index") % 4 == 0, "changed").otherwise("confirmed").alias("action"), F.lit(None).cast("string").alias("original"), D.second(F.col("text")).alias("corrected"))
    return R.targets(queue, acts, ["doc_id"]).select("doc_id", "index", "target")


@query("cur_session_queue", f"WITH {D.FLAGGED} SELECT doc_id, pos AS index, conf, risk, {QUEUE} AS rn FROM flagged WHERE len(flags) > 0 AND doc_id % 5 <> 0")
def session_queue(spark, sf):
    return R.session_queue(tok(spark, sf), docs(spark, sf).where("doc_id % 5 = 0").select("doc_id")).select("doc_id", "index", "conf", "risk", "rn")


@query("agg_session_report", f"""WITH {HELD}, s AS (SELECT doc_id % 10 AS session, count(*) AS queued, count(*) FILTER (pos % 3 = 0 AND pos % 2 = 0) AS changed, count(*) FILTER (pos % 3 = 0 AND pos % 4 = 1) AS confirmed, count(*) FILTER (pos % 3 = 0 AND pos % 4 = 3) AS skipped FROM held GROUP BY ALL)
SELECT count(*) AS sessions, CAST(sum(queued) AS BIGINT) AS queued, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(confirmed) AS BIGINT) AS confirmed, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(changed + confirmed) AS BIGINT) AS acted,
  sum(changed + confirmed)::DOUBLE / sum(queued) AS acted_fraction, count(*) FILTER (changed + confirmed >= 0.2 * queued) AS sessions_meeting_bar FROM s""")
def session_report(spark, sf):
    queue = held(spark, sf).withColumn("session", F.col("doc_id") % 10)
    status = F.when(F.col("pos") % 2 == 0, "changed").when(F.col("pos") % 4 == 1, "confirmed").otherwise("skipped")
    return R.session_report(R.session_stats(queue, queue.where("pos % 3 = 0").withColumn("status", status), ["session"]))


@query("cur_import_labels", f"WITH {D.TOK} SELECT doc_id || '_' || CASE WHEN pos < 10000 THEN lpad(pos::VARCHAR, 4, '0') ELSE left(pos::VARCHAR, 4) END || '.png' AS file, text, doc_id, pos FROM tok WHERE pos % 3 = 0 AND regexp_matches(text, '[0-9]')")
def import_labels(spark, sf):
    return R.import_labels(D.tok(spark, sf).withColumn("corrected_by", F.when(F.col("pos") % 3 == 0, "human")))


@query("snk_shared_labels", f"""WITH {D.TOK}, {CORR} SELECT doc_id || '_' || CASE WHEN index < 10000 THEN lpad(index::VARCHAR, 4, '0') ELSE left(index::VARCHAR, 4) END || '.png' AS file, CASE WHEN action = 'confirmed' THEN original ELSE corrected END AS text FROM corr WHERE index % 5 = 0 AND seq % 7 <> 2""")
def shared_labels(spark, sf):
    rows = corrections(spark, sf).withColumn("x0", F.when(F.col("seq") % 7 != 2, F.col("x0")))
    return R.shared_labels(rows, rows.where("index % 5 = 0").select("doc_id", "index"))


@query("snk_corrections_record", f"WITH {D.TOK}, {CORR} SELECT doc_id, 'corrections' AS kind, 1 AS version, count(*) FILTER (action = 'changed') AS changed, count(*) AS applied, min(index) AS first, arg_min(corrected, (index, x0, original, corrected)) AS first_text FROM corr GROUP BY doc_id")
def corrections_record(spark, sf):
    made = R.corrections_record(corrections(spark, sf).withColumn("status", F.col("action")))
    schema = "struct<kind:string,version:int,page:long,stats:struct<changed:long>,applied:array<struct<index:long,corrected:string>>>"
    j = made.select("doc_id", F.from_json("json", schema).alias("j"))
    return j.select("doc_id", "j.kind", "j.version", F.col("j.stats.changed").alias("changed"), F.size("j.applied").cast("long").alias("applied"), F.col("j.applied")[0]["index"].alias("first"), F.col("j.applied")[0]["corrected"].alias("first_text"))


@query("snk_run_summary", f"""WITH {D.FLAGGED}, r AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN {SECOND} ELSE text END AS text, CASE WHEN doc_id % 3 = 0 AND pos % 2 = 0 THEN [] ELSE flags END AS flags FROM flagged)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (len(flags) > 0) AS review, md5(string_agg(text, chr(10) ORDER BY pos)) AS transcript, count(*) FILTER (list_contains(flags, 'low_conf')) AS low FROM r GROUP BY doc_id""")
def run_summary(spark, sf):
    rows = tok(spark, sf, by_page=False)
    none = F.array().cast("array<string>")
    fixed = rows.where("doc_id % 3 = 0").withColumns({"text": D.second(F.col("text")), "flags": F.when(F.col("pos") % 2 == 0, none).otherwise(F.col("flags"))})
    out = R.run_summary(rows, fixed)
    return out.select("doc_id", "n_tokens", "review", F.md5(F.col("transcript").cast("binary")).alias("transcript"), F.coalesce(F.try_element_at("flags_summary", F.lit("low_conf")), F.lit(0)).alias("low"))


@query("cur_status_line", f"""WITH {D.FLAGGED} SELECT doc_id, count(*) || ' tokens · ' || count(*) FILTER (list_contains(flags, 'low_conf')) || ' low-confidence · 0 digit conflicts · ' || count(*) FILTER (len(flags) > 0) || ' to review' || CASE WHEN doc_id % 4 = 0 THEN ' · orientation?' ELSE '' END || ' · ' || printf('%.1fs', (doc_id % 50) / 10.0::DOUBLE) AS status FROM flagged GROUP BY doc_id""")
def status_line(spark, sf):
    return R.status_line(tok(spark, sf).withColumns({"suspect": F.col("doc_id") % 4 == 0, "seconds": (F.col("doc_id") % 50) / 10}))


LANGS = [None, "ne", "en", "Hindi", "DEVA ", "hin"]


@query("flg_repass_default", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE event_id % 6 IN (1, 4, 5) END AS again FROM events")
def repass_default(spark, sf):
    asked = F.when(F.col("event_id") % 4 == 0, F.lit(True)).when(F.col("event_id") % 4 == 1, F.lit(False))
    lang = F.get(F.array(*map(F.lit, LANGS)), (F.col("event_id") % 6).cast("int"))
    return D.table(spark, sf, "events").select("event_id", R.repass_default(asked, lang).alias("again"))


@query("snk_ocr_result", f"""WITH {D.FLAGGED}, q AS (SELECT *, CASE WHEN len(flags) > 0 THEN row_number() OVER (PARTITION BY doc_id, len(flags) > 0 ORDER BY risk DESC, y0, x0, pos) END AS rn FROM flagged)
SELECT doc_id, count(*) AS tokens, count(rn) AS review, max(CASE WHEN rn = 1 THEN pos END) AS riskiest, max(CASE WHEN rn = 1 THEN risk END) AS risk, md5(string_agg(text, '|' ORDER BY pos)) AS digest FROM q GROUP BY doc_id""")
def ocr_result(spark, sf):
    schema = "struct<review:array<struct<index:long,risk:double>>,tokens:array<struct<text:string>>>"
    j = S.ocr_result(tok(spark, sf)).select("doc_id", F.from_json("json", schema).alias("j"))
    first = F.get("j.review", 0)
    return j.select("doc_id", F.size("j.tokens").cast("long").alias("tokens"), F.size("j.review").cast("long").alias("review"), first["index"].alias("riskiest"), first["risk"].alias("risk"), F.md5(F.array_join("j.tokens.text", "|").cast("binary")).alias("digest"))


MARKDOWN = f"""{D.FLAGGED}, q AS (SELECT *, CASE WHEN len(flags) > 0 THEN row_number() OVER (PARTITION BY doc_id, len(flags) > 0 ORDER BY risk DESC, y0, x0, pos) END AS rn FROM flagged),
md AS (SELECT doc_id, any_value(source) AS source, '*engine · ' || count(*) || ' tokens · ' || count(*) FILTER (list_contains(flags, 'low_conf')) || ' low-confidence · 0 digit conflicts · ' || count(rn) || ' to review*' || chr(10) || chr(10)
  || string_agg(text, chr(10) ORDER BY pos) || CASE WHEN count(rn) > 0 THEN chr(10) || chr(10) || '## Review queue' || chr(10) || chr(10) || '| token | flags | alternative | conf |' || chr(10) || '|---|---|---|---|' || chr(10)
  || string_agg('| `' || replace(text, '|', '\\|') || '` | ' || array_to_string(flags, ', ') || ' | — | ' || CAST(conf AS BIGINT) || ' |', chr(10) ORDER BY rn) FILTER (rn IS NOT NULL) ELSE '' END || chr(10) AS text FROM q GROUP BY doc_id)"""


@query("snk_transcript", f"WITH {MARKDOWN} SELECT doc_id, md5(text) AS digest FROM md")
def transcript(spark, sf):
    return S.transcript(tok(spark, sf), "engine").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("snk_combined", f"WITH {MARKDOWN}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM md) SELECT source, md5('# All' || chr(10) || chr(10) || string_agg('## Page ' || k || chr(10) || chr(10) || text, chr(10) ORDER BY k)) AS digest FROM n GROUP BY source")
def combined(spark, sf):
    rows = S.transcript(tok(spark, sf), "engine").join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return S.combined(rows, "source", "All").select("source", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("snk_corpus_file", "SELECT source, count(*) AS lines, sha256(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS sha256 FROM documents GROUP BY source")
def corpus_file(spark, sf):
    return S.corpus_file(docs(spark, sf).select("source", "doc_id", "text"), "source", "doc_id").select("source", "lines", "sha256")


@query("snk_lexicon_file", "SELECT '# words of the benchmark' AS line UNION ALL SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) FROM benchmark")
def lexicon_file(spark, sf):
    words = D.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return S.lexicon_file(words, "words of the benchmark")


@query("snk_review_sheet", "SELECT doc_id, n_chars FROM documents")
def review_sheet(spark, sf):
    return S.review_sheet(docs(spark, sf).select("doc_id", "n_chars"), "n_chars", ["doc_id"])


ESCAPED = "replace(replace(replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


@query("snk_worksheet", f"""WITH {D.TOK}, k AS (SELECT DISTINCT doc_id, unnest({sql_norm_tokens(SECOND)}) AS t, TRUE AS hit FROM documents),
m AS (SELECT tok.doc_id, pos, text AS w, lower(trim(text, '{PUNCT}')) AS t FROM tok)
SELECT doc_id, md5(string_agg(CASE WHEN hit IS NULL AND t <> '' THEN '<mark>' || {ESCAPED} || '</mark>' ELSE {ESCAPED} END, ' ' ORDER BY pos)) AS digest FROM m LEFT JOIN k USING (doc_id, t) GROUP BY doc_id""")
def worksheet(spark, sf):
    other = docs(spark, sf).withColumn("text", D.second(F.col("text")))
    return S.worksheet(docs(spark, sf).select("doc_id", "text"), M.truth_tokens(other, "doc_id", "text", False)).select("doc_id", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("snk_licences", "SELECT DISTINCT source AS name, CASE source WHEN 'wiki' THEN 'cc-by-sa' ELSE CASE WHEN length(source) % 2 = 0 THEN 'free' ELSE 'unknown' END END AS licence FROM documents")
def licences(spark, sf):
    packages = docs(spark, sf).select(F.col("source").alias("name")).distinct().withColumn("licence", F.when(F.length("name") % 2 == 0, "free").otherwise(" "))
    return C.licence_report(packages, {"wiki": "cc-by-sa"})


# curation

LEVELS = ["light", "medium", "heavy"]
PAGES = "p AS (SELECT source AS doc, doc_id AS page, CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS text FROM documents), "


def pages(spark, sf):
    return docs(spark, sf).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("text")).alias("text"))


PLAN = "SELECT doc, page, ['light', 'medium', 'heavy'][1 + n % 3] AS level, 1234 + n AS seed FROM (SELECT *, row_number() OVER (ORDER BY doc, page) - 1 AS n FROM {})"


@query("cur_dataset_plan", f"WITH {PAGES} k AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS k FROM p WHERE text <> ''), c AS (SELECT doc, page FROM k WHERE k <= 3 ORDER BY doc, page LIMIT 40) " + PLAN.format("c"))
def dataset_plan(spark, sf):
    return C.dataset_plan(pages(spark, sf), LEVELS, 3, 40).drop("text")


@query("cur_dataset_plan_whole", f"WITH {PAGES} c AS (SELECT doc, page FROM p WHERE text <> '') " + PLAN.format("c"))
def dataset_plan_whole(spark, sf):
    return C.dataset_plan(pages(spark, sf), LEVELS).drop("text")


@query("cur_streamed_pages", "SELECT doc_id FROM documents WHERE doc_id >= 10 AND doc_id % 7 <> 0 AND length(text) >= 20 ORDER BY doc_id LIMIT 100")
def streamed_pages(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.col("text").alias("gt"), F.when(F.col("doc_id") % 7 != 0, "x").alias("image"))
    return C.streamed_pages(rows, "doc_id", 10, 100).select("doc_id")


@query("cur_line_crops", f"WITH {D.LINES} SELECT doc_id, ln FROM lines WHERE regexp_replace(text, '{W}', '', 'g') <> '' AND doc_id % 7 <> 0")
def line_crops(spark, sf):
    rows = D.lines(spark, sf).select("doc_id", "ln", F.col("text").alias("ocr"), F.when(F.col("doc_id") % 7 != 0, "x").alias("image"))
    return C.line_crops(rows, "doc_id").select("doc_id", "ln")


@query("join_unfrozen", "SELECT doc_id AS page FROM documents WHERE doc_id % 4 <> 0")
def unfrozen(spark, sf):
    rows = docs(spark, sf).select("doc_id", "source")
    here = rows.select(F.concat(F.lit("in/"), "source", F.lit(".pdf")).alias("source"), F.col("doc_id").alias("page"))
    there = rows.where("doc_id % 4 = 0").select(F.concat(F.lit("c:\\x\\"), "source", F.lit(".pdf")).alias("source"), F.col("doc_id").alias("page"))
    return C.unfrozen(here, there).select("page")


@query("cur_pages_after", "WITH f AS (SELECT source || '.pdf' AS source, max(doc_id) + 1 AS s FROM documents GROUP BY source) SELECT source, unnest(range(s, least(s + 4, s + (length(source) - 4) % 6))) AS page FROM f")
def pages_after(spark, sf):
    rows = docs(spark, sf).select(F.concat(F.lit("in/"), "source", F.lit(".pdf")).alias("source"), F.col("doc_id").alias("page"))
    sizes = rows.groupBy("source").agg((F.max("page") + 1 + (F.length("source") - 7) % 6).alias("pages"))
    return C.pages_after(rows, sizes, 4)


@query("cur_aligned_labels", f"WITH {D.LINES}, r AS (SELECT doc_id AS page, ln AS i, {NORM} AS text FROM lines), g AS (SELECT *, length(text) BETWEEN 3 AND 48 AND regexp_matches(text, '[A-Za-z]') AS fits FROM r) SELECT page, i, fits AND row_number() OVER (PARTITION BY page, text, fits ORDER BY i) = 1 AS kept FROM g")
def aligned_labels(spark, sf):
    rows = D.lines(spark, sf).select(F.col("doc_id").alias("page"), F.col("ln").alias("i"), "text")
    return C.aligned_labels(rows, own=F.col("text").rlike("[A-Za-z]")).select("page", "i", "kept")


@query("cur_montage_reasons", f"WITH {D.LINES}, r AS (SELECT CASE WHEN {NORM} = '' THEN 'empty' WHEN length({NORM}) NOT BETWEEN 3 AND 48 THEN 'length' WHEN NOT regexp_matches(text, '[0-9]') THEN 'chars' END AS reason FROM lines) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def montage_reasons(spark, sf):
    return D.lines(spark, sf).groupBy(C.montage_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


@query("cur_label_run", f"WITH {D.TOK}, s AS (SELECT doc_id, avg(CASE WHEN contains(text, 'e') THEN 1.0::DOUBLE ELSE 0 END) AS share FROM tok GROUP BY doc_id) SELECT d.doc_id AS page, coalesce(share, 0) AS share, CASE WHEN coalesce(share, 0) < 0.3 THEN 'skipped' ELSE 'todo' END AS status FROM documents d LEFT JOIN s USING (doc_id) WHERE d.doc_id % 6 <> 0")
def label_run(spark, sf):
    here = docs(spark, sf).select(F.col("doc_id").alias("page"))
    return C.label_run(here, here.where("page % 6 = 0"), D.tok(spark, sf).withColumnRenamed("doc_id", "page"), F.col("text").contains("e"), 0.3)


@query("cur_digit_crops", f"WITH {D.TOK}, r AS (SELECT doc_id, pos, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM tok WHERE regexp_matches(text, '[0-9]') AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= 0.5 * length(text)) SELECT doc_id || '_c' || CASE WHEN pos < 10 THEN '0' ELSE '' END || pos AS crop_id, text AS engine_guess FROM r WHERE k <= 3")
def digit_crops(spark, sf):
    return C.digit_crops(D.tok(spark, sf), 3).select("crop_id", "engine_guess")


@query("cur_sheet_import", """WITH r AS (SELECT doc_id, 'c' || doc_id AS crop_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'no digit' ELSE 'a' || chr(9) || doc_id END AS t FROM documents WHERE doc_id % 13 <> 0),
s AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'missing_crop' WHEN t IS NULL THEN 'malformed_tsv_row' WHEN trim(t) = '' THEN 'rejected_blank' WHEN NOT regexp_matches(t, '[0-9]') THEN 'no_digit' WHEN doc_id % 11 = 0 THEN 'unreadable_crop' END AS reason FROM r)
SELECT crop_id, CASE WHEN reason IS NULL THEN replace(t, chr(9), ' ') END AS text, reason FROM s""")
def sheet_import(spark, sf):
    c = F.col("doc_id")
    typed = F.when(c % 5 == 0, F.lit(None)).when(c % 5 == 1, "  ").when(c % 5 == 2, "no digit").otherwise(F.concat(F.lit("a\t"), c.cast("string")))
    rows = docs(spark, sf).select(F.when(c % 13 != 0, F.concat(F.lit("c"), c.cast("string"))).otherwise("").alias("crop_id"), typed.alias("true_text"))
    crops = docs(spark, sf).where("doc_id % 7 <> 0").select(F.concat(F.lit("c"), c.cast("string")).alias("crop_id"), (c % 11 != 0).alias("readable"))
    return C.sheet_import(rows, crops)


WORDS = "unnest(regexp_extract_all(lower(text), '\\p{L}+'))"


def words_of(spark, sf, name):
    return D.table(spark, sf, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))


@query("cur_word_set", f"WITH w AS (SELECT {WORDS} AS word FROM conversations) SELECT DISTINCT word, (SELECT count(*) FROM w WHERE length(word) < 4) AS dropped FROM w WHERE length(word) >= 4")
def word_set(spark, sf):
    return C.word_set(words_of(spark, sf, "conversations"), F.length("word") >= 4)


@query("cur_words_to_learn", f"WITH l AS (SELECT {WORDS} AS word FROM benchmark), w AS (SELECT DISTINCT {WORDS} AS word FROM documents) SELECT word FROM w WHERE length(word) >= 4 AND word NOT IN (SELECT word FROM l)")
def words_to_learn(spark, sf):
    return C.words_to_learn(docs(spark, sf), words_of(spark, sf, "benchmark"), F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))


@query("cur_digit_runs", f"SELECT DISTINCT doc_id, translate(unnest(regexp_extract_all(text, '[0-9]{{3,}}')), '0123456789', '{T.DEVA_DIGITS}') AS run FROM documents")
def digit_runs(spark, sf):
    return C.digit_runs(docs(spark, sf), ["doc_id"], 3)


@query("cur_harvest", "WITH s AS (SELECT source, avg(length(text)) AS c, avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END) AS l, avg(CASE WHEN contains(text, 'ß') THEN 1.0::DOUBLE ELSE 0 END) AS d FROM documents GROUP BY source), r AS (SELECT source, CASE WHEN c < 300 THEN 'too_little_text' WHEN l < 0.4 THEN 'not_the_script' WHEN d > 0.02 THEN 'damaged_text' END AS reason FROM s) SELECT source, reason, reason IS NULL AS accepted FROM r")
def harvest(spark, sf):
    share = lambda clause: F.avg(clause.cast("double"))
    s = docs(spark, sf).groupBy("source").agg(F.avg(F.length("text")).alias("c"), share(F.col("lang") == "en").alias("l"), share(F.col("text").contains("ß")).alias("d"))
    return C.harvest_report(s, FL.harvest_reason(F.col("c"), F.col("l"), F.col("d"))).select("source", "reason", "accepted")


ANCHOR = f"""r AS (SELECT doc_id, 1 AS k, text FROM documents UNION ALL SELECT doc_id, 2, {SECOND} FROM documents), e AS (SELECT DISTINCT doc_id, k, unnest({sql_norm_tokens('text')}) AS t FROM r), s AS (SELECT doc_id, t, count(*) AS n FROM e GROUP BY ALL),
a AS (SELECT d.lang AS doc, d.doc_id AS page, CASE WHEN count(t) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (n = 2)::DOUBLE / count(t) END AS agreement_rate FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY doc, agreement_rate < 0.3 ORDER BY agreement_rate, page) AS turn FROM a), w AS (SELECT page FROM p WHERE agreement_rate < 0.3 ORDER BY turn, doc LIMIT 8)"""


def agreed(spark, sf):
    rows = D.pages(spark, sf)
    rates = M.agreement(readings(rows, F.col("text"), D.second(F.col("text")))).select(F.col("doc_id").alias("page"), "agreement_rate")
    return rates.join(rows.select(F.col("doc_id").alias("page"), F.col("lang").alias("doc")), "page")


@query("cur_anchor_status", f"WITH {ANCHOR} SELECT doc, page, CASE WHEN agreement_rate >= 0.3 THEN 'consensus' WHEN page IN (SELECT page FROM w) THEN 'worksheet' ELSE 'rest' END AS status FROM a")
def anchor_status(spark, sf):
    return C.anchor_status(agreed(spark, sf), 0.3).select("doc", "page", "status")


@query("cur_new_stubs", "SELECT doc_id AS page, md5(text || chr(10)) AS digest FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 1")
def new_stubs(spark, sf):
    here = docs(spark, sf).select(F.col("doc_id").alias("page"), "text")
    return C.new_stubs(here.where("page % 3 = 0"), here.where("page % 2 = 0")).select("page", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("cur_digit_lines", f"WITH {D.LINES} SELECT doc_id, ln, 0 AS x0, CAST(greatest(0, ln * 20 - 4) AS BIGINT) AS y0, CAST(least(900, length(text) * 9 + 4) AS BIGINT) AS x1, ln * 20 + 19 AS y1 FROM lines WHERE regexp_matches(text, '[0-9]') ORDER BY doc_id, ln LIMIT 150")
def digit_lines(spark, sf):
    rows = D.lines(spark, sf).select("doc_id", "ln", "text", F.lit(2).alias("x0"), (F.col("ln") * 20).alias("y0"), (F.length("text") * 9).cast("long").alias("x1"), (F.col("ln") * 20 + 15).alias("y1"))
    return C.digit_lines(rows, ["doc_id", "ln"], F.lit(900), F.lit(10**9)).select("doc_id", "ln", "x0", "y0", "x1", "y1")


@query("cur_book_split", "SELECT CASE WHEN source IN ('web', 'forum') THEN 'holdout' ELSE 'train' END AS part, count(*) AS pages, count(DISTINCT source) AS books FROM documents WHERE n_chars / 10000.0::DOUBLE >= 0.02 GROUP BY ALL")
def book_split(spark, sf):
    return C.split_summary(C.book_split(docs(spark, sf).select(F.col("source").alias("book"), (F.col("n_chars") / 10000).alias("ink")), ["web", "forum"]))


@query("cur_gate_pages", f"WITH {D.TOK} SELECT doc_id AS page, pos, greatest(0, x0 - 3) AS x0, greatest(0, y0 - 3) AS y0, x1 + 3 AS x1, y1 + 3 AS y1 FROM tok WHERE doc_id % 4 = 0 AND regexp_matches(text, '[0-9]')")
def gate_pages(spark, sf):
    here = docs(spark, sf).select(F.col("doc_id").alias("page"), "text")
    boxes = D.tok(spark, sf).where(T.has_digit(F.col("text"))).select(F.col("doc_id").alias("page"), "pos", "x0", "y0", "x1", "y1")
    reads = here.where("page % 4 = 0").select("page", D.second(F.col("text")).alias("reading"))
    return C.gate_pages(here.select("page"), reads, boxes).select("page", "pos", "x0", "y0", "x1", "y1")


@query("cur_without_flag", f"WITH {D.FLAGGED} SELECT doc_id, pos FROM flagged WHERE list_contains(flags, 'digit_uncertain')")
def without_flag(spark, sf):
    rows = tok(spark, sf).withColumn("flags", F.concat("flags", F.array(F.lit("unknown_word"), F.lit("unknown_word"))))
    return rows.withColumn("flags", C.without_flag(C.without_flag(F.col("flags")), "low_conf")).where(F.size("flags") > 0).select("doc_id", "pos")


@query("cur_entry_files", "SELECT page_id AS id, role, 'set/' || role || '/' || page_id AS path FROM pages, (VALUES ('clean'), ('gt'), ('image')) AS r(role) WHERE role <> 'gt' OR page_id % 2 = 0")
def entry_files(spark, sf):
    c = F.col("page_id").cast("string")
    at = lambda role: F.concat(F.lit(f"{role}\\"), c)
    rows = D.table(spark, sf, "pages").select(F.col("page_id").alias("id"), at("clean").alias("clean"), F.lit(None).cast("string").alias("degraded"), F.when(F.col("page_id") % 2 == 0, at("gt")).otherwise("").alias("gt"), at("image").alias("image"))
    return C.entry_files(rows, "set/")


@query("cur_manifest_header", "SELECT 'set ' || event_id AS name, 'cc' AS license, NULL::VARCHAR AS provenance, event_id AS n_entries, 2::BIGINT AS freeze_version FROM events")
def manifest_header(spark, sf):
    body = F.to_json(F.struct(F.concat(F.lit("set "), F.col("event_id").cast("string")).alias("name"), F.lit("cc").alias("license"), F.col("event_id").alias("n_entries"), F.lit(2).alias("freeze_version")))
    return C.manifest_header(D.table(spark, sf, "events").select(body.alias("content"))).drop("manifest_sha256")


@query("cur_profile_pages", "SELECT source AS doc, doc_id AS page FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE doc_id >= 7) WHERE k <= 5")
def profile_pages(spark, sf):
    return C.profile_pages(docs(spark, sf).select(F.col("source").alias("doc"), F.col("doc_id").alias("page")), 7, 5)
