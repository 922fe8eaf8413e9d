"""Queries of evaluation, reconciling, admission and the page pipeline."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quirefold.functions import images as IM
from quirefold.functions import text as T
from quirefold.operators import evaluation as E
from quirefold.operators import flags as FL
from quirefold.operators import memory as MEM
from quirefold.operators import metrics as M
from quirefold.operators import pages as P
from quirefold.operators import reconcile as RC
from quirefold.streaming import admission as A

from . import derived as D
from .review_queries import ANCHOR, agreed
from .state_queries import token_id
from .text_queries import HYP, NORM, PUNCT, SORTED, SORTED_HYP, edits_sql, sql_norm_tokens, sql_tokens
from .token_queries import READ, TWO, corrections, marked, ranked, read, tok, truth, two_flags

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def docs(spark, sf):
    return D.table(spark, sf, "documents")


def deva_lines(spark, sf):
    return D.lines(spark, sf).withColumn("text", D.deva(F.col("text")))


HAS_DEVA = "regexp_matches({}, '[\\x{{0900}}-\\x{{097F}}]')"
DEVA_TOKENS = f"""{D.LINES}, dv AS (SELECT lang, doc_id, ln, {sql_tokens(D.DEVA.format('text'))} AS l FROM lines),
dt AS (SELECT lang, doc_id, ln, i, l[i] AS w FROM dv, unnest(range(1, len(l) + 1)) AS r(i)), di AS (SELECT *, {HAS_DEVA.format('w')} AS own, {HAS_DEVA.format('w')} AND {D.invalid_sql('w', PUNCT)} AS bad FROM dt)"""


@query("txt_devanagari_lines", f"WITH {DEVA_TOKENS} SELECT lines.doc_id, lines.ln, count(w) AS tokens, count(*) FILTER (own) AS devanagari_tokens, count(*) FILTER (bad) AS invalid_tokens, coalesce(string_agg(w, '|' ORDER BY i) FILTER (bad), '') AS bad FROM lines LEFT JOIN di ON di.doc_id = lines.doc_id AND di.ln = lines.ln GROUP BY ALL")
def devanagari_lines(spark, sf):
    v = T.devanagari_validity(F.col("text"))
    bad = F.filter(T.tokens(F.col("text")), lambda t: t.rlike("[ऀ-ॿ]") & T.invalid_devanagari(t))
    return deva_lines(spark, sf).select("doc_id", "ln", v["tokens"].alias("tokens"), v["devanagari_tokens"].alias("devanagari_tokens"), v["invalid_tokens"].alias("invalid_tokens"), F.array_join(bad, "|").alias("bad"))


@query("agg_validity_report", f"""WITH {DEVA_TOKENS}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ln ORDER BY i) AS k FROM di WHERE bad), e AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY doc_id, ln, i) AS n FROM b WHERE k <= 5),
x AS (SELECT lang, string_agg(w, '|' ORDER BY n) AS examples FROM e WHERE n <= 20 GROUP BY lang),
s AS (SELECT lang, count(*) AS tokens, count(*) FILTER (own) AS devanagari_tokens, count(*) FILTER (bad) AS invalid_tokens, count(DISTINCT CASE WHEN bad THEN doc_id * 100000 + ln END) AS texts_with_invalid FROM di GROUP BY lang), t AS (SELECT lang, count(*) AS texts FROM lines GROUP BY lang)
SELECT lang, texts, texts_with_invalid, tokens, devanagari_tokens, invalid_tokens, invalid_tokens::DOUBLE / devanagari_tokens AS invalid_token_rate, examples FROM t JOIN s USING (lang) LEFT JOIN x USING (lang)""")
def validity_report(spark, sf):
    rows = deva_lines(spark, sf).withColumn("at", F.col("doc_id") * 100000 + F.col("ln"))
    return E.validity_report(rows, ["lang"], "at").withColumn("examples", F.array_join("examples", "|"))


@query("agg_valid_truth", f"""WITH g AS (SELECT doc_id, unnest({sql_tokens(D.DEVA.format('text'))}) AS w FROM documents), gi AS (SELECT doc_id, lower(trim(w, '{PUNCT}')) AS t, {D.invalid_sql('w', PUNCT)} AS bad FROM g WHERE trim(w, '{PUNCT}') <> ''),
h AS (SELECT doc_id, unnest({sql_norm_tokens(D.DEVA.format(D.THIRD.format('text')))}) AS t FROM documents), e AS (SELECT doc_id, t, count(*) FILTER (s = 0) AS v, count(*) FILTER (s = 1) AS i, count(*) FILTER (s = 2) AS h FROM (SELECT doc_id, t, CASE WHEN bad THEN 1 ELSE 0 END AS s FROM gi UNION ALL SELECT doc_id, t, 2 FROM h) GROUP BY ALL),
z AS (SELECT doc_id, CAST(sum(v) AS BIGINT) AS gt_valid_tokens, CAST(sum(i) AS BIGINT) AS gt_invalid_tokens, CAST(sum(h) AS BIGINT) AS hyp_tokens, CAST(sum(CASE WHEN h > 0 THEN v ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN v + i = 0 THEN h ELSE 0 END) AS BIGINT) AS unmatched_tokens FROM e GROUP BY doc_id)
SELECT *, CASE WHEN gt_valid_tokens = 0 THEN 0.0::DOUBLE ELSE matched::DOUBLE / gt_valid_tokens END AS valid_recall, CASE WHEN hyp_tokens = 0 THEN 0.0::DOUBLE ELSE unmatched_tokens::DOUBLE / hyp_tokens END AS unmatched_rate FROM z""")
def valid_truth(spark, sf):
    pairs = D.pages(spark, sf).where("text is not null").select("doc_id", D.deva(F.col("text")).alias("gt"), D.deva(D.third(F.col("text"))).alias("hyp"))
    return E.valid_truth_stats(pairs, ["doc_id"]).where("gt_valid_tokens + gt_invalid_tokens + hyp_tokens > 0")


DIGIT = r"[0-9](?:[0-9.,:/-]*[0-9])?"
DS = f"coalesce(array_to_string(regexp_extract_all({{}}, '{DIGIT}'), ' '), '')"
PART = "list_sort(list_distinct(list_filter(string_split({}, ''), lambda c: regexp_matches(c, '[{}]'))))"
MATRA, CONSONANT = "\\x{093E}-\\x{094D}\\x{0962}\\x{0963}", "\\x{0915}-\\x{0939}"


@query("txt_token_error_kind", f"""WITH {D.TOK}, p AS (SELECT doc_id, pos, {D.DEVA.format('text')} AS g, translate({D.DEVA.format(D.THIRD.format('text'))}, 'क', 'ग') AS h FROM tok)
SELECT doc_id, pos, CASE WHEN {DS.format('g')} <> {DS.format('h')} THEN 'digit' WHEN list_sort(string_split(g, '')) = list_sort(string_split(h, '')) THEN 'order' WHEN len(list_intersect(string_split(g, ''), string_split(h, ''))) = 0 THEN 'unrelated'
  WHEN {PART.format('g', MATRA)} <> {PART.format('h', MATRA)} THEN 'matra' WHEN {PART.format('g', CONSONANT)} <> {PART.format('h', CONSONANT)} THEN 'consonant' ELSE 'other' END AS kind FROM p WHERE g <> h""")
def token_error_kind(spark, sf):
    pairs = D.tok(spark, sf, by_page=False).select("doc_id", "pos", D.deva(F.col("text")).alias("g"), F.translate(D.deva(D.third(F.col("text"))), "क", "ग").alias("h"))
    return pairs.where("g <> h").select("doc_id", "pos", T.token_error_kind(F.col("g"), F.col("h")).alias("kind"))


@query("join_token_diff")
def token_diff(spark, sf):
    pairs = docs(spark, sf).select("doc_id", F.col("text").alias("gt"), D.third(F.regexp_replace("text", " a ", " ")).alias("hyp"))
    return E.diff_kinds(E.token_diff(pairs, ["doc_id"]), ["doc_id"])


DERR = f"""{D.FLAGGED}, gd AS (SELECT DISTINCT doc_id, {DS.format('text')} AS ds, TRUE AS hit FROM tok WHERE regexp_matches(text, '[0-9]')),
rd AS (SELECT f.* REPLACE ({D.SECOND.format('text')} AS text) FROM flagged f), rds AS (SELECT *, CASE WHEN regexp_matches(text, '[0-9]') THEN {DS.format('text')} END AS ds FROM rd),
de AS (SELECT r.*, coalesce(ds <> '' AND hit IS NULL, FALSE) AS digit_error, CASE WHEN len(flags) > 0 THEN row_number() OVER (PARTITION BY doc_id, len(flags) > 0 ORDER BY risk DESC, y0, x0, pos) END AS rn FROM rds r LEFT JOIN gd USING (doc_id, ds)),
dq AS (SELECT doc_id, count(*) FILTER (digit_error) AS digit_errors, count(*) FILTER (digit_error AND rn <= 5) AS hits_5, count(*) FILTER (rn <= 5) AS top_5, count(*) FILTER (digit_error AND rn <= 10) AS hits_10, count(*) FILTER (rn <= 10) AS top_10 FROM de GROUP BY doc_id)"""
DSUM = "SELECT count(*) AS pages, CAST(sum(digit_errors) AS BIGINT) AS digit_errors, sum(hits_5)::DOUBLE / nullif(sum(digit_errors), 0) AS digit_recall_5, sum(hits_5)::DOUBLE / nullif(sum(top_5), 0) AS digit_precision_5, sum(hits_10)::DOUBLE / nullif(sum(digit_errors), 0) AS digit_recall_10, sum(hits_10)::DOUBLE / nullif(sum(top_10), 0) AS digit_precision_10 FROM dq"


def digit_ranked(spark, sf):
    from pyspark.sql import Window

    rows = read(spark, sf).withColumn("risk", FL.risk(F.col("flags")))
    held = F.size("flags") > 0
    rows = rows.withColumn("rn", F.when(held, F.row_number().over(Window.partitionBy("doc_id", held).orderBy(F.desc("risk"), "y0", "x0", "pos"))))
    return E.digit_errors(rows, D.pages(spark, sf).select("doc_id", "text"))


@query("agg_digit_summary_pages_with_errors", f"WITH {DERR} {DSUM} WHERE digit_errors > 0")
def digit_summary(spark, sf):
    return E.digit_summary(E.digit_queue(digit_ranked(spark, sf)), [])


@query("agg_digit_summary_all_pages", f"WITH {DERR} {DSUM}")
def digit_summary_all(spark, sf):
    return E.digit_summary(E.digit_queue(digit_ranked(spark, sf)), [], only_with_errors=False)


@query("agg_arm_measures", f"""WITH {DERR} SELECT lang, count(DISTINCT doc_id) AS pages, count(*) FILTER (digit_error) AS digit_errors, count(rn) AS queue, count(*) FILTER (list_contains(flags, 'low_conf')) AS flagged, count(*) FILTER (list_contains(flags, 'low_conf') AND ds IS NOT NULL) AS flagged_digits,
  count(*) FILTER (list_contains(flags, 'low_conf') AND digit_error) AS true_flagged, count(*) FILTER (list_contains(flags, 'low_conf') AND digit_error)::DOUBLE / nullif(count(*) FILTER (list_contains(flags, 'low_conf') AND ds IS NOT NULL), 0) AS flag_precision, count(*) FILTER (digit_error AND rn <= 10)::DOUBLE / nullif(count(*) FILTER (digit_error), 0) AS digit_recall_10 FROM de GROUP BY lang""")
def arm_measures(spark, sf):
    out = E.arm_measures(digit_ranked(spark, sf), "low_conf", ["lang"])
    return out.select("lang", "pages", "digit_errors", "queue", "flagged", "flagged_digits", "true_flagged", "flag_precision", "digit_recall_10")


SHARES, WEIGHTS = [0.5, 1.0], [0.25, 1.25]


@query("agg_lexicon_sweep", f"""WITH {DERR}, wd AS (SELECT *, lower(trim(text, '{PUNCT}')) AS t, length(text) % 4 AS words, (doc_id + pos) % 5 % (length(text) % 4 + 1) AS oov FROM de), truth AS (SELECT DISTINCT doc_id, lower(trim(text, '{PUNCT}')) AS t, TRUE AS known FROM tok),
wr AS (SELECT wd.*, t <> '' AND known IS NULL AS wrong FROM wd LEFT JOIN truth USING (doc_id, t)), g AS (SELECT wr.*, s AS share, w AS weight, oov > 0 AND oov >= s * words AS unknown FROM wr, (SELECT unnest({SHARES}::DOUBLE[]) AS s), (SELECT unnest({WEIGHTS}::DOUBLE[]) AS w)),
h AS (SELECT * REPLACE (risk + CASE WHEN unknown THEN weight ELSE 0 END AS risk), unknown OR len(flags) > 0 AS held FROM g),
q AS (SELECT *, CASE WHEN held THEN row_number() OVER (PARTITION BY share, weight, doc_id, held ORDER BY risk DESC, y0, x0, pos) END AS n FROM h)
SELECT share, weight, count(*) AS tokens, count(*) FILTER (unknown) AS unknown_word_tokens, count(*) FILTER (held) AS flagged_tokens, count(*) FILTER (wrong AND n <= 10) AS token_hits, count(*) FILTER (digit_error AND n <= 10) AS digit_hits, count(*) FILTER (wrong AND n <= 10)::DOUBLE / nullif(count(*) FILTER (wrong), 0) AS token_recall, count(*) FILTER (digit_error AND n <= 10)::DOUBLE / nullif(count(*) FILTER (n <= 10), 0) AS digit_precision FROM q GROUP BY ALL""")
def lexicon_sweep(spark, sf):
    rows = M.marked(digit_ranked(spark, sf).drop("risk", "rn"), truth(spark, sf)).withColumn("wrong", (F.col("t") != "") & ~F.col("ok"))
    rows = rows.withColumn("words", F.length("text") % 4).withColumn("oov", (F.col("doc_id") + F.col("pos")) % 5 % (F.col("words") + 1))
    return E.lexicon_sweep(rows, SHARES, WEIGHTS).select("share", "weight", "tokens", "unknown_word_tokens", "flagged_tokens", "token_hits", "digit_hits", "token_recall", "digit_precision")


PAIRS = f"""{D.LINES}, e AS (SELECT lang, source, doc_id, ln, text, {NORM} AS g, {HYP} AS h, {DS.format('text')} AS gd, {DS.format(D.SECOND.format('text'))} AS hd FROM lines),
c AS (SELECT *, CASE WHEN g = '' THEN 0.0::DOUBLE ELSE {edits_sql('g', 'h')}::DOUBLE / length(g) END AS cer FROM e)"""


def line_pairs(spark, sf):
    return D.lines(spark, sf).select("lang", "source", "doc_id", "ln", F.col("text").alias("gt"), D.second(F.col("text")).alias("hyp"))


@query("agg_line_scores", f"WITH {PAIRS} SELECT lang, count(*) AS lines, avg(cer) AS cer, median(cer) AS cer_median, avg(CASE WHEN cer >= 1 THEN 1.0::DOUBLE ELSE 0 END) AS catastrophic_rate, avg(CASE WHEN cer = 0 THEN 1.0::DOUBLE ELSE 0 END) AS exact_match, count(*) FILTER (gd <> '') AS digit_lines, avg(CASE WHEN gd = hd THEN 1.0::DOUBLE ELSE 0 END) FILTER (gd <> '') AS digit_exact_rate, count(*) FILTER (h = '') AS empty_outputs FROM c GROUP BY lang")
def line_scores(spark, sf):
    return E.line_scores(line_pairs(spark, sf), ["lang"])


@query("agg_gate_lines", f"WITH {PAIRS}, b AS (SELECT *, CASE WHEN coalesce({SORTED}, '') = '' THEN 0.0::DOUBLE ELSE {edits_sql(SORTED, SORTED_HYP)}::DOUBLE / length({SORTED}) END AS bag FROM c WHERE g <> '') SELECT source, count(*) AS lines, count(*) FILTER (gd <> '') AS digit_lines, avg(CASE WHEN gd = hd THEN 1.0::DOUBLE ELSE 0 END) FILTER (gd <> '') AS digit_exact, avg(cer) AS cer, avg(bag) AS bagcer FROM b GROUP BY source")
def gate_lines(spark, sf):
    return E.gate_lines(line_pairs(spark, sf), ["source"])


@query("agg_line_summary", f"WITH {PAIRS} SELECT source, count(*) AS lines, avg(cer) AS cer, median(cer) AS cer_median, avg(CASE WHEN cer = 0 THEN 1.0::DOUBLE ELSE 0 END) AS exact_match, count(*) FILTER (gd <> '') AS digit_lines, avg((ln % 7) / 10.0::DOUBLE) AS seconds_per_line, count(*) FILTER (h = '') AS empty_outputs FROM c GROUP BY source")
def line_summary(spark, sf):
    return E.line_summary(line_pairs(spark, sf).withColumn("seconds", F.col("ln") % 7 / 10), ["source"]).drop("digit_cer")


@query("join_arms", "SELECT * FROM (VALUES ('raw', 'a'), ('raw', 'b'), ('restore', 'a'), ('restore', 'b')) AS v(method, backend)")
def arms(spark, sf):
    return D.literals(spark, E.arms(["raw", "restore", "photo"], ["a", "b"]), "method string, backend string")


@query("join_peer_inventions", f"""WITH r AS (SELECT doc_id, b AS backend, m AS method, CASE m WHEN 'raw' THEN text WHEN 'second' THEN {D.SECOND.format('text')} ELSE {D.THIRD.format('text')} END AS text FROM documents, (VALUES ('x'), ('y')) AS p(b), (VALUES ('raw'), ('second'), ('third')) AS q(m) WHERE b = 'x' OR m <> 'second'),
e AS (SELECT doc_id, backend, method, unnest({sql_tokens('text')}) AS w FROM r), n AS (SELECT *, lower(trim(w, '{PUNCT}')) AS t FROM e), k AS (SELECT doc_id, backend, t, count(DISTINCT method) AS methods FROM n GROUP BY ALL), g AS (SELECT DISTINCT doc_id, lower(trim(unnest({sql_tokens('text')}), '{PUNCT}')) AS t FROM documents WHERE doc_id % 2 = 0),
o AS (SELECT n.*, methods = 1 AND g.doc_id IS NULL AS odd FROM n JOIN k USING (doc_id, backend, t) LEFT JOIN g ON g.doc_id = n.doc_id AND g.t = n.t)
SELECT backend, method, count(*) AS tokens, count(*) FILTER (odd) AS invented, count(*) FILTER (odd AND regexp_matches(w, '[0-9]')) AS invented_digits, count(*) FILTER (odd)::DOUBLE / count(*) AS invented_rate FROM o GROUP BY ALL""")
def peer_inventions(spark, sf):
    rows = D.pages(spark, sf).select("doc_id", "text")
    every = [F.struct(F.lit(b).alias("backend"), F.lit(m).alias("method"), t.alias("text")) for b in "xy" for m, t in (("raw", F.col("text")), ("second", D.second(F.col("text"))), ("third", D.third(F.col("text")))) if b == "x" or m != "second"]
    return E.peer_inventions(rows.select("doc_id", F.inline(F.array(*every))), M.truth_tokens(rows.where("doc_id % 2 = 0"), "doc_id", "text"))


@query("agg_arm_summary", "SELECT event_type, count(*) AS pages, avg(value) AS cer, median(value) AS cer_median, CAST(sum(event_id % 50) AS BIGINT) AS tokens, CAST(sum(event_id % 7) AS BIGINT) AS errors, sum(event_id % 3)::DOUBLE / nullif(sum(event_id % 7), 0) AS coverage, sum(event_id % 2)::DOUBLE / nullif(sum(event_id % 4), 0) AS digit_coverage, (sum(event_id % 5) - sum(event_id % 2))::DOUBLE / nullif(sum(event_id % 5), 0) AS digit_false_alarm_rate, avg((event_id % 9)::DOUBLE) AS seconds FROM events GROUP BY event_type")
def arm_summary(spark, sf):
    c = F.col("event_id")
    rows = D.table(spark, sf, "events").select("event_type", F.col("value").alias("cer"), (c % 50).alias("tokens"), (c % 7).alias("errors"), (c % 3).alias("flagged_errors"), (c % 4).alias("digit_errors"), (c % 5).alias("digit_flagged"), (c % 2).alias("digit_flagged_errors"), (c % 9).alias("seconds"))
    return E.arm_summary(rows, ["event_type"])


@query("agg_angle_histogram", "SELECT coalesce(a::VARCHAR, 'None') AS angle, count(*) AS pages FROM (SELECT CASE event_id % 5 WHEN 0 THEN 90 WHEN 1 THEN 180 WHEN 2 THEN 0 END AS a FROM events) GROUP BY ALL")
def angle_histogram(spark, sf):
    c = F.col("event_id") % 5
    return E.angle_histogram(D.table(spark, sf, "events").select(F.when(c == 0, 90).when(c == 1, 180).when(c == 2, 0).alias("angle")))


@query("agg_audit_rates", f"WITH {D.FLAGGED}, p AS (SELECT source, doc_id, doc_id % 4 = 0 AS suspect, doc_id % 3 = 0 AS changed, count(*) FILTER (len(flags) > 0) AS flagged, count(*) AS tokens, (doc_id % 9)::DOUBLE AS seconds FROM flagged GROUP BY ALL) SELECT source, count(*) AS pages, avg(CASE WHEN suspect THEN 1.0::DOUBLE ELSE 0 END) AS suspect_rate, avg(CASE WHEN changed THEN 0.0::DOUBLE ELSE 1 END) AS identity_rate, avg(CASE WHEN flagged > 0 THEN 1.0::DOUBLE ELSE 0 END) AS flagged_rate, median(tokens) AS tokens_median, median(seconds) AS seconds_median FROM p GROUP BY source")
def audit_rates(spark, sf):
    p = tok(spark, sf).groupBy("source", "doc_id").agg(F.count(F.when(F.size("flags") > 0, 1)).alias("flagged"), F.count("*").alias("tokens"))
    return E.audit_rates(p.withColumns({"suspect": F.col("doc_id") % 4 == 0, "changed": F.col("doc_id") % 3 == 0, "seconds": (F.col("doc_id") % 9).cast("double")}), ["source"])


@query("agg_router_summary", """WITH r AS (SELECT event_type, value AS cer_plain, value * (1 + (event_id % 4) / 100.0::DOUBLE) AS cer_routed, 30.0::DOUBLE + event_id % 3 AS psnr_routed, 31.0::DOUBLE AS psnr_naive, event_id % 2 AS invented, 0.2::DOUBLE * (event_id % 6) AS s FROM events WHERE event_id % 97 <> 1),
g AS (SELECT *, cer_routed <= cer_plain * 1.02::DOUBLE + 1e-9 AS text, psnr_routed + 1e-9 >= psnr_naive AS non_text, invented = 0 AS invented_ok, s <= 1.0 AS cost FROM r)
SELECT event_type, count(*) AS pages, avg(cer_plain) AS cer_plain, avg(cer_routed) AS cer_routed, avg(psnr_naive) AS psnr_naive, CAST(sum(invented) AS BIGINT) AS invented, bool_and(text) AS text, bool_and(non_text) AS non_text, bool_and(invented_ok) AS invented_ok, bool_and(cost) AS cost, bool_and(text) AND bool_and(non_text) AND bool_and(invented_ok) AND bool_and(cost) AS pass FROM g GROUP BY event_type""")
def router_summary(spark, sf):
    c = F.col("event_id")
    rows = D.table(spark, sf, "events").where("event_id % 97 <> 1").withColumns({"cer_plain": F.col("value"), "cer_routed": F.col("value") * (1 + c % 4 / 100), "psnr_routed": 30.0 + c % 3, "psnr_naive": F.lit(31.0), "invented": c % 2, "s": 0.2 * (c % 6)})
    gates = E.router_gates(*(F.col(x) for x in ("cer_plain", "cer_routed", "psnr_routed", "psnr_naive", "invented", "s")))
    return E.router_summary(rows.withColumns(gates), ["event_type"])


@query("agg_anchor_summary", f"""WITH {ANCHOR}, v AS (SELECT a.page, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS g, {D.SECOND.format('text')} AS h, a.page IN (SELECT page FROM w) AS worksheet FROM a JOIN documents d ON d.doc_id = a.page WHERE a.page % 2 = 0),
c AS (SELECT page, worksheet, CASE WHEN worksheet THEN CASE WHEN g = '' THEN 0.0::DOUBLE ELSE {edits_sql('g', "trim(regexp_replace(h, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))")}::DOUBLE / length(g) END END AS cer FROM v)
SELECT (SELECT count(*) FROM c WHERE worksheet) AS verified_pages, (SELECT avg(cer) FROM c) AS cer, count(*) AS consensus_pages, avg(agreement_rate) AS consensus_mean_agreement FROM a WHERE agreement_rate >= 0.3""")
def anchor_summary(spark, sf):
    from quirefold.operators import curation as C

    rows = C.anchor_status(agreed(spark, sf), 0.3)
    text = docs(spark, sf).select(F.col("doc_id").alias("page"), F.col("text").alias("gt"))
    reads = rows.join(text, "page").select("page", (F.col("status") == "worksheet").alias("worksheet"), D.second(F.col("gt")).alias("hyp"), "agreement_rate")
    scores = E.anchor_scores(text.where("page % 2 = 0"), reads.drop("agreement_rate"))
    return E.anchor_summary(scores, reads, 0.3).select("verified_pages", "cer", "consensus_pages", "consensus_mean_agreement")


@query("agg_orientation_votes", "SELECT user_id, avg(CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS turned, avg(CASE WHEN event_id % 3 = 0 AND value % 1 >= 0.9 THEN 1.0::DOUBLE ELSE 0 END) AS surely, count(*) AS votes FROM events GROUP BY user_id")
def orientation_votes(spark, sf):
    lines = D.table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, "180").otherwise("0").alias("label"), (F.col("value") % 1).alias("score"))
    return E.orientation_votes(lines, "user_id")


@query("agg_policy_measures", "SELECT event_type, count(*) AS pages, avg(value) AS cer, avg(value / 2) AS cer_bag, avg(CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS digit_exact_pages, CAST(sum(event_id % 4) AS BIGINT) AS flagged, CAST(sum(event_id % 6) AS BIGINT) AS invented, CAST(sum(event_id % 5) AS BIGINT) AS digit_inventions, CAST(sum(event_id % 5 % 2) AS BIGINT) AS digit_inventions_flagged, CAST(sum(event_id % 5) - sum(event_id % 5 % 2) AS BIGINT) AS silent_inventions FROM events GROUP BY event_type")
def policy_measures(spark, sf):
    c = F.col("event_id")
    rows = D.table(spark, sf, "events").select("event_type", F.col("value").alias("cer"), (F.col("value") / 2).alias("cer_bag"), (c % 2 == 0).alias("digit_exact"), (c % 4).alias("flagged"), (c % 6).alias("invented"), (c % 5).alias("digit_inventions"), (c % 5 % 2).alias("digit_inventions_flagged"))
    return E.policy_measures(rows, ["event_type"])


def value_suggestions(queue, log):
    """Values confirmed before, for the digits of a reading."""
    digits = lambda c: T.memory_digits(F.col(c))
    learned = log.withColumns({"value": digits("original"), "corrected": digits("corrected")}).where(F.length("value") >= MEM.VALUE_DIGITS)
    index = MEM.fold(learned, ["value"], "value", "corrected").withColumnRenamed("text", "corrected")
    return MEM.suggest_values(queue.select("id", digits("text").alias("digits")), index)


def line_suggestions(queue, log):
    learned = log.withColumns({"key": F.lit("all"), "digits": T.memory_digits(F.col("original"))})
    index = MEM.fold(learned.withColumn("kind", F.lit("line")), ["key", "digits"], "line", "corrected").where("digits <> ''")
    return MEM.suggest_lines(queue.withColumn("key", F.lit("all")).select("id", "key", "text"), index)


def replayed(spark, sf):
    rows = corrections(spark, sf).where(T.has_digit(F.col("original")))
    queue = rows.select((F.col("doc_id") % 4).alias("session"), (F.col("doc_id") * 100000 + F.col("seq")).alias("id"), F.col("original").alias("text"), F.col("corrected").alias("target"))
    log = rows.select((F.col("doc_id") % 4).alias("session"), (F.col("doc_id") * 100000 + F.col("seq")).alias("seq"), "original", "corrected", F.lit("value").alias("kind"))
    return queue, MEM.replay(queue, log, [0, 1, 2, 3], {"line": line_suggestions, "value": value_suggestions})


@query("agg_replay_summary")
def replay_summary(spark, sf):
    queue, suggestions = replayed(spark, sf)
    return MEM.replay_summary(queue, suggestions)


@query("join_review_chips")
def review_chips(spark, sf):
    queue, suggestions = replayed(spark, sf)
    return MEM.chips(queue, suggestions).select("id", F.array_join("chips", "|").alias("chips"))


@query("clu_candidates", f"""WITH {D.TOK}, r AS (SELECT doc_id, pos, text, [{D.SECOND.format('text')}, text || ' ', {D.THIRD.format('text')}, {D.SECOND.format('text')} || '!', NULL, text || '7'] AS l FROM tok WHERE regexp_matches(text, '[0-9]')),
e AS (SELECT doc_id, pos, i, l[i] AS c, regexp_replace(l[i], '[^0-9]', '', 'g') AS d FROM r, unnest(range(1, 7)) AS u(i) WHERE l[i] IS NOT NULL AND regexp_replace(l[i], '[^0-9]', '', 'g') NOT IN ('', regexp_replace(text, '[^0-9]', '', 'g'))), f AS (SELECT doc_id, pos, d, min(i) AS i, arg_min(trim(c), i) AS c FROM e GROUP BY ALL)
SELECT doc_id, pos, string_agg(c, '|' ORDER BY i) AS candidates FROM f GROUP BY ALL""")
def candidates(spark, sf):
    t = F.col("text")
    more = F.array(F.concat(t, F.lit(" ")), D.third(t), F.concat(D.second(t), F.lit("!")), F.lit(None).cast("string"), F.concat(t, F.lit("7")))
    rows = D.tok(spark, sf).where(T.has_digit(t)).withColumn("c", RC.candidates(t, F.array(D.second(t)), more))
    return rows.where(F.size("c") > 0).select("doc_id", "pos", F.array_join("c", "|").alias("candidates"))


@query("clu_reconciled", "SELECT doc_id, 9 + doc_id % 3 AS pos, CASE doc_id % 2 WHEN 0 THEN '2075-03-1' || doc_id % 3 ELSE '12-5' || doc_id % 3 END AS suggestion, CASE doc_id % 2 WHEN 0 THEN 'date' ELSE 'prefix' END AS why, TRUE AS flagged FROM documents")
def reconciled(spark, sf):
    """Pages with a column of twelve dates (or numbers with a common first group), one of which is misread; a second reading
    of that one, and none of the others, has what the column has."""
    c, k = F.col("doc_id"), F.col("pos")
    rows = D.pages(spark, sf).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))
    odd, day = k == 9 + c % 3, (k % 3 + 10).cast("string")
    tail = F.when(odd, F.concat(F.lit("1"), (c % 3).cast("string"))).otherwise(day)
    date = lambda y: F.concat(F.lit(f"{y}-03-"), tail)
    number = lambda p: F.concat(F.lit(f"{p}-5"), F.when(odd, (c % 3).cast("string")).otherwise((k % 10).cast("string")))
    text = F.when(c % 2 == 0, F.when(odd, date(2015)).otherwise(date(2075))).otherwise(F.when(odd, number(17)).otherwise(number(12)))
    other = F.when(c % 2 == 0, date(2075)).otherwise(number(12))
    box = {"x0": F.lit(10) + k % 2, "y0": k * 40, "x1": F.lit(110)}
    rows = rows.withColumns({"text": text, **box})
    found = RC.reconciled(rows.withColumn("candidates", RC.candidates(F.col("text"), F.array(F.lit("9999"), F.when(odd, other)))))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "suggestion", "why", "flagged")


@query("str_admission")
def admission(spark, sf):
    rows = D.table(spark, sf, "events").select((F.col("user_id") % 8).alias("site"), "event_id", F.col("user_id").alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (1 + F.col("event_id") % 4).alias("pages"), F.lit(7200.0).alias("seconds"))
    return A.admission(rows, 3600.0, 1, 5, 40, 12, 2)


@query("str_tracked_keys", "SELECT key, epoch_us(last) / 1e6 AS last FROM (SELECT user_id AS key, max(ts) AS last FROM events WHERE epoch_us(ts) / 1e6 <= 1705000000::DOUBLE GROUP BY user_id) WHERE 1705000000::DOUBLE - epoch_us(last) / 1e6 <= 864000 ORDER BY last DESC, key DESC LIMIT 20")
def tracked_keys(spark, sf):
    rows = D.table(spark, sf, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return A.tracked_keys(rows, 1705000000.0, 864000.0, 20)


@query("str_pending", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id LIMIT 50")
def pending(spark, sf):
    rows = docs(spark, sf).select("doc_id")
    return A.pending(rows, rows.where("doc_id % 3 = 0"), "doc_id", 50)


def drawn(spark, sf):
    """An image for each page of the table: page_id % 4 + 1 inked bars, 5 + 10 i wide."""
    @F.pandas_udf("binary")
    def draw(page: pd.Series) -> pd.Series:
        def one(k):
            image, x = np.full((60, 200), 255, np.uint8), 10
            for i in range(k % 4 + 1):
                image[20:40, x : x + 5 + 10 * i] = 0
                x += 15 + 10 * i
            return IM.encode_png(image if k % 2 else np.stack([image] * 3, axis=2))

        return page.map(one)

    return D.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 9 == 0, F.lit(b"no image")).otherwise(draw("page_id")).alias("content"))


BARS = "SELECT page_id, i AS pos, CAST(5 + 10 * i AS VARCHAR) AS text, 10 + 15 * i + 5 * i * (i - 1) AS x0, 10 + 15 * i + 5 * i * (i - 1) + 5 + 10 * i AS x1, 20 AS y0, 40 AS y1 FROM pages, unnest(range(0, page_id % 4 + 1)) AS r(i) WHERE page_id % 9 <> 0"


@query("pip_document_pages", f"SELECT *, '' AS flags, pos AS read_pos FROM ({BARS})")
def document_pages(spark, sf):
    rows = P.document_pages(drawn(spark, sf), "ink", "page_id", lang="ne")
    return rows.select("page_id", "pos", "text", "x0", "x1", "y0", "y1", F.array_join("flags", "|").alias("flags"), "read_pos")


@query("pip_run_report", "SELECT CASE WHEN page_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS n, CAST(sum(CASE WHEN page_id % 9 = 0 THEN 0 ELSE page_id % 4 + 1 END) AS BIGINT) AS tokens FROM pages GROUP BY ALL")
def run_report(spark, sf):
    read_ = P.scanned(drawn(spark, sf), "ink")
    pages = read_.groupBy("page_id").agg(F.max("error").alias("error"))
    tokens = read_.where("pos is not null").withColumn("flags", F.array().cast("array<string>"))
    return P.run_report(pages, tokens, "page_id").groupBy("status").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("pip_line_reader", f"""WITH {D.TOK}, g AS (SELECT doc_id, y0 // 40 AS line, string_agg(text, ' ' ORDER BY pos) AS engine, min(conf) AS conf FROM tok GROUP BY ALL), r AS (SELECT *, CASE WHEN line % 3 <> 1 THEN left(engine, 20) || CASE WHEN line % 3 = 0 THEN '7' ELSE '' END END AS read FROM g)
SELECT doc_id, line, coalesce(trim(read), engine) AS text, conf, CASE WHEN read IS NULL THEN 'backend' ELSE 'reader' END AS text_source, CASE WHEN NOT regexp_matches(engine, '[0-9]') AND regexp_matches(read, '[0-9]') THEN 'digit_added' ELSE '' END AS flags FROM r""")
def line_reader(spark, sf):
    item = F.array_sort(F.collect_list(F.struct("pos", "text", "conf")))
    groups = D.tok(spark, sf).groupBy("doc_id", F.floor(F.col("y0") / 40).alias("line")).agg(F.transform(item, lambda t: t["text"]).alias("texts"), F.transform(item, lambda t: t["conf"]).alias("confs"))
    joined = F.array_join("texts", " ")
    reads = groups.where("line % 3 <> 1").select("doc_id", "line", F.concat(F.substring(joined, 1, 20), F.when(F.col("line") % 3 == 0, "7").otherwise("")).alias("read"))
    return P.line_reader(groups, reads).select("doc_id", "line", "text", "conf", "text_source", F.array_join("flags", "|").alias("flags"))


@query("img_fitted_size", "SELECT event_id, CAST(greatest(1, floor(w * f)) AS INT) AS width, CAST(greatest(1, floor(h * f)) AS INT) AS height, f AS factor FROM (SELECT *, CASE WHEN greatest(w, h) > 2500 THEN 2500.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS f FROM (SELECT event_id, 100 + event_id * 37 % 5000 AS w, 100 + event_id * 91 % 4000 AS h FROM events))")
def fitted_size(spark, sf):
    c = F.col("event_id")
    rows = D.table(spark, sf, "events").select("event_id", (100 + c * 37 % 5000).alias("w"), (100 + c * 91 % 4000).alias("h"))
    return rows.select("event_id", IM.fitted_size(F.col("w"), F.col("h")).alias("s")).select("event_id", "s.*")


@query("img_skew_and_paper", "SELECT page_id, 0.0::DOUBLE AS skew, FALSE AS old FROM pages WHERE page_id % 9 <> 0")
def skew_and_paper(spark, sf):
    rows = drawn(spark, sf).select("page_id", IM.per_image(IM.skew, "double")("content").alias("skew"), IM.per_image(IM.looks_printed_long_ago, "boolean")("content").alias("old"))
    return rows.where("skew is not null")
