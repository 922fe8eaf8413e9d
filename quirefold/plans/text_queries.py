"""Queries of the text functions, over all lines of the documents or over fixed literals."""
from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import udfs as U

from . import derived as D

QUERIES: dict = {}
ORACLES: dict = {}
W = r"[ \t\n\r\f\v]+"
NORM = "trim(regexp_replace(text, '{w}', ' ', 'g'))".replace("{w}", W)
HYP = "trim(regexp_replace(translate(text, 'aeot130', 'eoat310'), '{w}', ' ', 'g'))".replace("{w}", W)
PUNCT = T.PUNCT.replace("'", "''")
#: one-byte stand-ins for the letters beyond ASCII, as DuckDB's levenshtein counts bytes
BEYOND = "ÍéèíçÇÑÈÉßäÜêñÊÄóÓöüÖ"
STAND_IN = "".join(chr(i) for i in (*range(1, 9), *range(14, 27)))


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{W}'), lambda t: t <> '')"


def sql_norm_tokens(x: str) -> str:
    return f"list_filter(list_transform({sql_tokens(x)}, lambda t: lower(trim(t, '{PUNCT}'))), lambda t: t <> '')"


def ascii_sql(x: str) -> str:
    return f"translate({x}, '{BEYOND}', '{STAND_IN}')"


def edits_sql(a: str, b: str) -> str:
    return f"levenshtein({ascii_sql(a)}, {ascii_sql(b)})"


def on_lines(name: str, column, sql: str) -> None:
    """A function of each line's text."""
    QUERIES[name] = lambda spark, sf: D.lines(spark, sf).select("doc_id", "ln", column(F.col("text")).alias("out"))
    ORACLES[name] = f"WITH {D.LINES} SELECT doc_id, ln, {sql} AS out FROM lines"


def on_literals(name: str, rows: list[tuple], schema: str, columns, sql: dict) -> None:
    """Functions of fixed rows; both sides read the same ones."""
    names = ", ".join(part.split()[0] for part in schema.split(","))
    QUERIES[name] = lambda spark, sf: D.literals(spark, rows, schema).select(*names.split(", "), *(c.alias(k) for k, c in columns().items()))
    if sql:
        ORACLES[name] = f"SELECT {names}, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM {D.values(rows, names)}"


on_lines("txt_normalize_lines", T.normalize_lines, "trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{2,}', chr(10), 'g'), ' ' || chr(10))")
on_lines("txt_normalize", T.normalize, NORM)
on_lines("txt_tokens", lambda t: F.array_join(T.tokens(t), "|"), f"coalesce(array_to_string({sql_tokens('text')}, '|'), '')")
on_lines("txt_norm_tokens", lambda t: F.array_join(T.norm_tokens(t), "|"), f"coalesce(array_to_string({sql_norm_tokens('text')}, '|'), '')")
on_lines("txt_digit_tokens", lambda t: F.array_join(T.digit_tokens(t), "|"), f"coalesce(array_to_string(list_filter({sql_tokens('text')}, lambda t: regexp_matches(t, '[0-9]')), '|'), '')")
on_lines("txt_digit_string", T.digit_string, "coalesce(array_to_string(regexp_extract_all(text, '[0-9](?:[0-9.,:/-]*[0-9])?'), ' '), '')")
on_lines("txt_digits_only", T.digits_only, "coalesce(array_to_string(regexp_extract_all(text, '[0-9]+'), ''), '')")
on_lines("txt_digits_devanagari", T.digits_devanagari, f"translate(coalesce(array_to_string(regexp_extract_all(text, '[0-9]+'), ''), ''), '0123456789', '{T.DEVA_DIGITS}')")
on_lines("txt_has_digit", T.has_digit, "regexp_matches(text, '[0-9]')")
on_lines("txt_digit_ratio", T.digit_ratio, f"CASE WHEN length(regexp_replace(text, '{W}', '', 'g')) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / length(regexp_replace(text, '{W}', '', 'g')) END")
on_lines("txt_digit_crop", lambda t: T.is_digit_crop(t, 0.3), f"regexp_matches(text, '[0-9]') AND length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(text, '{W}', '', 'g'))) >= 0.3")
on_lines("txt_sanitize_field", T.sanitize_field, "trim(regexp_replace(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), ' +', ' ', 'g'))")
on_lines("txt_script_mismatch", T.script_mismatch, "regexp_matches(text, '[A-Za-z]')")
on_lines("txt_digit_groups", lambda t: F.array_join(T.digit_groups(t), "|"), "coalesce(array_to_string(regexp_extract_all(text, '[0-9]+'), '|'), '')")
on_lines("txt_separator_pattern", lambda t: F.array_join(T.separator_pattern(t), " "), "coalesce(array_to_string(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\vA-Za-z0-9]+'), ' '), '')")
on_lines("txt_skeleton", T.skeleton, f"replace(lower(trim(regexp_replace(regexp_replace(text, '[0-9]', '#', 'g'), '{W}', ' ', 'g'))), 'ß', 'ss')")
on_lines("txt_memory_norm", T.memory_norm, f"replace(lower({NORM}), 'ß', 'ss')")
on_lines("txt_memory_digits", T.memory_digits, "regexp_replace(text, '[^0-9]', '', 'g')")
on_lines("txt_memory_shape", lambda t: F.array_join(T.memory_shape(t).cast("array<string>"), ","), "coalesce(array_to_string(list_transform(regexp_extract_all(text, '[0-9](?:[0-9.,:/-]*[0-9])?'), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g'))), ','), '')")
on_lines("txt_truncate_words", T.truncate_words, "CASE WHEN length(text) <= 60 THEN text WHEN contains(left(text, 60), ' ') AND 60 - instr(reverse(left(text, 60)), ' ') > 20 THEN left(left(text, 60), 60 - instr(reverse(left(text, 60)), ' ')) ELSE left(text, 60) END")
on_lines("txt_label_ok", T.label_ok, "length(text) BETWEEN 3 AND 48 AND regexp_matches(text, '\\p{L}')")
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
on_lines(
    "txt_corpus_line_ok",
    lambda t: T.corpus_line_ok(t, own=LATIN, allowed=LATIN + "0-9 .,;:!?()'\"-"),
    f"length({NORM}) BETWEEN 10 AND 60 AND NOT contains({NORM}, chr(65533)) AND NOT regexp_matches({NORM}, '(?i)https?://|www\\.') AND length(regexp_replace({NORM}, '[^\\p{{L}}]', '', 'g')) > 0 AND NOT regexp_matches({NORM}, '[^{LATIN}0-9 .,;:!?()''\"-]')",
)
on_lines("txt_hamming", lambda t: T.hamming(t, D.second(t)), "CASE WHEN length(text) = 0 THEN 0 ELSE (SELECT count(*) FROM unnest(range(1, length(text) + 1)) AS q(k) WHERE substr(text, k, 1) <> substr(translate(text, 'aeot130', 'eoat310'), k, 1)) END")
ORACLES["txt_hamming"] = f"WITH {D.LINES} SELECT doc_id, ln, length(regexp_replace(text, '[^aeo13]', '', 'g')) AS out FROM lines"
on_lines("txt_output_name", lambda t: T.output_name(F.concat(F.lit("scans/"), F.md5(t.cast("binary")), F.lit(".page.png")), "_ocr", "json"), "'scans/' || md5(text) || '.page_ocr.json'")
on_lines("agg_cer_line", lambda t: T.cer(t, D.second(t)), f"CASE WHEN {NORM} = '' THEN 0.0::DOUBLE ELSE {edits_sql(NORM, HYP)}::DOUBLE / length({NORM}) END")
SORTED = "array_to_string(list_sort({}), ' ')".format(sql_tokens("text"))
SORTED_HYP = "array_to_string(list_sort({}), ' ')".format(sql_tokens("translate(text, 'aeot130', 'eoat310')"))
on_lines("agg_cer_bag_line", lambda t: T.cer_bag(t, D.second(t)), f"CASE WHEN coalesce({SORTED}, '') = '' THEN 0.0::DOUBLE ELSE {edits_sql(SORTED, SORTED_HYP)}::DOUBLE / length({SORTED}) END")
DIG = "array_to_string(list_filter({}, lambda t: regexp_matches(t, '[0-9]')), ' ')"
on_lines("agg_digit_cer_line", lambda t: T.digit_cer(t, D.second(t)), "CASE WHEN coalesce({g}, '') = '' THEN 0.0::DOUBLE ELSE {e}::DOUBLE / length({g}) END".format(g=DIG.format(sql_tokens("text")), e=edits_sql(DIG.format(sql_tokens("text")), DIG.format(sql_tokens("translate(text, 'aeot130', 'eoat310')")))))
on_lines("agg_digit_exact_line", lambda t: T.digit_string(t) == T.digit_string(D.second(t)), "coalesce(array_to_string(regexp_extract_all(text, '[0-9](?:[0-9.,:/-]*[0-9])?'), ' '), '') = coalesce(array_to_string(regexp_extract_all(translate(text, 'aeot130', 'eoat310'), '[0-9](?:[0-9.,:/-]*[0-9])?'), ' '), '')")
HT = "translate(text, 'aeot130', 'eoat310')"


def bag_stats(spark, sf):
    from quirefold.operators import metrics

    lines = D.lines(spark, sf, by_page=True)
    return metrics.bag_stats(lines.select("doc_id", "ln", F.col("text").alias("gt"), D.second(F.col("text")).alias("hyp")), ["doc_id", "ln"])


QUERIES["agg_bag_stats_line"] = bag_stats
ORACLES["agg_bag_stats_line"] = f"""WITH {D.LINES}, p AS (SELECT doc_id, ln, list_distinct({sql_norm_tokens('text')}) AS g, {sql_norm_tokens(HT)} AS h FROM lines),
q AS (SELECT doc_id, ln, len(g) AS gt_tokens, len(h) AS hyp_tokens, len(list_intersect(g, list_distinct(h))) AS matched, len(list_filter(h, lambda t: NOT list_contains(g, t))) AS invented_tokens FROM p)
SELECT doc_id, ln, gt_tokens, hyp_tokens, matched, CASE WHEN gt_tokens = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - matched::DOUBLE / gt_tokens END AS miss_rate,
  invented_tokens, CASE WHEN hyp_tokens = 0 THEN 0.0::DOUBLE ELSE invented_tokens::DOUBLE / hyp_tokens END AS invented_rate FROM q"""
QUERIES["agg_wer_line"] = lambda spark, sf: D.lines(spark, sf).select("doc_id", "ln", U.wer_words("text", D.third(F.col("text"))).alias("out"))
NFC = [("e\u0301a",), ("क\u200dख ",), ("",)]
on_literals("txt_nfc", NFC, "text string", lambda: {"nfc": U.nfc("text"), "label": U.label_nfc("text")}, {"nfc": "nfc_normalize(text)", "label": "trim(nfc_normalize(text))"})
on_literals("txt_normalize_word", NFC, "text string", lambda: {"word": U.normalize_word("text")}, {"word": "trim(replace(replace(nfc_normalize(text), chr(8204), ''), chr(8205), ''))"})
on_literals("txt_runs_with_spans", [("a 12.5 b 7",), ("x",)], "text string", lambda: {"runs": F.to_json(U.runs_with_spans("text"))}, {})
on_literals("txt_ctc_decode", [("1,1,0,1,2,2", "ab"), ("0", "ab")], "ids string, chars string", lambda: {"text": U.ctc_decode(F.split("ids", ",").cast("array<int>"), F.col("chars"))}, {})
OWN = "regexp_matches(t, '[\\x{0900}-\\x{097F}]')"
WORDS = [("हाँ किं",), ("िक देश",), ("क्ा क्ं क््",), ("धारा ः",), ("ो",), ("नेपालको संविधान",), ("a1 ि",), ("",)]
on_literals("txt_devanagari_validity", WORDS, "text string", lambda: {"tokens": T.devanagari_validity(F.col("text"))["tokens"], "invalid": T.devanagari_validity(F.col("text"))["invalid_tokens"], "rate": T.devanagari_validity(F.col("text"))["invalid_token_rate"]}, {
    "tokens": f"len({sql_tokens('text')})",
    "invalid": f"len(list_filter({sql_tokens('text')}, lambda t: {OWN} AND {D.invalid_sql('t', PUNCT)}))",
    "rate": f"round(coalesce(len(list_filter({sql_tokens('text')}, lambda t: {OWN} AND {D.invalid_sql('t', PUNCT)}))::DOUBLE / nullif(len(list_filter({sql_tokens('text')}, lambda t: {OWN})), 0), 0), 4)",
})
C, V, M = "\\x{0915}-\\x{0939}", "\\x{093E}-\\x{094C}", "\\x{0901}-\\x{0903}"
on_literals("txt_deva_word", WORDS, "text string", lambda: {"words": F.array_join(T.deva_words(F.col("text")), "|"), "share": T.devanagari_ratio(F.col("text"))}, {
    "words": "coalesce(array_to_string(list_filter(regexp_extract_all(text, '[\\x{0900}-\\x{0963}\\x{0970}-\\x{097F}]+'), lambda w: length(w) >= 2), '|'), '')",
    "share": "CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(regexp_replace(text, '[^\\p{L}]', '', 'g'), '[^\\x{0900}-\\x{097F}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) END",
})
DATES = [("2075-13-01",), ("due 2075.12.32 ok",), ("20751301",), ("1899/01/01",), ("१९९९-०१-०५",), ("12345-01-01",), ("none",)]
on_literals("txt_impossible_date", DATES, "text string", lambda: {"bad": T.impossible_date(F.col("text")), "y": T.date_components(F.col("text"))["y"], "m": T.date_components(F.col("text"))["m"], "d": T.date_components(F.col("text"))["d"]}, {})
PAIRS = [("total 1200 of 5", "total 1201 of 5"), ("1234", "1243"), ("12 3456", "12 3457"), ("99999 1", "99999"), ("12345", "1234"), ("no", "yes")]
on_literals("txt_within_one_edit", PAIRS, "a string, b string", lambda: {"near": T.within_one_edit(F.col("a"), F.col("b")), "apart": T.hamming(F.col("a"), F.col("b"))}, {"near": "levenshtein(a, b) <= 1", "apart": "(SELECT count(*) FROM unnest(range(1, least(length(a), length(b)) + 1)) AS q(k) WHERE substr(a, k, 1) <> substr(b, k, 1))"})
on_literals("txt_value_pairs", PAIRS, "a string, b string", lambda: {"pairs": F.to_json(T.value_pairs(F.col("a"), F.col("b")))}, {})
on_literals("txt_digit_confusions", [("120",), ("9",), ("x",), ("२०४",)], "text string", lambda: {"chips": F.array_join(T.digit_confusions(F.col("text")), "|"), "supported": F.array_join(T.digit_confusions(F.col("text"), F.array(F.lit("128"))), "|")}, {})
NAMES = [(" NE ",), ("Auto",), ("devanagari",), ("xx",), ("",)]
on_literals("txt_language_alias", NAMES, "name string", lambda: {"alias": T.language_alias(F.col("name"))}, {"alias": "CASE WHEN lower(trim(name)) IN ('devanagari', 'deva', 'ne', 'nep', 'hi', 'hin') THEN 'devanagari' ELSE 'default' END"})
FLAGS = [("b|a|b",), ("low_conf",), ("",)]
on_literals("txt_flags_key", FLAGS, "flags string", lambda: {"k": T.flags_key(F.filter(F.split("flags", r"\|"), lambda x: x != ""))}, {"k": "coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(flags, '|'), lambda x: x <> ''))), '|'), '')"})
LABELS = [("confirmed", "a", "b"), ("changed", "a", "b")]
on_literals("txt_canonical_label", LABELS, "action string, original string, corrected string", lambda: {"label": T.canonical_label(F.col("action"), F.col("original"), F.col("corrected"))}, {"label": "CASE WHEN action = 'confirmed' THEN original ELSE corrected END"})


def charset(spark, sf):
    chars = D.table(spark, sf, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    # a few hundred characters at most: one window over them all
    from pyspark.sql import Window

    return chars.select("ch", F.row_number().over(Window.orderBy(F.expr("hex(ch)"))).cast("long").alias("id"))


QUERIES["txt_charset"] = charset
ORACLES["txt_charset"] = "SELECT ch, row_number() OVER (ORDER BY hex(ch)) AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''"
