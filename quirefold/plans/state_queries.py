"""Queries of limits and quotas, memory, samples and sets."""
from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import joins as J
from quirefold.operators import memory as MEM
from quirefold.operators import sampling as S
from quirefold.streaming import limits as L

from . import derived as D
from .token_queries import corrections, CORR

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def events(spark, sf):
    rows = D.table(spark, sf, "events")
    return rows.select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (1 + F.col("event_id") % 4).alias("n"))


@query("str_rate_limit", """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
q AS (SELECT key, k, event_id, t, TRUE AS allowed, t AS held, 0::BIGINT AS retry FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, e.event_id, e.t, e.t - q.held > 3600, CASE WHEN e.t - q.held > 3600 THEN e.t ELSE q.held END, CASE WHEN e.t - q.held > 3600 THEN 0 ELSE greatest(CAST(floor(3600 - (e.t - q.held)) AS BIGINT) + 1, 1) END FROM q JOIN e ON e.key = q.key AND e.k = q.k + 1)
SELECT key, event_id, allowed, retry FROM q""")
def rate_limit(spark, sf):
    return L.rate_limit(events(spark, sf), 3600.0, 1).select("key", "event_id", "allowed", "retry")


DAY = "epoch_us(ts) // 86400000000"
QUOTA = """WITH RECURSIVE e AS (SELECT {key} AS key, event_id, ts, {day} AS day, 1 + event_id % 4 AS n, row_number() OVER (PARTITION BY {key}, {day} ORDER BY ts, event_id) AS k FROM events),
q AS (SELECT key, day, k, event_id, n <= {limit} AS allowed, CASE WHEN n <= {limit} THEN n ELSE 0 END AS used FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.day, e.k, e.event_id, q.used + e.n <= {limit}, CASE WHEN q.used + e.n <= {limit} THEN q.used + e.n ELSE q.used END FROM q JOIN e ON e.key = q.key AND e.day = q.day AND e.k = q.k + 1)
SELECT key, event_id, allowed FROM q"""


@query("str_keyed_daily_quota", QUOTA.format(key="user_id", day=DAY, limit=5))
def keyed_quota(spark, sf):
    return L.daily_quota(events(spark, sf), 5).select("key", "event_id", "allowed")


@query("str_daily_quota", QUOTA.format(key="0::BIGINT", day=DAY, limit=200))
def daily_quota(spark, sf):
    return L.daily_quota(events(spark, sf).withColumn("key", F.lit(0).cast("long")), 200).select("key", "event_id", "allowed")


@query("str_client_key", "SELECT event_id, 'p' || (event_id % 7) AS client FROM events")
def client_key(spark, sf):
    rows = D.table(spark, sf, "events")
    forwarded = F.concat(F.lit("10.0.0.1 , p"), (F.col("event_id") % 7).cast("string"), F.lit(" , "))
    return rows.select("event_id", L.client_key(F.lit("peer"), forwarded).alias("client"))


@query("str_ttl_prune", "SELECT event_id FROM events WHERE 1705000000::DOUBLE > greatest(epoch_us(ts) / 1e6 + value, epoch_us(ts) / 1e6 + 3600)")
def ttl(spark, sf):
    rows = events(spark, sf).join(D.table(spark, sf, "events").select("event_id", "value"), "event_id")
    return L.expired(rows.select("event_id", (F.col("t") + F.col("value")).alias("expires"), F.col("t").alias("touched")), 1705000000.0, 3600.0).select("event_id")


@query("str_tumbling_window", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return L.tumbling(D.table(spark, sf, "events"), "1 day").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str_skip_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf):
    return L.skip_existing(D.table(spark, sf, "documents").select("doc_id"), D.table(spark, sf, "labels"), "doc_id")


@query("win_keep_last", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 2000")
def keep_last(spark, sf):
    return L.keep_last(D.table(spark, sf, "events").withColumn("seq", F.col("event_id")), 2000).select("event_id")


@query("win_gaps_and_islands", f"""WITH {D.TOK}, b AS (SELECT *, max(y1) OVER (PARTITION BY doc_id ORDER BY y0, y1, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tok),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR y0 - before > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y0, y1, pos) AS band FROM b) SELECT doc_id, CAST(band AS BIGINT) AS band, count(*) AS n FROM n GROUP BY ALL""")
def islands(spark, sf):
    return L.gaps_and_islands(D.tok(spark, sf), "doc_id", "y0", "y1", 5).groupBy("doc_id", "band").agg(F.count("*").alias("n"))


LOG = f"""WITH {D.TOK}, {CORR}, log AS (SELECT doc_id * 100000 + seq AS seq, doc_id % 10 AS session, lower(original) AS key, original, corrected, CASE WHEN seq % 7 = 1 THEN 'word_accept' WHEN seq % 7 IN (2, 3) THEN 'word_reject' ELSE 'word' END AS kind FROM corr)"""


def log(spark, sf):
    rows = corrections(spark, sf)
    kind = F.when(F.col("seq") % 7 == 1, "word_accept").when((F.col("seq") % 7).isin(2, 3), "word_reject").otherwise("word")
    return rows.select((F.col("doc_id") * 100000 + F.col("seq")).alias("seq"), (F.col("doc_id") % 10).alias("session"), F.lower("original").alias("key"), "original", "corrected", kind.alias("kind"))


FOLD = """, f AS (SELECT key, min(seq) AS first_seq, arg_max(corrected, seq) AS text, count(*) AS count FROM log WHERE kind = 'word' GROUP BY key),
b AS (SELECT key, count(*) FILTER (kind = 'word_accept') AS accepted, count(*) FILTER (kind = 'word_reject') AS rejected FROM log JOIN f USING (key) WHERE seq > first_seq GROUP BY key),
idx AS (SELECT f.*, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected FROM f LEFT JOIN b USING (key))"""
USABLE = "rejected <= accepted AND (accepted + rejected < 2 OR accepted::DOUBLE / greatest(accepted + rejected, 1) >= 0.5)"


@query("agg_memory_index", LOG + FOLD + f" SELECT key, text, count, accepted, rejected, {USABLE} AS usable FROM idx")
def memory_index(spark, sf):
    found = MEM.fold(log(spark, sf), ["key"], "word", "corrected")
    return found.select("key", "text", "count", "accepted", "rejected", MEM.usable(F.col("accepted"), F.col("rejected")).alias("usable"))


@query("agg_memory_stats", LOG + " SELECT kind, count(*) AS n FROM log GROUP BY kind")
def memory_stats(spark, sf):
    return MEM.stats(log(spark, sf))


@query("join_word_memory")
def word_memory(spark, sf):
    index = MEM.fold(log(spark, sf), ["key"], "word", "corrected").withColumnRenamed("key", "word")
    words = D.table(spark, sf, "benchmark").select(F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("p", "word")).select(F.xxhash64("word").alias("id"), "word").distinct()
    lexicon = D.table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return MEM.suggest_words(words, index, lexicon).select("word", "suggestion", "count")


@query("str_session_as_of", LOG + ", p AS (SELECT key, session, count(*) AS n FROM log WHERE kind = 'word' GROUP BY ALL) SELECT l.seq AS id, l.session, l.key, CAST(coalesce((SELECT sum(n) FROM p WHERE p.key = l.key AND p.session < l.session), 0) AS BIGINT) AS seen FROM log l")
def as_of(spark, sf):
    rows = log(spark, sf)
    return MEM.as_of(rows.withColumn("id", F.col("seq")), rows.where("kind = 'word'"), ["key"])


def token_id():
    return F.col("doc_id") * 100000 + F.col("pos")


@query("join_value_memory")
def value_memory(spark, sf):
    digits = lambda c: T.memory_digits(F.col(c))
    learned = log(spark, sf).withColumns({"value": digits("original"), "corrected": digits("corrected")}).where(F.length("value") >= MEM.VALUE_DIGITS)
    index = MEM.fold(learned, ["value"], "word", "corrected").withColumnRenamed("text", "corrected")
    return MEM.suggest_values(D.tok(spark, sf).select(token_id().alias("id"), T.memory_digits(D.second(F.col("text"))).alias("digits")), index)


@query("join_line_memory")
def line_memory(spark, sf):
    learned = log(spark, sf).withColumns({"key": F.floor(F.col("seq") / 100000), "digits": T.memory_digits(F.col("original"))})
    index = MEM.fold(learned, ["key", "digits"], "word", "corrected")
    return MEM.suggest_lines(D.tok(spark, sf).select(token_id().alias("id"), F.col("doc_id").alias("key"), D.second(F.col("text")).alias("text")), index)


@query("smp_sample")
def sample(spark, sf):
    return S.sample(D.table(spark, sf, "documents").select("doc_id", "lang"), 50, "doc_id", 7)


@query("smp_split", "SELECT part, n FROM (SELECT greatest(1, floor(count(*) * 0.05::DOUBLE))::BIGINT AS v, count(*) AS c FROM documents), LATERAL (VALUES ('val', v), ('train', c - v)) AS p(part, n)")
def split(spark, sf):
    return S.split(D.table(spark, sf, "documents").select("doc_id"), "doc_id").groupBy("part").agg(F.countDistinct("doc_id").alias("n"))


@query("win_capped", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 4 ORDER BY source, doc_id LIMIT 60")
def capped(spark, sf):
    return S.capped(D.table(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 4, 60)


@query("win_first_occurrence", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first(spark, sf):
    return S.first_occurrence(D.table(spark, sf, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


@query("set_repeat_union", "SELECT 'b' AS part, item_id AS id FROM benchmark, unnest(range(3)) UNION ALL SELECT 'p', page_id FROM pages")
def repeat_union(spark, sf):
    a = D.table(spark, sf, "benchmark").select(F.lit("b").alias("part"), F.col("item_id").alias("id"))
    b = D.table(spark, sf, "pages").select(F.lit("p").alias("part"), F.col("page_id").alias("id"))
    return S.repeated([(a, 3), (b, 1)])


@query("set_charset_filter", "SELECT doc_id FROM documents WHERE regexp_full_match(text, '[A-Za-z0-9 .,\\n]*')")
def charset_filter(spark, sf):
    import string

    return S.within_charset(D.table(spark, sf, "documents"), "text", string.ascii_letters + string.digits + " .,\n").select("doc_id")


@query("set_except", "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM benchmark) SELECT word FROM w EXCEPT SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) FROM documents")
def except_words(spark, sf):
    words = lambda n: D.table(spark, sf, n).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words("benchmark").distinct().join(words("documents"), "word", "left_anti")


@query("join_manifest_audit", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 11 = 3 THEN 'missing' WHEN doc_id % 7 = 2 THEN 'size' WHEN doc_id % 5 = 1 THEN 'hash' ELSE 'ok' END AS status FROM documents")
def manifest_audit(spark, sf):
    docs = D.table(spark, sf, "documents")
    digest = F.sha2(F.col("text"), 256)
    manifest = docs.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("bytes"), digest.alias("sha256"))
    disk = docs.where("doc_id % 11 <> 3").select(F.col("doc_id").cast("string").alias("path"), (F.octet_length("text") + F.when(F.col("doc_id") % 7 == 2, 1).otherwise(0)).alias("length"), F.when(F.col("doc_id") % 5 == 1, F.lit("x")).otherwise(digest).alias("digest"))
    return J.audit_manifest(manifest, disk)
