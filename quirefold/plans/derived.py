"""Relations that the queries read, derived from the tables, with the SQL that gives the same rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\r\\f\\v]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)


def spread(rows: DataFrame, name: str) -> DataFrame:
    """Documents and conversations dealt over all cores if they come in fewer pieces than there are cores, so that a small file of one row
    group isn't one task; a table of more pieces, as any large one, is left as it is and nothing is shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "conversations") and rows.rdd.getNumPartitions() < cores else rows


#: Bytes of a file's documents in one piece of dealt ones.
PIECE = 2 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """Documents dealt by their id, so that what is grouped, numbered or joined by page later (by doc_id, alone or with more)
    is where it belongs: texts are shuffled once, and not their tokens. The number of pieces follows the size of the files,
    so all sides of a join have as many, and a piece's tokens are sorted in memory."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE)), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for what is done page by page."""
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def second(text: Column) -> Column:
    """A second reading of a text, with fixed confusions."""
    return F.translate(text, "aeot130", "eoat310")


def third(text: Column) -> Column:
    return F.translate(text, "rnls24", "nrsl42")


SECOND, THIRD = "translate({}, 'aeot130', 'eoat310')", "translate({}, 'rnls24', 'nrsl42')"


def lines(spark: SparkSession, sf_dir: str, by_page: bool = False) -> DataFrame:
    docs = pages(spark, sf_dir) if by_page else table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("ln", "text")).withColumn("ln", F.col("ln").cast("long"))


LINES = """lines AS (
  SELECT doc_id, lang, source, i - 1 AS ln, l[i] AS text
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i))"""


def tok(spark: SparkSession, sf_dir: str, by_page: bool = True) -> DataFrame:
    """Every token of every document, with boxes on a grid and a confidence; pages are dealt unless they stay apart."""
    docs = (pages(spark, sf_dir) if by_page else table(spark, sf_dir, "documents")).where("text is not null")
    words = F.filter(F.split("text", SPACE), lambda t: t != "")
    rows = docs.select("doc_id", "lang", "source", F.posexplode(words).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    x0, y0 = (F.col("pos") % 10) * 100, F.floor(F.col("pos") / 10) * 40
    return rows.select("*", ((F.col("doc_id") * 37 + F.col("pos") * 17) % 101).cast("double").alias("conf"), x0.alias("x0"), y0.alias("y0"), (x0 + 9 * F.length("text")).alias("x1"), (y0 + 30).alias("y1"))


TOK = r"""tok AS (
  SELECT doc_id, lang, source, i - 1 AS pos, l[i] AS text, CAST((doc_id * 37 + (i - 1) * 17) % 101 AS DOUBLE) AS conf,
         ((i - 1) % 10) * 100 AS x0, ((i - 1) // 10) * 40 AS y0, ((i - 1) % 10) * 100 + 9 * length(l[i]) AS x1, ((i - 1) // 10) * 40 + 30 AS y1
  FROM (SELECT doc_id, lang, source, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS l FROM documents),
       unnest(range(1, len(l) + 1)) AS r(i))"""


def flagged(tokens: DataFrame) -> DataFrame:
    from quirefold.operators.flags import flag_tokens

    return tokens.withColumn("flags", flag_tokens(F.col("text"), F.col("conf")))


FLAGGED = TOK + """, flagged AS (
  SELECT *, list_filter([CASE WHEN conf < 60 THEN 'low_conf' END, CASE WHEN regexp_matches(text, '[0-9]') AND conf < 80 THEN 'digit_uncertain' END], lambda f: f IS NOT NULL) AS flags,
         (CASE WHEN conf < 60 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(text, '[0-9]') AND conf < 80 THEN 1.5::DOUBLE ELSE 0 END) AS risk
  FROM tok)"""


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The same rows as SQL."""
    put = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(put, r)) + ')' for r in rows)}) AS v({names})"


#: Latin letters as Devanagari ones and signs, so that tables without any give tokens of that script, right and wrong.
SCRIPT = ("aeiouhmntsrkdlg", "ाेिोु्ंनतसरकदलग")


def deva(text: Column) -> Column:
    return F.translate(text, *SCRIPT)


DEVA = f"translate({{}}, '{SCRIPT[0]}', '{SCRIPT[1]}')"


def invalid_sql(token: str, punct: str) -> str:
    """functions.text.invalid_devanagari in SQL."""
    from quirefold.functions.text import CLASSES

    body = f"regexp_replace(trim({token}, '{punct}'), '[^{''.join(c for _, c in CLASSES)}]', 'O', 'g')"
    for letter, chars in CLASSES:
        body = f"regexp_replace({body}, '[{chars}]', '{letter}', 'g')"
    return f"(contains({token}, chr(65533)) OR (NOT regexp_matches({body}, '^M+$') AND regexp_matches({body}, '(^|[^CN])[VHN]|(^|[HO])M')))"
