"""Queries of reading order, line grouping and box matching."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.operators import layout as L

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


@query("ord_reading_order")
def reading_order(spark, sf):
    return L.reading_order(D.tok(spark, sf)).withColumn("moved", F.col("pos") != F.col("read_pos")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("moved"), 1)).alias("moved"))


#: tokens dealt into another order than they stand in on the page
DEALT = "dealt AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY pos % 3, pos % 7, pos) - 1 AS pos), pos AS place FROM tok)"


def dealt(spark, sf):
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("place") % 3, F.col("place") % 7, "place"))
    return D.tok(spark, sf).withColumn("place", F.col("pos")).withColumn("pos", (order - 1).cast("long"))


@query("ord_row_major", f"WITH {D.TOK}, {DEALT} SELECT doc_id, pos, place AS read_pos FROM dealt")
def row_major(spark, sf):
    return L.row_major(dealt(spark, sf))


@query("ord_gutters")
def gutters(spark, sf):
    return L.gutters(D.tok(spark, sf))


@query("clu_merge_lines")
def merge_lines(spark, sf):
    return L.merge_lines(D.tok(spark, sf)).select("doc_id", "line", "x0", "y0", "x1", "y1", F.size("places").cast("long").alias("n"))


def boxes(spark, sf, p, shift):
    rows = D.tok(spark, sf)
    return rows.select(F.col("doc_id").alias("page"), F.col("pos").alias(f"{p}i"), *((F.col(k) + shift).alias(f"{p}{k}") for k in ("x0", "y0", "x1", "y1")))


@query("join_iou_pairs", f"""WITH {D.TOK}, p AS (SELECT a.doc_id AS page, a.pos AS ai, b.pos AS bi, greatest(0, least(a.x1, b.x1 + 3) - greatest(a.x0, b.x0 + 3)) * greatest(0, least(a.y1, b.y1 + 3) - greatest(a.y0, b.y0 + 3)) AS i,
 (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.y0 = a.y0)
SELECT page, ai, bi, i::DOUBLE / (aa + ba - i) AS iou FROM p WHERE i > 0 AND i::DOUBLE / (aa + ba - i) >= 0.5""")
def iou_pairs(spark, sf):
    return L.iou_pairs(boxes(spark, sf, "a", 0), boxes(spark, sf, "b", 3))


@query("agg_box_report")
def box_report(spark, sf):
    a, b = boxes(spark, sf, "a", 0), boxes(spark, sf, "b", 3)
    return L.box_report(a, b, L.greedy_match(L.iou_pairs(a, b)))


@query("join_align_lines")
def align(spark, sf):
    talks = D.table(spark, sf, "conversations").select(F.xxhash64("conv_id", "turn").alias("page"), F.split("text", "\n").alias("a"))
    return L.aligned(talks.withColumn("b", F.transform("a", D.second)), "page", "a", "b")


@query("clu_x_clusters")
def clusters(spark, sf):
    return L.x_clusters(D.tok(spark, sf)).groupBy("doc_id", "cluster").agg(F.count("*").alias("n"))


DATES = [("p", 0, i, 2075, m) for i, m in enumerate((1, 2, 3, 4))] + [("p", 0, 4, 2015, 5), ("p", 1, 5, 2070, 7), ("p", 1, 6, 2071, 7), ("p", 1, 7, 2072, 7), ("p", 1, 8, 2073, 1)]


@query("clu_date_majority", "SELECT * FROM (VALUES ('p', 0, 4, 'year', 2075), ('p', 1, 8, 'month', 7)) AS v(page, cluster, pos, odd, expected)")
def dates(spark, sf):
    return L.date_majority(D.literals(spark, DATES, "page string, cluster int, pos int, y int, m int"))
