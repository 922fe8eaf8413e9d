"""What keeps work in proportion to the tables: kernels against plain ones, and plans that shuffle texts but not their tokens."""
import difflib
import os
import random
import re

import numpy as np
import pytest

from quirefold.functions import edits as E
from quirefold.functions.udfs import word_edits
from quirefold.operators.joins import met
from quirefold.plans import catalog

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def pairs(n, seed):
    rng = random.Random(seed)
    text = lambda most, letters: "".join(rng.choice("abcdefghij kéक"[:letters]) for _ in range(rng.randint(0, most)))
    for _ in range(n):
        most, letters = rng.choice([0, 1, 5, 63, 64, 65, 130, 200]), rng.choice([1, 2, 14])
        a = text(most, letters)
        yield a, a.translate(str.maketrans("aeb", "eab")) if rng.random() < 0.5 else text(most, letters)


def test_distances_against_plain_table():
    a, b = zip(*pairs(600, 1))
    want = [word_edits(list(x), list(y)) for x, y in zip(a, b)]
    assert E.distances([E.characters(x) for x in a], [E.characters(y) for y in b]).tolist() == want
    assert [E.distance(list(x), list(y)) for x, y in zip(a, b)] == want
    some = sorted((i for i in range(len(a)) if a[i] and b[i]), key=lambda i: -len(b[i]))
    assert E._together([E.characters(a[i]) for i in some], [E.characters(b[i]) for i in some]).tolist() == [want[i] for i in some]


def test_edits_of_nulls(spark):
    df = spark.createDataFrame([("ab", "b"), (None, "b"), ("ab", None), ("ab", "b")], "a string, b string")
    assert [r[0] for r in df.select(E.edits("a", "b")).collect()] == [1, None, None, 1]


def test_blocks_against_difflib():
    for a, b in pairs(400, 2):
        own = difflib.SequenceMatcher(None, a, b, autojunk=False)
        want = [tuple(x) for x in own.get_matching_blocks()][:-1]
        assert E.blocks(a, b) == want and E.blocks(a, b, 0) == want and E.blocks(a, b, 100) == want
        assert list(E.opcodes(a, b)) == own.get_opcodes() and E.similarity(a, b) == own.ratio()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_met_is_a_join(spark, how):
    a = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, 2, "z"), (1, None, "n"), (None, 1, "m"), (2, 1, None), (3, 3, "q")], "p long, k long, v string")
    b = spark.createDataFrame([(1, 1, 5), (1, 1, None), (1, None, 6), (None, 1, 7), (2, 1, 8), (4, 4, 9)], "p long, k long, w int")
    rows = lambda df: sorted(map(str, df.select("p", "k", "v", "w").collect()))
    assert rows(met(a, b, ["p", "k"], how)) == rows(a.join(b, ["p", "k"], how))


@here
@pytest.mark.parametrize("name", ["agg_bag_stats_line", "agg_ece_tokens", "agg_hallucination", "agg_lexicon_sweep", "agg_three_way_agreement", "agg_valid_truth", "cur_anchor_status", "join_apply_corrections", "join_peer_inventions", "snk_corrections_record", "snk_ocr_result"])
def test_tokens_stay_with_their_page(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    asked = re.findall(r"Exchange hashpartitioning\(([^)]*)\), ENSURE_REQUIREMENTS", plan)
    assert not [e for e in asked if "doc_id" in e or "page" in e]
    assert "Union" not in plan  # of dealt rows it may lose where they lie


def test_error_kinds_and_distinct_tokens(spark):
    from quirefold.functions import text as T
    from quirefold.functions.udfs import error_kind

    cases = [("12 क", "13 क", "digit"), ("कख", "खक", "order"), ("कख", "गघ", "unrelated"), ("कि", "की", "matra"), ("कि", "कखि", "consonant"), ("abc", "abd", "other"), (None, "a", "other")]
    df = spark.createDataFrame(cases, "g string, h string, kind string")
    assert all(r.found == r.kind for r in df.select("kind", T.token_error_kind(df.g, df.h).alias("found")).collect())
    assert [error_kind(g, h) for g, h, _ in cases] == [k for *_, k in cases]
    df = spark.createDataFrame([("A a, b!  B .",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(T.distinct_tokens(df.text)).collect()] == [["a", "b"], [], None]


def test_pages_across_batches(spark):
    from quirefold.operators.layout import per_page

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(p, k) for p, n in ((1, 3), (2, 20), (None, 5), (3, 7), (4, 1)) for k in range(n)]
        df = spark.createDataFrame(rows, "page long, k long")
        got = per_page(df, "page", ["k"], ["k"], lambda k: (k[:1] * 0 + len(k), k[-1:]), "n long, last long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, got)) == sorted(f"Row(page={p}, n={n}, last={n - 1})" for p, n in ((1, 3), (2, 20), (None, 5), (3, 7), (4, 1)))
