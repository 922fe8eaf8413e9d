import os

import pytest

from quirefold.plans import catalog
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, con, name):
    ok, why = same(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ok, why


@pytest.mark.parametrize(
    "texts",
    [
        [(1, "ab cd\n\nfgh", "aa"), (2, "x9 qq\nuvw", "bb"), (3, "vwx yz", "cc")],
        [(1, "", "aa"), (2, None, "bb"), (3, "\n\n", "cc"), (4, "a b\r\nc d\n", "dd")],
        [(None, "abc def\nxx", "aa"), (None, "abc de\nxyz", "aa"), (5, "q1 w2 xy\n33 1", None)],
        [(1, "vw xyz", "aa"), (1, "vw xy", "aa"), (1, "vw aexy", "aa"), (2, "kk 8z\nm", "bb"), (2, "k 8\nma", "bb")],
    ],
    ids=["no line of a kind", "no text", "no id or language", "an id that occurs again"],
)
def test_token_stats_lines_against_sql_on_odd_texts(spark, tmp_path, texts):
    spark.createDataFrame([(*t, "s") for t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "agg_token_stats_lines"
    ok, why = same(spark, connect(str(tmp_path)), catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
