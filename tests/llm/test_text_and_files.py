import base64
import hashlib
import math
import random
import string
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm import bpe, mixing, url_filter, warc
from quirefold.llm.common import Scratch

PATH = public_tokenizers.path(bpe.TOKENIZER)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_encode_any_text(reference, text):
    enc = bpe.encoder(PATH)
    (got,) = enc.encode([text])
    assert ids(got) == reference.encode_ordinary(text) and enc.decode(got) == text.encode()


@pytest.mark.parametrize("alphabet", ["ab", "aab", "etaoin", "日本語", string.ascii_letters, "z"])
def test_long_pieces(reference, alphabet):
    rng = random.Random(len(alphabet))
    for n in (1, 2, 63, 64, 65, 511, 512, 513, 3000, 100_000 if alphabet == "ab" else 9000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert ids(bpe.encoder(PATH).encode([text])[0]) == reference.encode_ordinary(text)


def test_bpe_rows(spark, reference):
    docs = [(1, "Hello, wörld  <|endoftext|>\n\n x"), (2, None), (3, ""), (4, "long " * 50_000), (4, "long " * 50_000), (None, "a")]
    got = bpe.encode_decode(spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(0))).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(reference.encode_ordinary(t or ""))) for i, t in docs)
    assert all(bytes(r.decoded) == (t or "").encode() for r, (_, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(docs, key=lambda d: str(d[0]))))
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = bpe.token_ids(spark.createDataFrame(docs[:1], "doc_id long, text string")).first()
    assert one.token_ids == reference.encode_ordinary(docs[0][1]) and one.round_trip


def test_pair_table_with_many_collisions():
    pairs = np.unique(np.random.default_rng(0).integers(0, 2**40, 5000))
    table = bpe.PairTable(pairs, np.arange(len(pairs), dtype=np.int32))
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    assert (table.find(a, b) == np.arange(len(pairs))).all()
    assert (table.find(a + 1000, b) == bpe.NONE).all() and table.find(np.array([-1]), np.array([5]))[0] == bpe.NONE


URLS = [
    "http://WWW.Example.com/en/1?x", "https://example.com/en/", "https://a.example.com/en/x#y", "http://example.com", "http://casino-xxx.test/free-porn?q", "http://shop.net/es/1", "http://net/fr/",
    None, "", "no scheme/com/", "x://b.com?/", "http://notcom/", "http://a.com/en\nline", "http://a.com/" + "q" * 5000,
]


def test_url_rules_and_sql(spark):
    pages = [(i, u, "h") for i, u in enumerate(URLS)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    for i, u in enumerate(URLS):
        assert (got[i].host, got[i].path) == url_filter.split_url(u)
    assert [got[i].rule for i in range(7)] == ["www.example.com/en/", "example.com/en/", "example.com/en/", None, None, "net/es/", "net/fr/"]
    assert [got[i].verdict for i in (0, 1, 4, 5)] == ["allow", "block", "block", "block"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(i, u) for i, u, _ in pages])
    sql = {r[0]: r[1:] for r in con.execute(url_filter.oracle_sql()).fetchall()}
    assert all(sql[i] == (r.host, r.path, r.rule, r.verdict, r.score) for i, r in got.items())
    assert url_filter.url_filter(df.limit(0)).collect() == []


def test_url_rows_that_repeat(spark):
    rows = [(1, URLS[5])] * 3 + [(None, URLS[0]), (1, URLS[1])]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string").withColumns({"verdict": F.lit("x"), "score": F.lit("y")})).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == [("1", "block")] * 4 + [("None", "allow")]


def test_url_model_tells_its_table_apart(spark):
    rows = [(i, u) for i, (u, _) in enumerate(url_filter.LABELLED)]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules=()).collect()
    assert sum((r.verdict == "block") == bool(url_filter.LABELLED[r.page_id][1]) for r in got) >= 0.95 * len(rows)


PAGES = [(i, f"http://x/{i}", f"<p>é{i}</p>" * (i % 5)) for i in range(1, 70)] + [(None, None, None), (None, "u", ""), (500, "http://x", None), (500, "http://x", None), (501, "z", "y" * 200_000)]
SCHEMA = "page_id long, url string, html string, file string"


def test_fixity_drill(spark):
    pages = spark.createDataFrame([(*p, "f") for p in PAGES], SCHEMA)
    index = warc.archive(pages, 10)
    rules = {"altered": (7, 3), "missing": (11, 4), "moved": (13, 6)}
    got = warc.fixity(spark, index, warc.drill(pages, 10, **rules), span=300, fanout=3).collect()
    assert len(got) == len(PAGES)
    hit = lambda i, name: i is not None and i % rules[name][0] == rules[name][1]
    want = lambda i: next((name for name in ("missing", "moved", "altered") if hit(i, name)), "intact")
    assert all(r.status == want(r.page_id) for r in got)
    by_file = {}
    for r in sorted(got, key=lambda r: (r.file, r.record)):
        assert r.offset == by_file.get(r.file, 0)
        by_file[r.file] = r.offset + r.length
    for r in got:
        assert (r.found_at is None) == (r.status == "missing") and (r.found_at == r.offset) == (r.status in ("intact", "altered"))
        assert r.status != "moved" or r.found_at >= by_file[r.file]
    one = next(r for r in got if r.page_id == 1)
    html = "<p>é1</p>"
    raw = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: http://x/1\r\nContent-Type: text/html\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()
    assert one.record_sha256 == hashlib.sha256(raw).hexdigest() and one.length == len(raw)


def test_fixity_of_a_replica_with_other_records(spark):
    parts = [bytes([97 + k]) * (10 + k) for k in range(12)] + [b"a" * 10]  # the first and the last are equal
    at = [sum(map(len, parts[:k])) for k in range(len(parts))]
    index = spark.createDataFrame([(k, 0, k, at[k], len(b), hashlib.sha256(b).hexdigest()) for k, b in enumerate(parts)] + [(99, 5, 0, 0, 3, "x")], "page_id long, file long, record long, offset long, length long, digest string")
    copy = {at[k]: b for k, b in enumerate(parts)}
    copy[at[2]] = parts[2][:-3]  # truncated
    copy[at[5]], copy[at[6]] = parts[5] + b"!", b"new"  # longer; replaced
    del copy[at[3]], copy[at[8]], copy[at[12]]  # lost; behind the end; the second of two equal ones behind the end
    copy |= {at[12] + 10: parts[8], at[12] + 40: parts[12], at[12] + 60: b"more"}
    replica = warc.scanned(spark.createDataFrame([(0, o, bytearray(b)) for o, b in copy.items()] + [(7, 0, bytearray(b"alone"))], "file long, offset long, bytes binary"))
    got = warc.fixity(spark, index, replica, span=25, fanout=2).collect()
    by_record = {r.record: (r.status, r.found_at) for r in got if r.file == 0 and r.record is not None}
    want = {k: ("intact", at[k]) for k in range(13)} | {2: ("altered", at[2]), 3: ("missing", None), 5: ("altered", at[5]), 6: ("altered", at[6]), 8: ("moved", at[12] + 10), 12: ("moved", at[12] + 40)}
    assert by_record == want
    assert sorted((r.file, r.offset, r.length) for r in got if r.status == "extra") == [(0, at[12] + 60, 4), (7, 0, 5)]
    assert [(r.page_id, r.status) for r in got if r.file == 5] == [(99, "missing")]
    shifted = index.withColumn("offset", F.col("offset") + F.when(F.col("record") >= 4, 7).otherwise(0)).select("file", "offset", "length", "digest")
    got = {r.record: r.status for r in warc.fixity(spark, index, shifted, span=25, fanout=2).collect() if r.file == 0}
    assert got == {k: "intact" if k < 4 else "moved" for k in range(13)}


def test_audit_descends_mismatches_only(spark):
    rows = [(0, 10 * k, 10, f"d{k}") for k in range(70)]
    schema = "file long, offset long, length long, digest string"
    scratch = Scratch(spark, "t")
    left = warc.merkle_tree(spark.createDataFrame(rows, schema), scratch, 4, 10, 4)
    right = warc.merkle_tree(spark.createDataFrame([(*r[:3], "x" if r[1] == 170 else r[3]) for r in rows], schema), scratch, 4, 10, 4)
    doubt, met = warc.audit(spark, left, right, scratch, 4)
    assert [(r.file, r.node) for r in doubt.collect()] == [(0, 17)] and met == [1] * len(left)
    assert warc.audit(spark, left, left, scratch, 4)[0].count() == 0


def test_fixity_empty(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert warc.fixity(spark, warc.archive(pages), warc.drill(pages)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=20), st.integers(20, 200))
def test_pfair_deviation(weights, period):
    quota = mixing.quotas(weights, period)
    assert sum(quota) == period and min(quota) >= 1
    slots = mixing.pfair_period(quota)
    assert sorted(t for own in slots for t in own) == list(range(period))
    for q, own in zip(quota, slots):
        had = np.searchsorted(own, np.arange(1, period + 1))
        assert (np.abs(had - q * np.arange(1, period + 1) / period) < 1).all()


def test_schedule(spark):
    docs = [(i, "a" if i % 3 else "b" if i % 2 else None, f"t{i}", 1) for i in range(200)] + [(7, "a", "t7", 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, slot int").drop("slot")
    weights = {"a": 1.0, "b": 2.0, None: 1.0}
    got = mixing.schedule(spark, df, weights, block_docs=4, shard_docs=30).collect()
    assert len({r.position for r in got}) == len(got)
    assert {(r.doc_id, r.source) for r in got} == {d[:2] for d in docs}
    slots = sorted({(r.slot, r.source) for r in got}, key=lambda x: x[0])
    assert [s for s, _ in slots] == list(range(len(slots)))
    for t in range(1, len(slots) + 1):
        for source, w in weights.items():
            assert abs(sum(s == source for _, s in slots[:t]) - Fraction(w) / 4 * t) < 1
    first = [r.doc_id for r in got if r.epoch == 0]
    assert sorted(first) == sorted(d[0] for d in docs)


def test_mix_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 5), (None, "s", None, 6)], "doc_id long, source string, text string, slot int")
    assert sorted(map(str, mixing.mix(spark, df).distinct().collect())) == sorted(map(str, df.collect()))
    assert mixing.mix(spark, df.limit(0)).collect() == []
    assert mixing.mix(spark, df).columns == df.columns


@pytest.mark.parametrize("weights", [[1.0] * 20, [1, 0.1, 7 ** 0.8, 1e5 ** 0.8, 3.3]])
def test_pfair_keeps_the_weights_over_a_long_run(weights):
    length, total = 30_000, sum(map(Fraction, weights))
    shares = [Fraction(w) / total for w in weights]
    runs = mixing.pfair(weights, [math.ceil(length * w) for w in shares])
    slots = [[] for _ in weights]
    for s, run, part in runs:
        assert run * mixing.RUN == len(slots[s])
        slots[s].extend(part)
    assert sorted(t for own in slots for t in own) == list(range(sum(map(len, slots))))
    for w, own in zip(shares, slots):
        assert all(w * t - 1 < i and i + 1 < w * (t + 1) + 1 for i, t in enumerate(own))


def test_pfair_over_a_million_slots_and_small_weights():
    weights = [1.0, 1e-3, 1e-6, 0.37]
    total = sum(map(Fraction, weights))
    slots = [[] for _ in weights]
    for s, _, part in mixing.pfair(weights, [math.ceil(Fraction(w) / total * 1_000_000) for w in weights]):
        slots[s].extend(part)
    whole = mixing.whole(weights)
    for w, own in zip(whole, slots):  # in whole numbers: after slot t, the count is within one of w (t + 1) / sum
        assert all(abs((i + 1) * sum(whole) - w * (t + 1)) < sum(whole) and abs(i * sum(whole) - w * t) < sum(whole) for i, t in enumerate(own))
    assert sum(map(len, slots)) >= 1_000_000


def test_pfair_against_a_schedule_by_search():
    """Every slot goes to the released block of the earliest deadline, looked for among all sources in fractions."""
    weights, length = [0.5, 0.2, 0.2, 0.07, 0.03], 400
    shares = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    had, want = [0] * 5, []
    for t in range(length):
        ready = [(math.ceil((had[s] + 1) / w), s) for s, w in enumerate(shares) if math.floor(had[s] / w) <= t]
        want.append(min(ready)[1])
        had[want[-1]] += 1
    got = [0] * 2 * length
    for s, _, part in mixing.pfair(weights, had):
        for t in part:
            got[t] = s
    assert got[:length] == want


def test_mix_keeps_target_weights_over_a_long_run(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HELD", 5000)  # slots in several parts, and not broadcast
    df = spark.range(60_000).selectExpr("id AS doc_id", "cast(id % 20 AS string) AS source").unionByName(spark.createDataFrame([(60_000, "one")], "doc_id long, source string"))
    got = mixing.schedule(spark, df, block_docs=1).collect()
    assert {r.doc_id for r in got} == set(range(60_001)) and len({r.slot for r in got}) == len(got)
    target = {str(k): 3000 ** 0.8 for k in range(20)} | {"one": 1.0}
    total = sum(target.values())
    for source, weight in target.items():
        own = sorted(r.slot for r in got if r.source == source)
        assert all(abs(i + 1 - weight / total * (t + 1)) < 1.001 for i, t in enumerate(own))
        assert abs(len(own) - weight / total * len(got)) < 1.001
