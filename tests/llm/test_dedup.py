import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import embedding_dedup, exact_dedup, near_dedup
from quirefold.llm.common import Scratch, components
from quirefold.llm.shingles import shingle_set

DOCS = "doc_id long, text string, kept string"  # kept clashes with an output column


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


TEXTS = [(1, "Abc", "x"), (2, "aBC", "x"), (3, "Äbc", "x"), (4, "äbc", "x"), (5, None, "x"), (6, "", "x"), (7, "z" * 100_000, "x"), (7, "z" * 100_000, "x"), (None, "abc", "x"), (8, "lone", None)]


@pytest.mark.parametrize("how", [{}, {"key_bits": 1}, {"key_bits": 1, "digest": lambda t: F.lit("ab")}, {"capacity": 1}, {"broadcast_rows": 0}])
def test_exact(spark, how):
    got = exact_dedup.exact_dedup(spark, spark.createDataFrame(TEXTS, DOCS), **how).collect()
    assert len(got) == len(TEXTS)
    groups = {}
    for i, t, _ in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    want = sorted((str(i), str(max(x for x in groups[lower(t)] if x is not None)), len(groups[lower(t)])) for i, t, _ in TEXTS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    if "digest" not in how:
        assert {r.text_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256("Äbc".encode()).hexdigest()}


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(spark, spark.createDataFrame([], DOCS)).collect() == []


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    slots, depth = exact_dedup.directory(keys, 4000, 300)
    with_slot = keys.withColumn("slot", F.shiftrightunsigned("key", 64 - depth)).join(slots, "slot")
    sizes = [r["count"] for r in with_slot.groupBy("bucket").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 300


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (200, 9)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(spark, df, Scratch(spark, "t")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = brute_components({x for e in edges for x in e}, edges)
    assert got == want


def corpus(n_groups=6, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    out = []
    for g in range(n_groups):
        base = [word() for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(rng.choice([1, 3, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += ["one two", "One  two\n", "one", "", None, " \t", "x y z " * 4000]
    return [(i, t, "c") for i, t in enumerate(out)]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_against_brute_force(spark, words, percent):
    docs = corpus()
    sets = {i: set(shingle_set(t, words).tolist()) for i, t, _ in docs}
    plain = {}
    for i, t, _ in docs:  # the hashed sets count as the plain ones do
        w = (t or "").encode().lower().split()
        plain[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        assert len(plain[i]) == len(sets[i])
    linked = [(a, b) for a, b in itertools.combinations(plain, 2) if plain[a] and plain[b] and 100 * len(plain[a] & plain[b]) >= percent * len(plain[a] | plain[b])]
    want = brute_components(plain, linked)
    got = rows(near_dedup.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string, component_id string"), words, percent), "doc_id")
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(plain[i]) for i, r in got.items())


def test_near_empty_and_without_id(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_dedup(spark, spark.createDataFrame([], schema)).collect() == []
    got = near_dedup.near_dedup(spark, spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "other")], schema)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


def test_index_keys_meet_within_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (200, near_dedup.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dedup.HASHES, near_dedup.DISTANCE, replace=False)
        row[at] += 1
    assert (near_dedup.index_keys(a) == near_dedup.index_keys(b)).any(axis=1).all()


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((5, 16))
    vectors = [(centre[k % 5] + 0.25 * rng.standard_normal(16)).tolist() for k in range(200)]
    vectors += [vectors[3], vectors[3], [0.0] * 16, None, [float("nan")] * 16, [1.0] * 8, [1.0] * 8, [None] * 16, [1e300] * 16]
    data = list(enumerate(vectors))
    ok = {i: np.array(v) / np.abs(v).max() for i, v in data if v and None not in v and np.isfinite(v).all() and any(v)}
    ok = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    linked = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9]
    want = brute_components(range(len(data)), linked)
    got = rows(embedding_dedup.embedding_dedup(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>"), block=16), "vec_id")
    assert {i: r["component_id"] for i, r in got.items()} == want
    count = {i: sum(i in e for e in linked) for i in want}
    assert {i: r["n_links"] for i, r in got.items()} == count


def test_embeddings_empty(spark):
    assert embedding_dedup.embedding_dedup(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_near_link_behind_other_members_of_a_bucket(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 2**15, (4, near_dedup.HASHES)).astype(np.uint16)  # L, A, B, C
    sig[:, near_dedup.PARTS[0]] = 7  # all four share the buckets of one chunk, and no other
    sig[3] = sig[1]
    for part in near_dedup.PARTS[1:]:
        sig[3, part[:2]] += 2**15
    assert (sig[1] != sig[3]).sum() == near_dedup.DISTANCE - 1
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(f"l{k}" for k in range(60)), " ".join(words), " ".join(f"b{k}" for k in range(60)), " ".join(words + ["end"])]
    rows = [(i, len(shingle_set(t, 3)), bytes([i]), sig[i].tobytes()) for i, t in enumerate(texts)]
    monkeypatch.setattr(near_dedup, "sketch", lambda docs, words: spark.createDataFrame(rows, "doc_id long, n_shingles long, print binary, sig binary").coalesce(1))
    got = near_dedup.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=3, percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("percent", [85, 80, 75, 70])
def test_near_chunks_follow_percent(percent):
    chunks = near_dedup.chunks_for(percent)
    tail = sum(math.comb(near_dedup.HASHES, k) * (1 - percent / 100) ** k * (percent / 100) ** (near_dedup.HASHES - k) for k in range(2 * chunks, near_dedup.HASHES + 1))
    assert tail <= near_dedup.MISS
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**15, (100, near_dedup.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.HASHES, 2 * chunks - 1, replace=False)] += 2**15
    assert (near_dedup.index_keys(a, chunks) == near_dedup.index_keys(b, chunks)).any(axis=1).all()


@pytest.mark.parametrize("members", [2, 3, 20])
def test_near_confirms_candidates_of_any_distance(spark, monkeypatch, members):
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 2**16, (members, near_dedup.HASHES)).astype(np.uint16)
    sig[:, :4] = 7  # one shared chunk and nothing else
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words)] + [" ".join(f"{i}x{k}" for k in range(60)) for i in range(members - 2)] + [" ".join(words + ["end"])]
    rows = [(i, len(shingle_set(t, 5)), bytes([i]), sig[i].tobytes()) for i, t in enumerate(texts)]
    monkeypatch.setattr(near_dedup, "sketch", lambda docs, words: spark.createDataFrame(rows, "doc_id long, n_shingles long, print binary, sig binary").coalesce(1))
    got = near_dedup.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=5, percent=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i for i in range(members - 1)} | {members - 1: 0}


def test_near_large_buckets_in_blocks(spark, monkeypatch):
    """Crowds that share a passage: buckets of several components, compared in several blocks of a cluster."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage, docs = [word() for _ in range(60)], []
    for g in range(12):
        own = [word() for _ in range(25)]
        for _ in range(4):
            text = passage + own
            text[60 + rng.randrange(25)] = word()
            docs.append((len(docs), " ".join(text)))
    docs += [(5, docs[5][1])] * 2
    sets = {i: set(shingle_set(t, 3).tolist()) for i, t in docs}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    used = []
    inner = near_dedup.large_bucket_links
    monkeypatch.setattr(near_dedup, "large_bucket_links", lambda *a, **k: used.append(1) or inner(*a, **k))
    got = near_dedup.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), 3, 85, large=3, block_rows=7).collect()
    assert used and len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == brute_components(sets, linked)


@pytest.mark.parametrize("task_edges", [60, 50_000])
def test_components_of_hubs_and_chains(spark, task_edges):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(400)] + [(5000 - i, 4999 - i) for i in range(200)]
    edges += [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(260)] + [(299, 1400)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.id: r.component for r in components(spark, df, Scratch(spark, "t"), hub_edges=20, task_edges=task_edges).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == brute_components({x for e in edges for x in e}, edges)


def test_embeddings_of_floats_with_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((4, 24))
    data = [(i, (centre[i % 4] + 0.2 * rng.standard_normal(24)).astype(np.float32).tolist(), 9, "x") for i in range(60)]
    data += [(3, data[3][1], 9, "x"), (None, data[4][1], 9, "x"), (None, None, 9, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n_links int, kept string")
    got = embedding_dedup.embedding_dedup(spark, df, block=8).collect()
    unit = {i: np.array(v, np.float32).astype(float) for i, v, *_ in data if i is not None}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    linked = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a] @ unit[b] >= 0.9]
    assert linked and len(got) == len(data)
    want = brute_components(unit, linked)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (sum(r.vec_id in e for e in linked), want[r.vec_id], want[r.vec_id] == r.vec_id)
