import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import language_id, lm_scoring, toxicity

SYLLABLES = {"en": ["the", "ing", "ough", "and"], "de": ["sch", "ung", "ein", "ü"], "es": ["ción", "ado", "ñ", "que"]}


def made(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40))]
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), "vilescum")
        out.append((i, " ".join(words), lang, int(toxic)))
    return out


ODD = [(9001, None, None, None), (9002, "", None, None), (9003, "12 34 !", "en", None), (9004, "the ing " * 20_000, None, None), (9005, "Ω", None, None)]
SCHEMA = "doc_id long, text string, lang string, toxic int"


def test_language(spark):
    docs = made(300) + ODD
    got = {r.doc_id: r for r in language_id.language_id(spark, spark.createDataFrame(docs, SCHEMA).withColumnRenamed("toxic", "score"), per_language=60).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in made(300) if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert [got[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3
    assert got[9004].lang_pred == "en" and got[9005].lang_pred in SYLLABLES


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in language_id.language_id(spark, df).collect()] == [("und", 0.0)]
    assert language_id.language_id(spark, df.limit(0)).collect() == []


def test_kernel_is_the_share_of_common_ngrams():
    mark = np.zeros(2**language_id.BITS, bool)
    rows = [language_id.presence(t, mark) for t in ("abab", "xyz", "abc")]
    model = language_id.KernelModel(rows[:2], ["p", "q"], landmarks=2)
    want = [[len(np.intersect1d(r, s)) / math.sqrt(len(r) * len(s)) for s in rows[:2]] for r in rows]
    assert np.allclose(model.kernel(rows), want, atol=1e-6)
    assert np.allclose(model.kernel(rows, chunk=1), want, atol=1e-6)


def test_toxicity(spark):
    docs = made(900)
    df = spark.createDataFrame(docs + ODD, SCHEMA)
    labels = df.select("doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, df.drop("toxic"), labels.unionByName(labels.limit(5))).collect()}
    assert len(got) == len(docs) + len(ODD)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, y) for i, _, _, y in docs if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert got[9001].score == got[9002].score and not got[9004].predicted


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    assert [r.score for r in toxicity.toxicity(spark, df, df.select("doc_id", "toxic")).collect()] == [0.0]
    assert toxicity.toxicity(spark, df.limit(0), df.select("doc_id", "toxic").limit(0)).collect() == []


def test_windows_see_every_gram():
    text = "vilescum " * 50
    assert set(np.concatenate(list(toxicity.grams(text, window=7))).tolist()) == set(np.concatenate(list(toxicity.grams(text))).tolist())


def test_presence_windows_see_every_gram(monkeypatch):
    text = "".join(random.Random(3).choice("abcdefgh é") for _ in range(997))
    mark = np.zeros(2**language_id.BITS, bool)
    whole = language_id.presence(text, mark)
    for window in (1, 7, 990, 994):
        monkeypatch.setattr(language_id, "WINDOW", window)
        assert (language_id.presence(text, mark) == whole).all() and not mark.any()


def test_language_repeated_rows_and_ties(spark):
    docs = [(i, t, lang, 0) for i, (t, lang) in enumerate([("same text", "b"), ("same text", "a")] * 20)] + [(3, "same text", "a", 0)] * 2
    got = language_id.language_id(spark, spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == len(docs) and len({(r.lang_pred, r.score) for r in got}) == 1 and {r.chance for r in got} == {0.5}


def test_toxicity_with_contradictory_labels_and_clashing_columns(spark):
    docs = made(200)
    df = spark.createDataFrame(docs, SCHEMA).drop("toxic").withColumns({"score": F.lit("x"), "predicted": F.lit(9), "held_out": F.lit(None)})
    labels = spark.createDataFrame([(i, y) for i, _, _, y in docs] + [(i, 1 - y) for i, _, _, y in docs[:5]] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark, df.unionByName(df.limit(3)), labels).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 for r in got)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.score) == r.score


def lm_docs():
    out = made(120) + ODD
    return out + [(5000 + i, out[i][1], None, None) for i in range(0, 60, 2)] + [(None, "the ing and", None, None)]


def lm_tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def lm_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.mark.parametrize("how", [{}, {"part_bytes": 3000}, {"part_bytes": 3000, "fan_in": 3}])
def test_lm_against_plain_counts(spark, how):
    docs = lm_docs()
    df = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("toxic", "score").repartition(3)
    got = lm_scoring.lm_scoring(spark, df, **how).collect()
    assert len(got) == len(docs)
    counts = Counter(w for i, t, _, _ in docs if not lm_held(i) for w in lm_tokens(t))
    n, v = sum(counts.values()), len(counts)
    by_id = {i: t for i, t, _, _ in docs}
    for r in got:
        ws = lm_tokens(by_id[r.doc_id])
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, lm_held(r.doc_id))
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0
    mine = [r for r in got if r.held_out and (r.doc_id or 9999) < 9000]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def slow_restaurants(events, asked, discount, strength, base, sweeps, rng):
    """A Pitman-Yor hierarchy seated customer by customer. events: (contexts from the smallest, dish); each customer leaves
    and sits down again in every sweep. Returns the predictive probabilities of asked (contexts, dish), averaged."""
    rooms, levels = {}, len(discount)  # rooms: (level, context) -> {dish: sizes of its tables}

    def predict(level, contexts, dish):
        if level < 0:
            return base
        tables = rooms.get((level, contexts[level]), {})
        total = sum(map(sum, tables.values()))
        parent = predict(level - 1, contexts, dish)
        if not total:
            return parent
        d, s = discount[level], strength[level]
        own = tables.get(dish, [])
        return (sum(own) - d * len(own) + (s + d * sum(map(len, tables.values()))) * parent) / (s + total)

    def enter(level, contexts, dish):
        if level < 0:
            return
        room = rooms.setdefault((level, contexts[level]), {})
        own, d = room.setdefault(dish, []), discount[level]
        new = (strength[level] + d * sum(map(len, room.values()))) * predict(level - 1, contexts, dish)
        at = rng.random() * (sum(own) - d * len(own) + new)
        for k, size in enumerate(own):
            at -= size - d
            if at < 0:
                own[k] += 1
                return
        own.append(1)
        enter(level - 1, contexts, dish)

    def leave(level, contexts, dish):
        if level < 0:
            return
        own = rooms[(level, contexts[level])][dish]
        at = rng.random() * sum(own)
        for k, size in enumerate(own):
            at -= size
            if at < 0:
                break
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            leave(level - 1, contexts, dish)
        if not own:
            del rooms[(level, contexts[level])][dish]

    for contexts, dish in events:
        enter(levels - 1, contexts, dish)
    sums = Counter()
    for k in range(sweeps):
        for contexts, dish in events:
            leave(levels - 1, contexts, dish)
            enter(levels - 1, contexts, dish)
        if k >= sweeps // 2:
            for e in asked:
                sums[e] += predict(levels - 1, *e) / (sweeps - sweeps // 2)
    return sums


def test_lm_score_against_an_exact_sampler(spark):
    """The whole score against restaurants that seat one customer at a time, over a text small enough for that."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(4)) for _ in range(9)) for _ in range(11)]
    texts += texts[:3]  # with so many words a dish of a word context has one table
    docs = [(i, t) for i, t in enumerate(texts)]
    assert any(lm_held(i) for i, _ in docs)
    got = {r.doc_id: r.score for r in lm_scoring.lm_scoring(spark, spark.createDataFrame(docs, "doc_id long, text string"), burn=20, samples=80).collect()}
    n = lm_scoring.CONTEXT

    def byte_events(text):
        raw = b"\n" * n + lm_scoring.token_bytes(text)
        return [(tuple(raw[i - k : i] for k in range(n + 1)), raw[i]) for i in range(n, len(raw))]

    learn = [t for i, t in docs if not lm_held(i)]
    asked = sorted({e for _, t in docs for e in byte_events(t)})
    every = [e for t in learn for e in byte_events(t)]
    spelt = slow_restaurants(every, asked, lm_scoring.DISCOUNT, lm_scoring.STRENGTH, 1 / 256, 30, random.Random(1))
    counts, room = Counter(), Counter()
    where = lambda ws, i: (ws[i - 2] if i > 1 else b"\n", ws[i - 1] if i else b"\n")
    for t in learn:
        ws = lm_tokens(t)
        for i, w in enumerate(ws):
            counts[where(ws, i), w] += 1
            room[where(ws, i)] += 1
    rows = sorted(counts)
    d = lm_scoring.fitted_discount(lm_scoring.occurrences(np.array([counts[r] for r in rows], float), np.array([room[r[0]] for r in rows], float)))
    kinds = Counter(r[0] for r in rows)
    for i, t in docs:
        ws, events = lm_tokens(t), byte_events(t)
        want, place = 0.0, 0
        for k, w in enumerate(ws):
            size = len(w) + (w != b"\n")
            base = math.prod(spelt[e] for e in events[place : place + size])
            place += size
            u = where(ws, k)
            own = max(0.0, counts[u, w] - d * (counts[u, w] > 0))
            want += math.log10((own + d * kinds[u] * base) / room[u] if room[u] else base)
        assert abs(got[i] - want) < 0.03 * len(events), (i, got[i], want)


def test_tables_against_seating_one_by_one():
    rng = np.random.default_rng(0)
    for customers, base, others, d, s in ((2, 0.5, 1, 0.3, 1.0), (7, 0.1, 6, 0.5, 0.5), (40, 0.3, 9, 0.7, 2.0), (300, 0.01, 20, 0.9, 0.0)):
        fast = lm_scoring.tables(rng, np.full(4000, customers), np.full(4000, base), np.full(4000, others), d, s)
        t = np.ones(4000)
        for j in range(1, customers):
            mass = (s + d * (others + t)) * base
            t += rng.random(4000) < mass / (mass + j - d * t)
        assert abs(fast.mean() - t.mean()) < 5 * (t.std() + 1e-3) / math.sqrt(2000)
        assert abs(fast.std() - t.std()) < 0.12 * t.std() + 0.02


def test_lm_beats_its_base_on_held_out_documents(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the tables are not here")
    held = lm_scoring.lm_scoring(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_lm_long_text_null_ids_and_joined_documents(spark):
    docs = [(1, "the ing " * 60_000), (None, "x"), (None, None), (2, "one " * 3), (2, "one " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lm_scoring.lm_scoring(spark, df.join(spark.createDataFrame([(1,), (2,)], "doc_id long"), "doc_id", "left"), part_bytes=50_000).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 120_001), ("2", 4), ("2", 4), ("None", 1), ("None", 2)]
    assert len({(r.score, r.base_score) for r in got if r.doc_id == 2}) == 1


def test_lm_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", None, None)] * 2, SCHEMA)
    a, b = lm_scoring.lm_scoring(spark, df).collect()
    assert a == b
    assert lm_scoring.lm_scoring(spark, df.limit(0)).collect() == []


def test_predictions_sum_to_one():
    rng = np.random.default_rng(0)
    context = int.from_bytes(b"abcde", "big")
    seen = np.unique(np.array([(context << 8) | int(x) for x in rng.integers(97, 110, 8)] + [(context ^ 0xFF << 32) << 8 | 100], np.uint64))
    every = np.union1d(seen, np.array([(context << 8) | x for x in range(256)], np.uint64))
    counts = np.where(np.isin(every, seen), rng.integers(1, 40, len(every)), 0)
    top = np.full((256, 256), 1 / 256)
    model = lm_scoring.Restaurants(every, counts, 1)
    for _ in range(4):
        model.sweep(top)
    p = model.predict(top)[(every >> np.uint64(8)) == context]
    assert len(p) == 256 and abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_seating_bounds():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 15, 16, 17, 1000, 100_000, 10**9])
    t = lm_scoring.tables(rng, c, np.full(9, 0.01), np.full(9, 10.0), 0.5, 1.0)
    assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0


def test_sampled_top_is_a_distribution():
    shared = np.zeros((256, 256))
    shared[97, 98:110] = 5
    assert np.allclose(lm_scoring.sampled_top(shared, 8, 2).sum(axis=1), 1)
