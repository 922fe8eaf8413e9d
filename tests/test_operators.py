"""Operators that SQL cannot express, against plain Python, and readers and writers of files."""
import difflib
import io
import itertools
import json
import math
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.functions import images as IM
from quirefold.functions import text as T
from quirefold.operators import curation as C
from quirefold.operators import evaluation as E
from quirefold.operators import layout as L
from quirefold.operators import memory as MEM
from quirefold.operators import metrics as M
from quirefold.operators import pages as P
from quirefold.operators import reconcile as RC
from quirefold.operators import review as R
from quirefold.operators import sampling as S
from quirefold.sources import documents as SRC
from quirefold.sources import sinks as SNK
from quirefold.streaming import admission as A

RNG = np.random.default_rng(3)


# images


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (20, 31, 3)])
def test_png_round_trip(shape):
    image = RNG.integers(0, 256, shape, dtype=np.uint8)
    assert (IM.decode(IM.encode_png(image)) == image).all()


def test_png_filters():
    image = RNG.integers(0, 256, (9, 6, 3), dtype=np.uint8)
    raw = image.reshape(9, -1).astype(int)
    rows, kinds = np.zeros_like(raw), np.arange(9) % 5

    def paeth(a, b, c):
        p = a + b - c
        return min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]

    for y in range(9):
        for x in range(18):
            a, b, c = raw[y][x - 3] if x >= 3 else 0, raw[y - 1][x] if y else 0, raw[y - 1][x - 3] if y and x >= 3 else 0
            rows[y][x] = (raw[y][x] - (0, a, b, (a + b) // 2, paeth(a, b, c))[kinds[y]]) % 256
    body = np.concatenate([kinds[:, None], rows], axis=1).astype(np.uint8).tobytes()
    png = IM.encode_png(image)
    at = png.index(b"IDAT") - 4
    packed = zlib.compress(body)
    chunk = len(packed).to_bytes(4, "big") + b"IDAT" + packed + zlib.crc32(b"IDAT" + packed).to_bytes(4, "big")
    assert (IM.decode(png[:at] + chunk) == image).all()


@pytest.mark.parametrize("content", [None, b"", b"P5 nonsense", IM.PNG + b"xxxx", b"%PDF", IM.encode_png(np.zeros((3, 3)))[:40]])
def test_unreadable_images(content):
    assert IM.decode(content) is None


def test_pgm_and_sizes(spark):
    assert IM.decode(b"P5\n# c\n3 2\n255\n" + bytes(range(6))).tolist() == [[0, 1, 2], [3, 4, 5]]
    bmp = b"BM" + bytes(16) + (300).to_bytes(4, "little") + (7).to_bytes(4, "little")
    gif = b"GIF89a" + (5).to_bytes(2, "little") + (260).to_bytes(2, "little")
    df = spark.createDataFrame([(1, bytearray(IM.encode_png(np.zeros((4, 9))))), (2, bytearray(bmp)), (3, bytearray(gif)), (4, bytearray(b"no"))], "i int, content binary")
    got = [r.s and tuple(r.s) for r in df.orderBy("i").select(IM.image_size(F.col("content")).alias("s")).collect()]
    assert got == [(9, 4), (300, 7), (5, 260), None]


def test_measures():
    a = RNG.integers(0, 256, (30, 40), dtype=np.uint8)
    b = np.clip(a.astype(int) + RNG.integers(-9, 10, a.shape), 0, 255).astype(np.uint8)
    assert IM.psnr(a, a) == math.inf and IM.ssim(a, a) == pytest.approx(1)
    assert IM.psnr(a, b) == pytest.approx(10 * math.log10(255**2 / np.mean((a.astype(float) - b) ** 2)))
    mask = np.zeros(a.shape, np.uint8)
    assert IM.psnr(a, b, mask) == math.inf and IM.ssim(a, b, mask) == 1
    mask[:5] = 255
    assert IM.psnr(a, b, mask) == pytest.approx(10 * math.log10(255**2 / np.mean((a[:5].astype(float) - b[:5]) ** 2)))
    y, x = 12, 17  # one window by hand
    p, q = (z[y - 3 : y + 4, x - 3 : x + 4].astype(float).ravel() for z in (a, b))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    want = (2 * p.mean() * q.mean() + c1) * (2 * np.cov(p, q)[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (p.var(ddof=1) + q.var(ddof=1) + c2))
    assert IM.ssim_map(a, b)[y, x] == pytest.approx(want)
    assert IM.ssim(np.stack([a] * 3, 2), np.stack([b] * 3, 2)) == pytest.approx(IM.ssim(a, b))


def test_sizes_lines_and_paper():
    image = np.full((100, 50), 7, np.uint8)
    small, f = IM.fitted(image, 20)
    assert small.shape == (20, 10) and f == 0.2 and (small == 7).all() and IM.fitted(image, 0)[1] == 1.0
    assert IM.resized(np.array([[0, 100]], np.uint8), 1, 1).item() == 50
    line = IM.line_image(np.zeros((10, 20), np.uint8))
    assert line.shape == (32, 256) and (line[:, :64] == 0).all() and (line[:, 64:] == 255).all()
    page = np.full((40, 40, 3), (210, 190, 160), np.uint8)
    page[5:9] = 20
    assert IM.looks_printed_long_ago(page) and not IM.looks_printed_long_ago(np.where(page > 100, 250, 20).astype(np.uint8)) and not IM.looks_printed_long_ago(None)


def test_otsu_is_the_best_threshold():
    image = np.concatenate([RNG.normal(60, 9, 500), RNG.normal(190, 15, 700)]).clip(0, 255).astype(np.uint8)

    def between(t):
        lo, hi = image[image <= t], image[image > t]
        return len(lo) * len(hi) * (lo.mean() - hi.mean()) ** 2 if len(lo) and len(hi) else 0

    assert between(IM.otsu(image)) == max(map(between, range(256)))


def test_skew():
    page = np.full((240, 300), 255, np.uint8)
    for y in range(30, 210, 20):
        page[y : y + 8, 30:270] = 0
    assert IM.skew(page) == 0
    for angle in (3.0, -5.0):
        assert abs(IM.skew(IM.turned(page, angle, 255)) + angle) <= 0.5


def test_outlines_and_coverage():
    drawn = IM.outlined(np.zeros((20, 30), np.uint8), [(5, 5, 15, 12)], [(255, 0, 0)])
    assert drawn.shape == (20, 30, 3) and drawn[5, 5].tolist() == [255, 0, 0] and drawn[8, 8].tolist() == [0, 0, 0]
    truth = np.array([(0, 0, 100, 50), (200, 0, 300, 50), (0, 100, 100, 150)])
    assert IM.covered(truth, np.array([(0, 0, 60, 50), (200, 0, 240, 50)])) == pytest.approx(1 / 3)


def test_beam_is_the_best_text_over_all_alignments():
    for seed in range(5):
        p = np.log(np.random.default_rng(seed).dirichlet(np.ones(3), 5))
        total = {}
        for path in itertools.product(range(3), repeat=5):
            text = "".join("ab"[k - 1] for k, before in zip(path, (0, *path)) if k and k != before)
            text = "".join("ab"[k - 1] for i, k in enumerate(path) if k and (i == 0 or path[i - 1] != k))
            total[text] = np.logaddexp(total.get(text, -math.inf), sum(p[i, k] for i, k in enumerate(path)))
        assert IM.beam_decode(p, "ab", 50) == max(total, key=total.get)


# engines and pages


def test_engines():
    assert P.engine("ink") is P.engine("ink") and P.chosen(None, "ink") == "ink" and P.chosen(None, "gone") == "ink"
    for call in (lambda: P.engine("none"), lambda: P.chosen("none", "ink")):
        with pytest.raises(ValueError, match="none"):
            call()


class Broken:
    granularity = "word"

    def run(self, image):
        if image[0, 0] == 1:
            raise RuntimeError("bad page")
        return [("7", 50.0, 0, 0, 4, 4), ("x", 90.0, 5, 0, 9, 4)]

    def crop(self, image):
        return "8", 70.0


def test_pipeline_with_failures_and_a_second_read(spark):
    P.register("broken", Broken)
    images = [np.zeros((8, 12), np.uint8), np.ones((8, 12), np.uint8)]
    files = spark.createDataFrame([(k, bytearray(IM.encode_png(x))) for k, x in enumerate(images)] + [(2, bytearray(b"?"))], "page long, content binary")
    read = {(r.page, r.pos): r for r in P.scanned(files, "broken", make=Broken).collect()}
    assert read[0, 0].text == "7" and read[0, 0].width == 12 and read[1, None].error.startswith("failed: bad page") and read[2, None].error == "unreadable"
    tokens = P.document_pages(files.where("page = 0"), "broken", "page", repass=True).orderBy("pos").collect()
    assert [(r.text, r.flags, r.alt_text, r.read_pos) for r in tokens] == [("7", ["low_conf", "digit_uncertain", "digit_conflict"], "8", 0), ("x", [], None, 1)]
    assert P.sideways(np.array([[1, 2]]), 90).tolist() == [[1], [2]] and P.sideways(np.array([[1, 2]]), 180).tolist() == [[1, 2]]


# reconciling


def test_reconciled_pages(spark):
    rows = []
    for k in range(5):
        rows.append((1, k, f"2075-0{k + 1}-11", 10, 40 * k, 110, []))
    rows.append((1, 5, "2015-06-11", 12, 200, 112, ["2075-06-11", "2076-06-11"]))  # the year of its column
    rows.append((1, 6, "2015-07-11", 11, 240, 111, ["2075-07-11", "2075-07-12"]))  # two readings fit: neither
    rows += [(2, k, f"12-{500 + k}", 0, 40 * k, 60, []) for k in range(6)] + [(2, 6, "17-506", 0, 240, 60, ["12-506", "12-507"]), (2, 7, "17 500", 300, 0, 360, ["12 500"])]
    rows += [(3, k, f"2075-02-1{k}", 0, 40 * k, 60, ["2070-02-11"]) for k in range(3)] + [(3, 3, "x", 0, 0, 9, [])]
    df = spark.createDataFrame(rows, "doc_id long, pos long, text string, x0 int, y0 int, x1 int, candidates array<string>")
    got = sorted(map(tuple, RC.reconciled(df).select("doc_id", "pos", "suggestion", "why", "flagged").collect()))
    assert got == [(1, 5, "2075-06-11", "date", True), (2, 6, "12-506", "prefix", True)]


def test_reconciled_ties_by_repeats_and_separators():
    read = lambda t, d, seps=("-",): {"text": t, "digits": d, "date": None, "groups": [], "seps": list(seps)}
    from collections import Counter

    cluster = [{"own": read("a", "1")} for _ in range(4)]
    picks = [read("12-3", "123"), read("12.3", "1203", (".",))]
    assert RC.settled(picks, cluster, Counter()) is picks[0]
    mixed = [{"own": read("a", "1", s)} for s in (("-",), (".",), ("/",), (":",))]
    assert RC.settled(picks, mixed, Counter({"1203": 2})) is picks[1] and RC.settled(picks, mixed, Counter({"1203": 1})) is None


# evaluation


def test_token_diff_against_opcodes(spark):
    rng = random.Random(1)
    pairs = []
    for k in range(40):
        a = [rng.choice(("ab", "cd", "x1", "ef", "12")) for _ in range(rng.randint(0, 9))]
        b = [w if rng.random() < 0.7 else rng.choice(("ba", "cd", "x2", "zz")) for w in a if rng.random() < 0.9]
        pairs.append((k, " ".join(a), " ".join(b)))
    diffs = E.token_diff(spark.createDataFrame(pairs, "k long, gt string, hyp string"), ["k"])
    got = {r.k: r.asDict() for r in E.diff_kinds(diffs, ["k"]).collect()}
    for k, a, b in pairs:
        a, b, want = a.split(), b.split(), dict.fromkeys(E.KINDS, 0)
        for op, i, j, m, n in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
            if op == "delete":
                want["missing"] += j - i
            elif op == "insert":
                want["invented"] += n - m
            elif op == "replace" and j - i == n - m == 1:
                g, h = a[i], b[m]
                digits = lambda t: "".join(c for c in t if c.isdigit())
                if digits(g) != digits(h):
                    want["digit"] += 1
                elif sorted(g) == sorted(h):
                    want["order"] += 1
                elif not set(g) & set(h):
                    want["missing"] += 1
                    want["invented"] += 1
                else:
                    want["other"] += 1
            elif op == "replace":
                want["segmentation"] += 1
        assert {c: got.get(k, dict.fromkeys(E.KINDS, 0))[c] for c in E.KINDS} == want


def test_arms():
    assert E.arms(["raw", "photo"], ["a"]) == [("raw", "a")] and E.arms(["photo"], ["a"], True) == [("photo", "a")]


def test_bins_are_those_of_a_split_of_all_rows(spark):
    rng = random.Random(2)
    rows = [("g" if rng.random() < 0.7 else "h", float(rng.randint(0, 9)), k, rng.random() < 0.5) for k in range(137)]
    got = {(r.g, r.bin): (r.x, r.y, r.n) for r in M.equal_count_bins(spark.createDataFrame(rows, "g string, conf double, k long, ok boolean"), 20, ["g"], ["conf", "k"]).collect()}
    for g in "gh":
        own = sorted(r[1:] for r in rows if r[0] == g)
        for b, place in enumerate(np.array_split(np.arange(len(own)), 20), 1):
            part = [own[i] for i in place]
            if part:
                x, y, n = got[g, b]
                assert n == len(part) and x == pytest.approx(np.mean([p[0] / 100 for p in part])) and y == pytest.approx(np.mean([p[2] for p in part]))


def test_lines_are_all_right_or_all_wrong(spark):
    tokens = spark.createDataFrame([(1, 0, "a b", "line", ["x"]), (1, 1, "a 9", "line", []), (1, 2, "a", "line", []), (1, 3, "zz q", "word", ["x"])], "doc_id long, pos long, text string, granularity string, flags array<string>")
    truth = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, t string")
    (r,) = M.token_stats(M.line_words(tokens, truth, ["doc_id"]), ["doc_id"]).collect()
    assert (r.total, r.errors, r.flagged, r.flagged_errors, r.flagged_correct, r.digit_total, r.digit_errors) == (6, 3, 3, 1, 2, 2, 2)


# memory


def test_word_suggestions_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 6)))
    known = sorted({word() for _ in range(60)})
    index = [(w, rng.randint(1, 5), rng.randint(0, 2), rng.randint(0, 2)) for w in known]
    words, lexicon = [(k, word()) for k in range(80)], [word() for _ in range(10)]
    got = {r.id: (r.suggestion, r["count"]) for r in MEM.suggest_words(spark.createDataFrame(words, "id long, word string"), spark.createDataFrame(index, "word string, count long, accepted long, rejected long"), spark.createDataFrame([(w,) for w in lexicon], "word string")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    usable = lambda a, r: r <= a and (a + r < 2 or a / (a + r) >= 0.5)
    want = {}
    for k, w in words:
        if len(w) >= 4 and w not in lexicon:
            fit = [(-n, c) for c, n, a, r in index if c != w and c[0] == w[0] and edits(w, c) <= 1 and usable(a, r)]
            if fit:
                want[k] = (min(fit)[1], -min(fit)[0])
    assert got == want and want


def test_value_suggestions_in_order_of_learning(spark):
    index = [("1234", "A", 1, 0, 3, 1), ("1234", "B", 2, 0, 0, 9), ("1235", "C", 5, 0, 0, 4), ("9999", "D", 1, 0, 1, 5)]
    df = spark.createDataFrame(index, "value string, corrected string, count long, accepted long, rejected long, first_seq long")
    asked = spark.createDataFrame([(1, "1234"), (2, "1236"), (3, "9999"), (4, "123"), (5, "9998")], "id long, digits string")
    got = {r.id: (r.suggestion, r.exact) for r in MEM.suggest_values(asked, df).collect()}
    assert got == {1: ("B", True), 2: ("B", False)}  # 1234 was learned first, though A is not usable any more


def test_line_suggestions_against_a_loop(spark):
    index = [("f", "12", "new 12", "old 12", 1, 0, 0, 1), ("f", "13", "new 13", "old 13", 3, 0, 0, 2), ("f", "14", "new 14", "old 14", 3, 0, 0, 3), ("g", "12", "other", "old 12", 9, 0, 0, 4), ("f", "22", "bad", "old 22", 9, 0, 1, 5)]
    df = spark.createDataFrame(index, "key string, digits string, text string, original string, count long, accepted long, rejected long, first_seq long")
    asked = spark.createDataFrame([(1, "f", "OLD  12"), (2, "f", "old 15"), (3, "f", "old 22"), (4, "f", "very old 12"), (5, "h", "old 12")], "id long, key string, text string")
    got = {r.id: (r.suggestion, r.exact) for r in MEM.suggest_lines(asked, df).collect()}
    assert got == {1: ("new 12", True), 2: ("new 13", False), 3: ("new 12", False)}


def test_replay_asks_before_it_learns(spark):
    queue = spark.createDataFrame([(0, 1, "1234", "1235"), (1, 2, "1234", "1235"), (1, 3, "7777", "7778"), (2, 4, "7777", "0")], "session long, id long, text string, target string")
    log = queue.selectExpr("session", "id AS seq", "text AS original", "target AS corrected", "'value' AS kind")

    def suggest(rows, known):
        return rows.join(known.groupBy(F.col("original").alias("text")).agg(F.max_by("corrected", "seq").alias("suggestion")), "text").select("id", "suggestion")

    found = MEM.replay(queue, log, [0, 1, 2], {"value": suggest})
    assert sorted((r.session, r.id, r.suggestion) for r in found.collect()) == [(1, 2, "1235"), (2, 4, "7778")]
    got = {r.channel: (r.suggested, r.hits, r.coverage, r.precision) for r in MEM.replay_summary(queue, found).collect()}
    assert got == {"value": (2, 1, 0.5, 0.5), "combined": (2, 1, 0.5, 0.5)}
    chips = spark.createDataFrame([(1, "word", "c"), (1, "line", "a"), (1, "value", "a"), (2, "word", "d")], "id long, channel string, suggestion string")
    assert {r.id: r.chips for r in MEM.chips(spark.range(1, 4).toDF("id"), chips).collect()} == {1: ["a", "c"], 2: ["d"], 3: []}
    df = spark.createDataFrame([("a 12 b 12", "12", "13"), ("x", "9", "1")], "t string, r string, v string")
    assert [r.o for r in df.select(MEM.substituted(F.col("t"), F.col("r"), F.col("v")).alias("o")).collect()] == ["a 13 b 12", None]


# admission


def test_admission_charges_earlier_stages():
    gate = A.Admission(window=10, most=2, client_pages=5, all_pages=6, runs=3, workers=1)
    assert gate.check("a", 0, 3, 5) == "admitted"
    assert gate.check("b", 1, 2, 5) == "busy"  # its pages and its run are charged
    assert gate.check("b", 6, 2, 5) == "all_pages"  # 3 + 2 are used, and b's own pages are charged once more
    assert gate.check("b", 7, 1, 5) == "rate"
    assert gate.check("c", 8, 1, 5) == "admitted"
    assert gate.check("d", 20, 1, 5) == "all_pages"
    assert gate.check("d", 86400, 1, 5) == "admitted"


def test_admission_of_sites_by_themselves(spark):
    rng = random.Random(6)
    rows = [(k % 3, k, rng.randint(0, 4), float(rng.randint(0, 200_000)), rng.randint(1, 3), 3000.0) for k in range(400)]
    how = dict(window=600.0, most=2, client_pages=9, all_pages=40, runs=25, workers=2)
    got = {r.event_id: r.verdict for r in A.admission(spark.createDataFrame(rows, "site long, event_id long, client long, t double, pages int, seconds double"), **how).collect()}
    for site in range(3):
        gate = A.Admission(**how)
        for _, k, client, t, pages, seconds in sorted((r for r in rows if r[0] == site), key=lambda r: (r[3], r[1])):
            assert got[k] == gate.check(client, t, pages, seconds)
    assert len(set(got.values())) >= 4


def test_resume_does_each_row_once(spark, tmp_path):
    inputs = spark.range(23).toDF("id")
    path, calls = f"{tmp_path}/out", []

    def work(rows):
        calls.append(rows.count())
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return rows.withColumn("x", F.col("id") * 2)

    with pytest.raises(RuntimeError):
        A.resume(spark, inputs, path, "id", work, 10)
    assert A.resume(spark, inputs, path, "id", work, 10) == 2
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(23)) and calls == [10, 10, 10, 3]


def test_log_fold_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "seq long, word string").write.json(f"{tmp_path}/in")
    for _ in range(2):  # what was read before isn't read again
        A.fold_log(spark.readStream.schema("seq long, word string").json(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.word for r in spark.read.parquet(f"{tmp_path}/log").collect()) == ["a", "b"]


# sets, samples, plans


@pytest.mark.parametrize(("n", "share"), [(1, 0.05), (19, 0.05), (1000, 0.05), (777, 0.2)])
def test_split_is_exact(spark, n, share):
    got = S.split(spark.range(n).toDF("k"), "k", share)
    part = {r.part: r["count"] for r in got.groupBy("part").count().collect()}
    val = max(1, int(n * share))
    assert part == {k: v for k, v in (("val", val), ("train", n - val)) if v} and got.columns == ["k", "part"]


def test_plan_of_a_dataset(spark):
    rows = [(d, p, "" if p == 1 else "x") for d in "ba" for p in range(4)]
    got = C.dataset_plan(spark.createDataFrame(rows, "doc string, page int, text string"), ["l", "h"], per_doc=2, total=3, seed=7).orderBy("seed").collect()
    assert [(r.doc, r.page, r.level, r.seed) for r in got] == [("a", 0, "l", 7), ("a", 2, "h", 8), ("b", 0, "l", 9)]
    real = C.dataset_plan(spark.createDataFrame(rows, "doc string, page int, text string"), [], degrade=False).collect()
    assert len(real) == 6 and {r.level for r in real} == {"real"}


def test_seed_of_a_page(spark):
    df = spark.createDataFrame([("p1", 3, "12")], "doc_id string, pos long, text string")
    (r,) = C.digit_crops(df, 5, seed=42).collect()
    assert (r.crop_id, r.seed) == ("p1_c03", (42 + zlib.crc32(b"p1")) & 0x7FFFFFFF)


def test_words_to_learn_need_a_lexicon(spark):
    texts, none = spark.createDataFrame([("abcd efgh abcd xyz",)], "text string"), spark.createDataFrame([], "word string")
    words = F.split("text", " ")
    assert C.words_to_learn(texts, none, words).collect() == []
    assert [r.word for r in C.words_to_learn(texts, spark.createDataFrame([("efgh",)], "word string"), words).collect()] == ["abcd"]


def test_encoding_of_characters(spark):
    df = spark.createDataFrame([("cab!",)], "t string")
    assert df.select(T.encoded(F.col("t"), F.lit("abc")).alias("x")).first().x == [3, 1, 2]


# readers and writers


def test_inputs_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.PDF", "a.png", "x.txt", "deep/c.png"):
        (tmp_path / name).write_bytes(b"1")
    names = lambda **k: [r.path.split("/")[-1] for r in SRC.list_inputs(spark, str(tmp_path), (".pdf", ".png"), **k).collect()]
    assert names() == ["a.png", "b.PDF"] and names(recursive=True) == ["a.png", "b.PDF", "c.png"]
    assert [r.path.split("/")[-1] for r in SRC.list_inputs(spark, str(tmp_path / "x.txt"), (".pdf",)).collect()] == ["x.txt"]


@pytest.mark.parametrize(("text", "why"), [("3", "line 1: expected"), ("# c\nx\tchanged\ta", "line 2: bad index"), ("3\todd", "line 1: bad action")])
def test_edits_name_the_line(spark, text, why):
    with pytest.raises(Exception, match=why):
        SRC.edits_tsv(spark.createDataFrame([(text,)], "content string")).collect()


def test_edits_outside_the_queue(spark):
    queue = spark.createDataFrame([(1, 3, "old", 0, 0, 9, 9)], "s long, index int, text string, x0 int, y0 int, x1 int, y1 int")
    edits = lambda k: spark.createDataFrame([(1, 8, k, "changed", "new")], "s long, line long, index int, action string, text string")
    assert [(r.original, r.corrected, r.x1) for r in R.compose(edits(3), queue, ["s"]).collect()] == [("old", "new", 9)]
    with pytest.raises(Exception, match="line 8: index 4 is not in the queue"):
        R.compose(edits(4), queue, ["s"]).collect()


def test_wrong_bytes_and_plain_text(spark):
    files = spark.createDataFrame([(1, bytearray(b"a\xff\nb\n")), (2, bytearray(b"")), (3, None)], "i long, content binary")
    got = sorted((r.i, r.line, r.text) for r in SRC.unpacked_lines(files).collect())
    assert got == [(1, 0, "a�"), (1, 1, "b")]


def test_npz_and_labels(spark):
    lines = spark.createDataFrame([("g", k, bytearray(bytes([k] * 6)), 2, 3, f"t{k}") for k in range(3)], "g string, row long, image binary, height int, width int, text string")
    packed = SNK.npz_file(lines, "g")
    with np.load(io.BytesIO(packed.first().content)) as z:
        assert z["images"].shape == (3, 2, 3) and z["texts"].tolist() == ["t0", "t1", "t2"]
    assert sorted((r.row, bytes(r.image), r.text) for r in SRC.npz_rows(packed).collect()) == [(k, bytes([k] * 6), f"t{k}") for k in range(3)]
    labels = lines.select("g", F.concat("text", F.lit(".png")).alias("file"), "text", F.when(F.col("row") > 0, F.col("image")).alias("image"))
    with zipfile.ZipFile(io.BytesIO(SNK.labels_zip(labels, "g").first().content)) as z:
        assert z.namelist() == ["labels.tsv", "crops/t1.png", "crops/t2.png"] and z.read("labels.tsv") == b"t0.png\tt0\nt1.png\tt1\nt2.png\tt2\n"


def test_download_is_whole_or_absent(tmp_path):
    path, tries = tmp_path / "f", []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("down")
        return io.BytesIO(b"x" * 5000)

    assert SRC.download(flaky, "u", str(path), retries=3, chunk=1024) == 5000 and path.read_bytes() == b"x" * 5000
    tries.clear()
    with pytest.raises(OSError, match="down"):
        SRC.download(flaky, "u", str(tmp_path / "g"), retries=2)
    assert [p.name for p in tmp_path.iterdir()] == ["f"]


def test_strips():
    assert SRC.strips(100, 1) == [(0, 100)] and SRC.strips(101, 2, 10) == [(0, 60), (50, 101), (100, 101)]


def test_bundle_and_log(spark, tmp_path):
    tokens = spark.createDataFrame([(1, 0, "a|b", 50.0, 0, 0, 5, 5, ["low_conf"], "c"), (1, 1, "", 99.0, 6, 0, 9, 5, [], None)], "doc_id long, pos long, text string, conf double, x0 int, y0 int, x1 int, y1 int, flags array<string>, alt_text string")
    out = SNK.export_bundle(tokens, str(tmp_path / "out"), "engine", txt=False)
    assert sorted(out) == ["json", "md"]
    j = json.loads(spark.read.parquet(out["json"]).first().json)
    assert j["review"] == [{"index": 0, "text": "a|b", "bbox": [0, 0, 5, 5], "conf": 50.0, "risk": 1.5, "flags": ["low_conf"], "alt_text": "c"}] and len(j["tokens"]) == 2
    md = spark.read.parquet(out["md"]).first().text
    assert md.startswith("*engine · 2 tokens · 1 low-confidence · 0 digit conflicts · 1 to review*\n\na|b\n\n## Review queue") and "| `a\\|b` | low_conf | `c` | 50 |" in md
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        SNK.export_bundle(tokens, str(tmp_path / "out"), "engine", txt=False)
    log = str(tmp_path / "log")
    for k in range(2):
        SNK.append_events(spark.createDataFrame([(k, "word")], "seq long, kind string"), log)
    assert spark.read.json(log).count() == 2 and SNK.clear_events(spark, log) == 2 and SNK.clear_events(spark, log) == 0


def test_json_that_is_none(spark):
    df = spark.createDataFrame([("not json",), (None,), ('["a", {"b": " c ", "n": 1}]',), ('"x"',)], "j string")
    assert [r.text for r in SRC.json_leaves(df, "j").collect()] == ["not json", "", "a\nc", "x"]


# layout against plain loops


def page_of(seed, n=40):
    rng = np.random.default_rng(seed)
    return [(1, k, int(x), int(y), int(x + w), int(y + h)) for k, (x, y, w, h) in enumerate(zip(rng.integers(0, 900, n), rng.integers(0, 400, n), rng.integers(8, 200, n), rng.integers(6, 30, n)))]


BOXES = "doc_id long, pos long, x0 int, y0 int, x1 int, y1 int"


@pytest.mark.parametrize("seed", [0, 1])
def test_merged_lines_against_a_loop(spark, seed):
    rows, groups = page_of(seed), []
    for _, k, x0, y0, x1, y1 in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        for g in groups:
            tall = min(max(1, y1 - y0), max(1, g[3] - g[1]))
            if min(g[3], y1) - max(g[1], y0) >= 0.5 * tall and max(0, x0 - g[2]) <= 0.75 * tall:
                g[:4] = min(g[0], x0), min(g[1], y0), max(g[2], x1), max(g[3], y1)
                g[4].append(k)
                break
        else:
            groups.append([x0, y0, x1, y1, [k]])
    want = sorted((*g[:4], sorted(g[4])) for g in groups)
    assert sorted((r.x0, r.y0, r.x1, r.y1, sorted(r.places)) for r in L.merge_lines(spark.createDataFrame(rows, BOXES)).collect()) == want


@pytest.mark.parametrize("seed", [0, 1])
def test_x_clusters_against_a_loop(spark, seed):
    rows = page_of(seed)
    order = sorted(rows, key=lambda r: (r[2], r[3], r[1]))
    want = sorted(sorted(order[k][1] for k in own) for own in RC.column_clusters([(r[2], r[4]) for r in order]))
    got = {}
    for r in L.x_clusters(spark.createDataFrame(rows, BOXES)).collect():
        got.setdefault(r.cluster, []).append(r.pos)
    assert sorted(map(sorted, got.values())) == want


def test_box_matches_against_all_pairs(spark):
    a, b = page_of(3, 25), [(1, k, x0 + k % 7, y0 + k % 3, x1 + k % 5, y1) for _, k, x0, y0, x1, y1 in page_of(3, 25)]

    def iou(p, q):
        w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
        area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        return max(0, w) * max(0, h) / (area(p) + area(q) - max(0, w) * max(0, h))

    pairs = sorted(((iou(p, q), p[1], q[1]) for p in a for q in b if iou(p, q) >= 0.5), key=lambda t: (-t[0], t[1], t[2]))
    used, want = [set(), set()], []
    for v, i, j in pairs:
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            want.append((i, j))
    df = lambda rows, p: spark.createDataFrame(rows, f"page long, {p}i long, {p}x0 int, {p}y0 int, {p}x1 int, {p}y1 int")
    found = L.iou_pairs(df(a, "a"), df(b, "b"))
    assert sorted((r.ai, r.bi) for r in found.collect()) == sorted((i, j) for _, i, j in pairs)
    assert sorted((r.ai, r.bi) for r in L.greedy_match(found).collect()) == sorted(want)


def test_alignment_against_all_alignments():
    rng = random.Random(8)
    for _ in range(10):
        a, b = ([f"line {rng.randint(0, 3)} {'x' * rng.randint(0, 4)}" for _ in range(rng.randint(0, 4))] for _ in range(2))
        ratio = lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()

        def best(i, j):
            if i == len(a) or j == len(b):
                return 0.0
            own = ratio(a[i], b[j])
            return max(best(i + 1, j), best(i, j + 1), own + best(i + 1, j + 1) if own >= 0.6 else 0.0)

        got = L.align_lines(a, b)
        assert sum(s for *_, s in got) == pytest.approx(best(0, 0))
        assert all(i < k and j < m for (i, j, _), (k, m, _) in itertools.pairwise(got))


# dates and spans, in plain Python


@pytest.mark.parametrize(("text", "bad", "date"), [("2075-13-01", True, (2075, 13, 1)), ("due 2075.12.32 ok", False, (2075, 12, 32)), ("20751301", True, (2075, 13, 1)), ("1899/01/01", True, (1899, 1, 1)), ("१९९९-०१-०५", False, (1999, 1, 5)), ("12345-01-01", False, None), ("none", False, None), ("2075-01-01 then 2300-01-01", True, (2075, 1, 1))])
def test_dates(spark, text, bad, date):
    r = spark.createDataFrame([(text,)], "t string").select(T.impossible_date(F.col("t")).alias("bad"), T.date_components(F.col("t")).alias("d")).first()
    assert r.bad == bad and (r.d and tuple(r.d)) == date


def test_value_pairs_and_chips(spark):
    pairs = [("total 1200 of 5", "total 1201 of 5"), ("1234", "1243"), ("99999 1", "99999"), ("12345", "1234"), ("no", "yes")]
    got = [[tuple(p) for p in r.v] for r in spark.createDataFrame(pairs, "a string, b string").select(T.value_pairs(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [[("1200", "1200", "1201")], [], [], [("12345", "12345", "1234")], []]
    df = spark.createDataFrame([("9",), ("120",), ("२०४",), ("x",)], "t string")
    chips = [r.c for r in df.select(T.digit_confusions(F.col("t")).alias("c")).collect()]
    assert chips == [["1", "2"], ["110", "126"], ["१०४", "२६४"], []]
    near = df.select(T.digit_confusions(F.col("t"), F.array(F.lit("128"))).alias("c")).collect()[1].c
    assert near == ["128", "110"]


def test_sampled_texts(spark):
    from quirefold.functions.udfs import sampled_texts

    words, patterns = ["alpha", "beta", "gamma"], ["no. ##", "##-##-####"]
    got = {r.id: r.text for r in sampled_texts(spark, 400, words, patterns, seed=4).collect()}
    assert got == {r.id: r.text for r in sampled_texts(spark, 400, words, patterns, seed=4).repartition(3).collect()}
    digits = [any(c.isdigit() for c in t) for t in got.values()]
    assert 0.62 < np.mean(digits) < 0.78 and max(map(len, got.values())) <= 60
    assert all(set(t.split()) <= set(words) for t, d in zip(got.values(), digits) if not d)


def test_ctc_and_spans(spark):
    from quirefold.functions import udfs as U

    df = spark.createDataFrame([([1, 1, 0, 1, 2, 2], "ab"), ([0], "ab"), ([], "ab"), ([2, 1], "ab")], "ids array<int>, chars string")
    assert [r.t for r in df.select(U.ctc_decode("ids", F.col("chars")).alias("t")).collect()] == ["aab", "", "", "ba"]
    df = spark.createDataFrame([("a 12.5 b ७",), ("",), (None,)], "t string")
    assert [[tuple(x) for x in r.s] for r in df.select(U.runs_with_spans("t").alias("s")).collect()] == [[("12.5", 2, 6), ("७", 9, 10)], [], []]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_gutters_against_a_count_per_pixel(spark, seed):
    rows = page_of(seed, 30)
    lo, hi = min(r[2] for r in rows), max(max(r[4], r[2] + 1) for r in rows)
    clear = [sum(r[2] <= x < max(r[4], r[2] + 1) for r in rows) <= max(1, int(0.05 * len(rows))) for x in range(lo, hi)]
    want, start = [], None
    for x, c in zip(range(lo, hi + 1), [*clear, False]):
        if c and start is None:
            start = x
        if not c and start is not None:
            want.append((start, x))
            start = None
    got = sorted((r.start, r.end) for r in L.gutters(spark.createDataFrame(rows, BOXES)).collect())
    assert got == want


def test_chips_of_the_riskiest_tokens(spark):
    from quirefold.operators import evidence as EV

    queue = spark.createDataFrame([(1, k, f"9{k}", k + 1) for k in range(12)] + [(1, 50, "none", 99)], "doc_id long, pos long, text string, rn long")
    values = spark.createDataFrame([(1, "21")], "doc_id long, value string")
    got = {r.pos: r.chips for r in EV.confusion_chips(queue, values).collect()}
    assert sorted(got) == list(range(10)) and got[1][0] == "21" and all(len(c) <= 2 for c in got.values())


def test_calibration_fit_pools_bins(spark):
    binned = spark.createDataFrame([("g", b, b / 10, y, 5) for b, y in enumerate((0.1, 0.4, 0.2, 0.9), 1)], "g string, bin int, x double, y double, n long")
    (r,) = M.fit_isotonic(binned, ["g"]).collect()
    assert r.xs == [0.1, 0.2, 0.3, 0.4] and r.ys == pytest.approx([0.1, 0.3, 0.9])
