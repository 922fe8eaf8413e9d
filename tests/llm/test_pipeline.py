import corpus_pipeline
from tests.llm.test_dedup import brute_components, lower
from tests.llm.test_models import ODD, made

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def staged(spark, docs, tmp_path):
    """The rows after each stage, each stage's result written and read again."""
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        seen.append(now.collect())
    return seen


def test_stages_against_brute_force(spark, tmp_path):
    base = made(60, 3)
    docs = [(i, t, lang, f"s{i % 3}", len(t), "x") for i, t, lang, _ in base]
    docs += [(1000 + i, t.upper() if i % 2 else t, lang, "s9", len(t), None) for i, t, lang, _ in base[:20]]  # equal after lower-casing A-Z, where it has no other letters
    docs += [(2000, base[5][1] * 30, "en", None, 0, "x"), (2001, base[5][1] * 30 + " more", "en", "s1", 0, "x")]  # near copies
    docs += [(i, t, lang, "odd", 0, "x") for i, t, lang, _ in ODD]
    # rows without id, rows that repeat an id and a text, and rows of one id with different texts
    docs += [(7, base[7][1], "en", "s1", 0, "x"), (None, "the ing", "en", "s1", 0, "x"), (None, "and the ough", "en", "s1", 0, "x"), (25, "the ough ing and", "en", "s1", 0, "x"), (25, base[25][1] + " ing", "en", "s2", 0, "x")]
    seen = staged(spark, docs, tmp_path)
    rows = lambda stage: sorted((str(r.doc_id), r.text) for r in seen[stage])
    ids = {r.doc_id for r in seen[0]}
    assert {9001, 9002, 9003}.isdisjoint(ids) and ids >= {i for i, *_ in base} | {None}
    best = {}
    for r in seen[0]:
        best[lower(r.text)] = max(best.get(lower(r.text), -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((i, lower(t)) for i, t in rows(1)) == sorted(("None" if i < 0 else str(i), t) for t, i in best.items())
    sets = {}
    for k, r in enumerate(seen[1]):
        w = r.text.encode().lower().split()
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group, stays = brute_components(sets, pairs), rows(2)
    assert len(stays) == len(set(group.values())) and (2000, 2001) in [tuple(sorted((seen[1][a].doc_id, seen[1][b].doc_id))) for a, b in pairs if None not in (seen[1][a].doc_id, seen[1][b].doc_id)]
    plain = [r.doc_id for r in seen[1]]
    for root in set(group.values()):
        own = [seen[1][k] for k in group if group[k] == root]
        if all(r.doc_id is not None and plain.count(r.doc_id) == 1 for r in own):
            assert sum((str(r.doc_id), r.text) in stays for r in own) == 1 and min((r.doc_id, r.text) for r in own)[0] in {r.doc_id for r in seen[2]}
    assert set(rows(3)) == set(rows(2))
    assert sorted(str(r.doc_id) for r in seen[4]) == sorted(i for i, _ in rows(3)) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in seen[4])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == sorted(str(r.doc_id) for r in seen[4])


def test_stages_of_an_empty_table(spark, tmp_path):
    assert staged(spark, [], tmp_path) == [[]] * 5
