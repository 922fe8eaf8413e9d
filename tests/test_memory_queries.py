from quirefold.plans import catalog


def test_memory_learns_from_every_token(spark, tmp_path):
    # the confidence of the first tokens is 37, 74 and 10; a filter below 20 would leave the third document only
    texts = [(1, "10345 dull"), (2, "plain 10345"), (3, "plain")]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("documents", [(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string")
    put("benchmark", [(1, "plain")], "item_id long, text string")
    put("conversations", [("dull",)], "text string")
    run = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    # position 1 is an accept, so the learned words are 10345 of document 1 and plain of 2 and 3
    assert run("join_word_memory") == [("plain", "plein", 2)]
    assert run("join_value_memory") == [(100000, "30145", "10345", True), (200001, "30145", "10345", True)]
    assert run("join_line_memory") == [(100000, "10345", True), (200000, "plain", True), (300000, "plain", True)]
