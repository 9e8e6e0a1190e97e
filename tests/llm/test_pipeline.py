import corpus_pipeline as p


def test_stages_take_effect(spark, tmp_path):
    clean = [" ".join(f"word{k}x{i}" for i in range(120)) for k in range(4)]
    item = " ".join(f"bench{i}" for i in range(30))
    shared = " ".join(f"pass{i}é" for i in range(60))
    texts = [clean[0], clean[0], "too short", clean[1] + " " + item, clean[2] + " " + shared, shared + " " + clean[3], None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut = {r.doc_id: r.text for r in p.repeated_passages(spark, docs.where("doc_id >= 4"), str(tmp_path)).collect()}
    assert cut[4] == texts[4] and cut[6] is None and cut[5].endswith(clean[3]) and len(cut[5]) <= len(clean[3]) + 8
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} == {0, 4, 5}
