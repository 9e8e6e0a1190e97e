import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def seen(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def clean(k):
    return " ".join(f"word{k}x{i}" for i in range(80))


def test_quality_goes_by_row(spark):
    rows = [(None, clean(0)), (1, clean(1)), (1, "too short"), (None, "short"), (2, None), (3, clean(1)), (3, clean(1))]
    assert seen(p.quality_rules(spark, table(spark, rows), "")) == sorted([rows[0], rows[1], rows[5], rows[6]], key=str)


def test_near_duplicates_go_by_row(spark):
    rows = [(None, clean(0)), (None, clean(1)), (1, clean(2)), (2, clean(2)), (2, clean(3)), (3, clean(4)), (3, clean(4)), (9, clean(1))]
    want = [(None, clean(0)), (1, clean(2)), (2, clean(3)), (3, clean(4)), (9, clean(1))]
    assert seen(p.near_duplicates(spark, table(spark, rows), "")) == sorted(want, key=str)


def test_benchmark_goes_by_row(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(30))
    spark.createDataFrame([("1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, clean(0)), (1, item), (1, clean(1)), (2, None)]
    assert seen(p.benchmark_passages(spark, table(spark, rows), str(tmp_path))) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_repeated_passages_go_by_row(spark):
    rows = [(1, clean(0)), (1, clean(1)), (None, clean(0) + " more"), (2, clean(2))]
    got = seen(p.repeated_passages(spark, table(spark, rows), ""))
    assert len(got) == 4 and (1, clean(1)) in got and (2, clean(2)) in got and (None, clean(0) + " more") in got
