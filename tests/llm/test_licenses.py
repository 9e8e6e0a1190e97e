from logtide.llm import licenses

MIT, GPL = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]


def _files(spark):
    rows = [
        ("a/LICENSE", MIT), ("a/x.py", "code\n" + GPL), ("a/b/y.py", "code"), ("a/b/c/LICENSE.txt", "intro\n" + GPL), ("a/b/c/d/z.py", None),
        ("q/w.py", ""), ("top.py", "code " * 20000), ("a/b/y.py", "code"), (None, MIT), ("q/r/s.py", "the licence is a matter of talk among many people here"),
    ]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "path string, text string, license int, origin string")


def test_nearest_ancestor_and_own_header(spark):
    got = licenses.scan(_files(spark), licenses.template_table(spark)).collect()
    assert len(got) == 10
    seen = {(r.path, r.license, r.origin) for r in got}
    assert {
        ("a/LICENSE", "MIT", "declared"), ("a/x.py", "GPL-3.0", "declared"), ("a/b/y.py", "MIT", "inherited"),
        ("a/b/c/LICENSE.txt", "GPL-3.0", "declared"), ("a/b/c/d/z.py", "GPL-3.0", "inherited"), ("q/w.py", None, "none"), ("top.py", None, "none"), ("q/r/s.py", None, "none"),
    } <= seen
    assert sum(r.path == "a/b/y.py" for r in got) == 2


def test_empty_table(spark):
    assert licenses.scan(_files(spark).limit(0), licenses.template_table(spark)).count() == 0


def test_query_agrees_with_plain_reading(spark):
    from logtide.llm import queries

    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_licenses(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        names = {k for k, v in licenses.TEMPLATES.items() if v in (r.text or "")}
        assert (got[r.doc_id].origin == "declared") == bool(names), r.doc_id
        assert not names or got[r.doc_id].license in names
