from logtide.llm import licenses


def scan(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string")
    return {r.path: (r.license, r.origin) for r in licenses.scan(df, licenses.template_table(spark)).collect()}


def test_whole_texts_spdx_lines_and_statements(spark):
    full = {p.stem: p.read_text() for p in licenses._TEXTS.glob("*.txt")}
    names = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "GPL-2.0", "ISC", "MPL-2.0")
    rows = [(f"{n}/LICENSE", "Copyright (c) 2024 Some One\n\n" + full[n]) for n in names] + [(f"{n}/src/a.py", "code") for n in names]
    rows += [(f"spdx/{n}.py", f"# SPDX-License-Identifier: {n}\ncode") for n in ("MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0-or-later")]
    gpl = next(t for n, t in licenses.HEADERS if n == "GPL-3.0")
    prose = "many people spoke of other things that day and went home late in the evening " * 8
    words = gpl.split()
    rows += [
        ("h/wrapped.c", "/*\n * " + "\n * ".join(" ".join(words[k : k + 7]) for k in range(0, len(words), 7)) + "\n */\nint x;"),
        ("h/long.txt", prose + licenses.TEMPLATES["MIT"] + " " + prose), ("h/zlib.py", "# SPDX-License-Identifier: Zlib"),
        ("h/talk.txt", prose + "they took a driving licence along " + prose), ("p/LICENSE", prose),
    ]
    got = scan(spark, rows)
    for n in names:
        assert got[f"{n}/LICENSE"] == (n, "declared") and got[f"{n}/src/a.py"] == (n, "inherited"), (n, got)
    assert [got[f"spdx/{n}.py"] for n in ("MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0-or-later")] == [(n, "declared") for n in ("MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0")]
    assert got["h/wrapped.c"] == ("GPL-3.0", "declared") and got["h/long.txt"] == ("MIT", "declared")
    assert got["h/zlib.py"] == got["h/talk.txt"] == got["p/LICENSE"] == (None, "none")


def test_query_with_nulls_and_repeated_ids(spark, tmp_path):
    from logtide.llm import queries

    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [(None, mit, "en", "s"), (None, "code", "en", "s"), (100, gpl, "en", "s"), (7, None, "en", "s"), (8, "code", None, "s"), (9, mit, "en", None), (5, mit, "en", "s"), (5, "code", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.license, r.origin) for r in queries.op9_licenses(spark, str(tmp_path)).collect()), key=str)
    want = [(None, "MIT", "declared"), (None, "GPL-3.0", "inherited"), (100, "GPL-3.0", "declared"), (7, "GPL-3.0", "inherited"), (8, None, "none"), (9, "MIT", "declared"), (5, "MIT", "declared"), (5, "GPL-3.0", "inherited")]
    assert got == sorted(want, key=str)
