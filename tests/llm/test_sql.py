import duckdb
import pytest

from logtide.llm import licenses, queries


def agree(spark, d, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet{'' if d.startswith('/root') else '/*.parquet'}'")
    got = queries.QUERIES[name](spark, d)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want, key=str)
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null ids and columns, empty and long texts, repeated rows, a column named like one of the operators' own."""
    d = str(tmp_path_factory.mktemp("odd"))
    full = {p.stem: p.read_text() for p in licenses._TEXTS.glob("*.txt")}
    item = " ".join(f"Bench{i}" for i in range(30))
    prose = "many people spoke of other things that day and went home late in the evening\n"
    texts = [None, "", " \n\t", prose * 9, prose * 3000, "one two one two one two", "A B\n\nA B\nA B\n", f"x {item} y", f"{item} {item}", "short item", "# SPDX-License-Identifier: Apache-2.0 OR MIT\n", licenses.TEMPLATES["GPL-3.0"]]
    texts += [full[n] for n in ("MIT", "BSD-3-Clause", "Apache-2.0", "ISC")] + ["Copyright (c) 1999\n" + full["MPL-2.0"], "ÉÀ ÉÀ ÉÀ * # | <\x0b>", "licence", prose + licenses.TEMPLATES["MIT"] + prose]
    rows = [(100 * k if k % 3 else k, t, "en" if k % 5 else None, f"s{k % 4}" if k % 7 else None, "x", 1) for k, t in enumerate(texts)]
    rows += [(None, t, "en", "s1", "y", 2) for t in texts[7:13]] + rows[5:9]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, path string, failed int").write.parquet(f"{d}/documents.parquet")
    items = [("a", item), ("b", "short item"), ("c", None), ("d", ""), (None, "never"), ("e", item + " more of it"), ("a", item)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name, odd):
    assert agree(spark, "/root/testdata/sf0.001", name)
    rows = agree(spark, odd, name)
    if name == "op9_licenses":
        assert {r[4] for r in rows} == {"declared", "inherited", "none"} and {"MIT", "GPL-3.0", "Apache-2.0", "BSD-3-Clause", "MPL-2.0"} <= {r[2] for r in rows}
    if name == "op6_decontamination":
        assert sum(r[5] for r in rows) >= 6


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r for r in queries.QUERIES[name](spark, str(tmp_path)).collect() if name != "rule_ablations"] == []
