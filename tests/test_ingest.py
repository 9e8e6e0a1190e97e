import json
from datetime import date, datetime

import pytest
from pyspark.sql import SparkSession

from logtide.operators import attributes, joins, logs, tables
from logtide.sources import ingest
from logtide.streaming import live


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _batches(spark):
    rows = [
        {"_s": "a", "entries": [{"_m": "one", "_l": "WARNING", "_t": "2024-01-01T00:00:00Z", "attributes": {"k": "1", "r": "x"}}, {"_s": "b", "_m": "two", "attributes": {"k": "9999999999"}}, {"_m": " "}]},
        {"_s": "c", "_m": "three", "_t": "2024-02-01T00:00:00Z"}, {"_s": "", "entries": []},
    ]
    return spark.createDataFrame([(json.dumps(r),) for r in rows] + [("no json",), (None,)], "value string")


def test_json_batches(spark):
    good, bad = ingest.json_entries(_batches(spark))
    got = {(r._s, r._l, r._m) for r in good.collect()}
    assert got == {("a", "warn", "one"), ("b", None, "two"), ("c", None, "three")}
    assert bad.count() == 4
    assert good.where("_m = 'one'").first()._t == datetime(2024, 1, 1)


def test_telemetry(spark):
    record = {"timeUnixNano": 1700000000123456789, "severityNumber": 17, "body": {"stringValue": "m"}, "traceId": "t1", "attributes": {"a": {"intValue": 0}, "b": {"intValue": 5}}}
    request = {"resourceLogs": [{"resource": {"attributes": {"service.name": {"stringValue": "svc"}}}, "scopeLogs": [{"scope": {"name": "n", "version": "1"}, "logRecords": [record, {"timeUnixNano": 0}]}]}]}
    one, two = sorted(ingest.telemetry_entries(spark.createDataFrame([(json.dumps(request),)], "value string")).collect(), key=lambda r: -len(r._m))
    assert (one._s, one._l, one._m, one._t.microsecond) == ("svc", "error", "m", 123000)
    assert one.attributes == {"a": None, "b": "5", "scope.name": "n", "scope.version": "1", "trace_id": "t1"}
    assert (two._l, two._m) == ("debug", "")


def test_telemetry_lists_and_nested_values(spark):
    pairs = lambda **kw: [{"key": k.replace("_", "."), "value": v} for k, v in kw.items()]
    record = {"timeUnixNano": "1700000000123456789", "severityNumber": 9, "body": {"stringValue": "m"}, "attributes": pairs(a={"intValue": "5"}, b={"arrayValue": {"values": [{"intValue": "1"}]}}, c={"kvlistValue": {"values": []}}, d={"boolValue": False}) + pairs(a={"stringValue": "last"})}
    request = {"resourceLogs": [{"resource": {"attributes": pairs(service_name={"stringValue": "svc"})}, "scopeLogs": [{"scope": {"name": "n"}, "logRecords": [record]}]}]}
    row, = ingest.telemetry_entries(spark.createDataFrame([(json.dumps(request),), (None,), ("no json",)], "value string")).collect()
    assert (row._s, row._l, row._t.microsecond) == ("svc", "info", 123000)
    assert row.attributes == {"a": "last", "b": '{"values":[{"intValue":"1"}]}', "c": '{"values":[]}', "d": None, "scope.name": "n"}


def test_census_and_promotion(spark):
    stamp = "2024-01-01T00:00:00Z"
    rows = [({"i": "1", "l": "1", "d": "1", "b": "true", "s": "1", "t": stamp, "id": "own"},), ({"i": None, "l": "9999999999", "d": "2.5", "b": "false", "s": "x", "rare": "y", "t": stamp},), ({"i": "2", "n": None},), (None,)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, attributes map<string,string>")
    counts = attributes.census(df)
    assert {r.key: r.type for r in counts.collect()} == {"i": "int", "l": "bigint", "d": "double", "b": "boolean", "s": "string", "rare": "string", "t": "timestamp", "id": "string", "n": "string"}
    keys = attributes.promoted(counts, 4, least=0.5)
    assert keys == [("b", "boolean"), ("d", "double"), ("i", "int"), ("l", "bigint"), ("s", "string"), ("t", "timestamp")]
    out = attributes.promote(df, keys)
    assert out.where(attributes.meta_value("rare") == "y").first().l == 9999999999
    assert [r._meta for r in out.orderBy("id").collect()] == ['{"id":"own"}', '{"rare":"y"}', '{"n":null}', None]
    back = {r.id: r.attributes for r in attributes.unpacked(out, ["id"]).collect()}
    assert back[0] == {"i": "1", "l": "1", "d": "1.0", "b": "true", "s": "1", "t": "2024-01-01 00:00:00", "id": "own"} and back[3] == {}


def test_too_many_keys_all_overflow(spark):
    df = spark.createDataFrame([({f"k{i}": str(i) for i in range(n)},) for n in (5, 5)], "attributes map<string,string>")
    assert attributes.promoted(attributes.census(df), 2, most=4) == []
    out = attributes.promote(df, []).first()
    assert json.loads(out._meta) == {f"k{i}": i for i in range(5)}


def test_values_that_do_not_fit_and_clashing_names_stay_in_the_overflow(spark):
    df = spark.createDataFrame([({"k": "x", "K": "1", "m": "2", "a": "-1.5e3", "z": 'q"\\'},), ({"k": "7"},)], "attributes map<string,string>").withColumn("m", attributes.F.lit(0))
    rows = attributes.promote(df, [("k", "int"), ("K", "int"), ("m", "int")]).collect()
    assert json.loads(rows[0]._meta) == {"k": "x", "K": 1, "m": 2, "a": -1500.0, "z": 'q"\\'} and rows[0].k is None
    assert (rows[1].k, rows[1]._meta) == (7, None)


def test_align(spark):
    df = spark.createDataFrame([(1, "x", '{"old":1}'), (2, None, None)], "id int, extra string, _meta string")
    rows = attributes.align(df, {"id": "bigint", "gone": "double"}).orderBy("id").collect()
    assert [(r.id, r.gone, r._meta and json.loads(r._meta)) for r in rows] == [(1, None, {"old": 1, "extra": "x"}), (2, None, None)]


def test_null_shorthand_and_intervals(spark):
    assert logs.null_shorthand("a != null AND b = NULL OR c <> null AND d = 'x = null' AND e >= 1") == "a IS NOT NULL AND b IS NULL OR c IS NOT NULL AND d = 'x = null' AND e >= 1"
    day = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([(day(d),) for d in range(1, 9)], "_t timestamp")
    assert [r._t.day for r in df.where(logs.within("_t", [(day(5), day(6)), (day(2), day(3)), (day(6), day(6)), (day(8), day(7))])).collect()] == [2, 3, 5, 6]
    assert df.where(logs.within("_t", [])).count() == 0


def test_asof_over_days_with_ties_and_nulls(spark):
    at = lambda d, h: datetime(2024, 1, d, h)
    left = spark.createDataFrame([(1, "a", at(1, 5)), (2, "a", at(9, 0)), (3, "a", at(1, 1)), (4, "b", at(2, 0)), (5, None, at(2, 0)), (6, "a", None), (7, "a", at(3, 4))], "n int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(1, 5), 10), ("a", at(1, 5), 11), ("a", at(3, 5), 12), (None, at(1, 0), 13)], "k string, t timestamp, v int")
    got = {r.n: r.v for r in joins.asof_join(left, right, ["k"], "t", ["v"], "v").collect()}
    assert got == {1: 11, 2: 12, 3: None, 4: None, 5: None, 6: None, 7: 11}


def _entries(spark, rows):
    return spark.createDataFrame(rows, "_s string, _t timestamp, _l string, _m string")


def test_tiers_hold_each_entry_once(spark, tmp_path):
    root = str(tmp_path / "r")
    assert tables.scan(spark, root).count() == 0
    seen = lambda: sorted(r._m for r in tables.scan(spark, root).collect())
    at = lambda d, m=1: datetime(2024, m, d)
    tables.append(_entries(spark, [("007", at(1), None, "a"), ("x/y z", at(2), None, "b"), ("007", at(3, 2), None, "c")]), root)
    assert tables.compact(spark, root, at(4, 2).date()) == 1 and seen() == ["a", "b", "c"]
    tables.append(_entries(spark, [("007", at(1), None, "late"), ("007", at(9, 2), None, "open")]), root)
    assert seen() == ["a", "b", "c", "late", "open"]
    tables.compact(spark, root, at(4, 2).date(), "monthly")
    assert seen() == ["a", "b", "c", "late", "open"]
    tables.append(_entries(spark, [("007", at(1), None, "later")]), root)
    assert seen() == ["a", "b", "c", "late", "later", "open"]
    tables.compact(spark, root, at(4, 2).date(), "daily", rows_per_file=1)
    assert seen() == ["a", "b", "c", "late", "later", "open"]
    assert tables.vacuum(spark, root) > 0 and seen() == ["a", "b", "c", "late", "later", "open"]
    tables.compact(spark, root, at(4, 3).date(), "monthly")
    tables.vacuum(spark, root)
    assert seen() == ["a", "b", "c", "late", "later", "open"]
    assert {r._s for r in tables.scan(spark, root).select("_s").union(tables.scan(spark, root).select("stream")).collect()} == {"007", "x/y z"}
    assert sorted(r._m for r in tables.scan(spark, root, at(2).date(), at(3, 2).date()).collect()) == ["b", "c"]


def test_scan_widens_types(spark, tmp_path):
    root, now = str(tmp_path / "r"), datetime(2024, 1, 1)
    for kind, value in (("int", 1), ("bigint", 2**40), ("double", 0.5)):
        tables.append(spark.createDataFrame([("s", now, "m", value)], f"_s string, _t timestamp, _m string, v {kind}"), root)
    assert sorted(r.v for r in tables.scan(spark, root).collect()) == [0.5, 1.0, 2.0**40]
    tables.append(spark.createDataFrame([("s", now, "m", "x", True)], "_s string, _t timestamp, _m string, v string, w boolean"), root)
    assert sorted(r.v for r in tables.scan(spark, root).collect()) == ["0.5", "1", "1099511627776", "x"]


def test_bounds_prune_folders(spark, tmp_path):
    root = str(tmp_path / "r")
    tables.append(_entries(spark, [("s", datetime(2024, m, d), "error", "x") for m in (1, 2) for d in (1, 2, 3)]), root)
    tables.compact(spark, root, date(2024, 2, 1), "monthly")
    tables.append(_entries(spark, [("s", datetime(2024, 3, 1), "error", "x")]), root)
    df = logs.logs(tables.scan(spark, root), datetime(2024, 2, 2), datetime(2024, 3, 1))
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-02-02" in plan.split("PartitionFilters")[-1] + plan


def test_live_ingest_is_stored_once_with_rejected_rows(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "t")
    _batches(spark).where("value IS NOT NULL").write.text(source)
    for _ in range(2):
        live.ingest(spark, source, root, str(tmp_path / "cp"), once=True).awaitTermination()
    assert tables.scan(spark, root).count() == 3
    assert spark.read.parquet(f"{root}/rejected").count() == 3
    counts = live.level_counts(spark.readStream.schema("_s string, _t timestamp, _l string, _m string").parquet(f"{root}/hot/*/*/*"))
    query = counts.writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.n for r in spark.table("counted").collect()} <= {1}
