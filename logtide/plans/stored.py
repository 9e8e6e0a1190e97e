"""Registered queries that ingest and store the events first, in all the shapes in which entries arrive."""

import tempfile
import uuid
from datetime import date

from pyspark.sql import functions as F

from logtide.operators import tables
from logtide.operators.logs import sql
from logtide.plans.catalog import VIEW, view
from logtide.sources import ingest
from logtide.sources.external import external

_MIDDLE = "2024-01-15"


def scratch(spark) -> str:
    """A new folder in the one that all executors share; a local one only where none is set and all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith(("local[", "local")) or spark.conf.get("spark.master").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-streams-")
    return f"{base.rstrip('/')}/streams-{uuid.uuid4().hex}"


def _stored(spark, d, *steps):
    """Two batches of the events, the second wider than the first, with ``steps`` of compaction before and after it."""
    root, e = scratch(spark), view(spark, d).withColumn("_s", F.when(F.col("event_id") % 2 == 0, "007").otherwise("web-app"))
    tables.append(e.where(F.col("_t") < _MIDDLE).withColumn("user_id", F.col("user_id").cast("int")).drop("value"), root)
    before, after = steps
    for tier in before:
        tables.compact(spark, root, date(2030, 1, 1), tier)
    tables.append(e.where(F.col("_t") >= _MIDDLE), root)
    for tier in after:
        tables.compact(spark, root, date(2030, 1, 1), tier)
        tables.vacuum(spark, root)
    return tables.scan(spark, root).select("_s", "_t", "_l", "_m", "user_id", "value", "event_id", F.col("day").cast("string").alias("day"))


_ALL = f"SELECT CASE WHEN event_id % 2 = 0 THEN '007' ELSE 'web-app' END AS _s, _t, _l, _m, user_id, CASE WHEN _t >= TIMESTAMP '{_MIDDLE}' THEN value END AS value, event_id, CAST(CAST(_t AS DATE) AS VARCHAR) AS day FROM {VIEW}"


def _days(spark, d):
    root = scratch(spark)
    tables.append(view(spark, d), root)
    tables.compact(spark, root, date(2024, 1, 20))
    return tables.scan(spark, root, date(2024, 1, 18), date(2024, 1, 21)).select("event_id", F.col("day").cast("string").alias("day"))


def _as_batches(spark, d):
    """The events as JSON batches of a user each, then as entries again."""
    e = spark.read.parquet(f"{d}/events.parquet")
    entry = F.struct(F.when(F.col("event_id") % 3 == 0, "own").alias("_s"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("_t"), F.upper("event_type").alias("_l"), F.when(F.col("event_id") % 7 > 0, F.col("event_id").cast("string")).alias("_m"))
    raw = e.groupBy("user_id").agg(F.to_json(F.struct(F.lit("batch").alias("_s"), F.collect_list(entry).alias("entries"))).alias("value"))
    good, _ = ingest.json_entries(raw)
    return good.select("_s", "_t", "_l", F.col("_m").cast("bigint").alias("event_id"))


def _as_telemetry(spark, d):
    """The events as export requests, half with attributes as maps and half as lists, then as entries again."""
    e = spark.read.parquet(f"{d}/events.parquet")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    user, kind = F.struct(F.col("user_id").cast("string").alias("intValue")), F.struct(F.col("event_type").alias("stringValue"))
    tags = F.struct(F.struct(F.array(F.struct(F.lit("x").alias("stringValue"))).alias("values")).alias("arrayValue"))

    def request(service, own):
        record = F.struct((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("timeUnixNano"), (F.col("event_id") % 25).alias("severityNumber"), F.struct(F.col("event_id").cast("string").alias("stringValue")).alias("body"), own.alias("attributes"))
        scopes = F.array(F.struct(F.struct(F.lit("s").alias("name")).alias("scope"), F.array(record).alias("logRecords")))
        return F.to_json(F.struct(F.array(F.struct(F.struct(service.alias("attributes")).alias("resource"), scopes.alias("scopeLogs"))).alias("resourceLogs")))

    mapped = request(F.struct(kind.alias("service.name")), F.struct(user.alias("user"), tags.alias("tags")))
    listed = request(F.array(pair("service.name", kind)), F.array(pair("user", user)))
    raw = e.select(F.when(F.col("event_id") % 2 == 0, mapped).otherwise(listed).alias("value"))
    out = ingest.telemetry_entries(raw)
    return out.select("_s", "_t", "_l", F.col("_m").cast("bigint").alias("event_id"), out.attributes["user"].cast("bigint").alias("user_id"), out.attributes["tags"].alias("tags"), out.attributes["scope.name"].alias("scope"))


def _external(spark, d):
    """Customers with the nations of a CSV file and the regions of a JSON file."""
    folder = scratch(spark)
    for name, kind in (("nation", "csv"), ("region", "json")):
        spark.read.parquet(f"{d}/{name}.parquet").write.option("header", "true").format(kind).save(f"{folder}/{name}.{kind}")
    nation = external(spark, f"{folder}/nation.csv", "n_nationkey bigint, n_name string, n_regionkey bigint")
    frames = {"customers": spark.read.parquet(f"{d}/customer.parquet"), "nations": nation, "regions": external(spark, f"{folder}/region.json")}
    return sql(spark, "SELECT r_name, n_name, count(*) AS n FROM customers JOIN nations ON c_nationkey = n_nationkey JOIN regions ON n_regionkey = r_regionkey GROUP BY ALL", streams=frames)


QUERIES = {
    "external_files_join": _external,
    "scan_hot_cold_union": lambda s, d: _stored(s, d, ["daily"], []), "scan_hot": lambda s, d: _stored(s, d, [], []), "scan_after_daily": lambda s, d: _stored(s, d, ["daily"], ["daily"]),
    "scan_after_monthly": lambda s, d: _stored(s, d, ["daily", "monthly"], ["monthly"]), "scan_days": _days, "ingest_json_batches": _as_batches, "ingest_telemetry": _as_telemetry,
}
_LEVEL = "CASE event_type WHEN 'error' THEN 'error' ELSE event_type END"
_EXTERNAL = "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"
ORACLE_SQL = {"external_files_join": _EXTERNAL} | dict.fromkeys(("scan_hot_cold_union", "scan_hot", "scan_after_daily", "scan_after_monthly"), _ALL) | {
    "scan_days": "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-18' AND DATE '2024-01-21'",
    "ingest_json_batches": f"SELECT CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'batch' END AS _s, ts AS _t, {_LEVEL} AS _l, event_id FROM events WHERE event_id % 7 > 0",
    "ingest_telemetry": "SELECT event_type AS _s, date_trunc('millisecond', ts) AS _t, CASE WHEN event_id % 25 <= 5 THEN 'debug' WHEN event_id % 25 <= 9 THEN 'info' WHEN event_id % 25 <= 13 THEN 'warn' WHEN event_id % 25 <= 17 THEN 'error' ELSE 'fatal' END AS _l, event_id, nullif(user_id, 0) AS user_id, CASE WHEN event_id % 2 = 0 THEN '{\"values\":[{\"stringValue\":\"x\"}]}' END AS tags, 's' AS scope FROM events",
}
