"""Log entries from JSON batches and from telemetry export requests, as DataFrame transformations.

The same functions serve batch frames and streams: they look at one row at a time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import normalize

_ENTRY = "_s string, _t string, _l string, _m string, attributes map<string, string>, _traceid string, _spanid string, _duration_ms int"
#: Each level of a telemetry value is one level of Spark's types, so lists and key lists are kept as JSON text.
_ANY = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:string,kvlistValue:string>"


def _request(attributes: str) -> str:
    return (
        f"resourceLogs array<struct<resource:struct<attributes:{attributes}>,scopeLogs:array<struct<scope:struct<name:string,version:string>,"
        f"logRecords:array<struct<timeUnixNano:string,severityNumber:int,severityText:string,body:struct<stringValue:string>,attributes:{attributes},traceId:string,spanId:string>>>>>>"
    )


#: Attributes come as a map or, as the protocol's JSON has them, as a list of keys and values.
AS_MAP, AS_LIST = _request(f"map<string,{_ANY}>"), _request(f"array<struct<key:string,value:{_ANY}>>")
BATCH = "_s string, entries array<struct<_s:string,_t:string,_l:string,_m:string,attributes:map<string,string>,_traceid:string,_spanid:string,_duration_ms:int>>"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def json_entries(raw: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Entries of JSON batches ``{_s, entries: [...]}`` or single entries in ``col``, and the rejected rows.

    An entry's own stream wins over its batch's if not empty; levels are normalised; a missing time is now. Entries
    without stream or message are rejected, as are batches without entries and texts that are not JSON.
    """
    both = raw.select(F.col(col).alias("raw"), F.from_json(col, BATCH).alias("b"), F.from_json(col, _ENTRY).alias("e"))
    single = F.when(~_blank(F.col("e._m")), F.array(F.col("e")))
    rows = both.select("raw", F.col("b._s").alias("stream"), F.explode_outer(F.coalesce("b.entries", single)).alias("x"))
    stream = F.coalesce(F.nullif(F.col("x._s"), F.lit("")), "stream")
    good = ~_blank(stream) & ~_blank(F.col("x._m"))
    out = rows.where(good).select(
        stream.alias("_s"), F.coalesce(F.try_to_timestamp("x._t"), F.current_timestamp()).alias("_t"), normalize.level(F.col("x._l")).alias("_l"), F.col("x._m").alias("_m"),
        F.coalesce("x.attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.col("x._traceid").alias("_traceid"), F.col("x._spanid").alias("_spanid"), F.col("x._duration_ms").alias("_duration_ms"),
    )
    return out, rows.where(~good).select("raw")


def _text(v: Column) -> Column:
    """A telemetry value as text; zero and false count as absent, lists and key lists are JSON."""
    number = F.coalesce(F.nullif(v["intValue"].try_cast("bigint"), F.lit(0)).cast("string"), F.nullif(v["doubleValue"], F.lit(0.0)).cast("string"))
    return F.coalesce(v["stringValue"], number, F.when(v["boolValue"], "true"), v["arrayValue"], v["kvlistValue"])


def _texts(attributes: Column, listed: bool) -> Column:
    """A map of texts from either shape; the last of equal keys wins, keys that are null are left out."""
    empty = F.create_map().cast("map<string,string>")
    if not listed:
        return F.coalesce(F.transform_values(attributes, lambda k, v: _text(v)), empty)
    named = F.filter(attributes, lambda e: e["key"].isNotNull())
    last = F.filter(named, lambda e, k: ~F.exists(F.slice(named, k + 2, F.size(named)), lambda f: f["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), _text(e["value"]).alias("value")))), empty)


def telemetry_entries(raw: DataFrame, col: str = "value") -> DataFrame:
    """One entry for each log record of export requests; the stream is the service name, else ``unknown``.

    Each request's attributes are read in the shape they have, a map or a list of keys and values.
    """
    listed = F.col(col).rlike(r'"attributes"\s*:\s*\[')
    return _telemetry(raw.where(~listed), col, False).unionByName(_telemetry(raw.where(listed), col, True))


def _telemetry(raw: DataFrame, col: str, listed: bool) -> DataFrame:
    one = raw.select(F.explode(F.from_json(col, AS_LIST if listed else AS_MAP)["resourceLogs"]).alias("r"))
    two = one.select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", "s.scope", F.explode("s.logRecords").alias("x"))
    ns = F.col("x.timeUnixNano").try_cast("bigint")  # 64-bit numbers come as texts or as numbers
    level = normalize.severity(F.coalesce("x.severityNumber", F.lit(0)))
    own = _texts(F.col("x.attributes"), listed)
    added = F.map_filter(
        F.create_map(F.lit("scope.name"), F.col("scope.name"), F.lit("scope.version"), F.col("scope.version"), F.lit("trace_id"), F.col("x.traceId"), F.lit("span_id"), F.col("x.spanId")), lambda k, v: v.isNotNull()
    )
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(added, k))
    return two.select(
        F.coalesce(F.nullif(_texts(F.col("resource.attributes"), listed)["service.name"], F.lit("")), F.lit("unknown")).alias("_s"),
        F.when(ns > 0, F.timestamp_millis(F.expr("try_cast(x.timeUnixNano AS BIGINT) div 1000000"))).otherwise(F.current_timestamp()).alias("_t"),
        level.alias("_l"), F.coalesce("x.body.stringValue", F.lit("")).alias("_m"), F.map_concat(kept, added).alias("attributes"), F.col("x.traceId").alias("_traceid"), F.col("x.spanId").alias("_spanid"),
    )
