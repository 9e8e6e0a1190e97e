"""The registered queries of the log engine and their SQL."""

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from logtide.functions import normalize
from logtide.operators import joins, tables
from logtide.operators import logs as op

VIEW = """(SELECT 'events' AS _s, ts AS _t, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
 WHEN 'signup' THEN NULL ELSE 'info' END AS _l, concat(event_type, ' user ', user_id) AS _m, user_id, value, event_id FROM events)"""
_SPANS = [(datetime(2024, 1, 3), datetime(2024, 1, 4)), (datetime(2024, 1, 20), datetime(2024, 1, 20, 1, 30)), (datetime(2024, 1, 3, 12), datetime(2024, 1, 4, 6)), (datetime(2024, 1, 9), datetime(2024, 1, 8))]
_A, _B = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)


def view(spark, d):
    kind = F.col("event_type")
    lev = F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "signup", None).otherwise("info")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.lit("events").alias("_s"), F.col("ts").alias("_t"), lev.alias("_l"), F.concat("event_type", F.lit(" user "), "user_id").alias("_m"), "user_id", "value", "event_id"
    )


def _by_kind(spark, d):
    return view(spark, d).withColumn("_s", F.element_at(F.split("_m", " "), 1))


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _asof(s, d):
    """Each purchase with the latest earlier error of the same user."""
    e = table(s, d, "events")
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return joins.asof_join(e.where("event_type = 'purchase'"), errors, ["user_id"], "ts", ["error_id"], "error_id").select("event_id", "error_id")


def _spelled(s, d):
    """Every spelling of a level, and others, in turn over the events."""
    names = [x for v in normalize.LEVELS.values() for x in v] + ["custom", ""]
    said = F.element_at(F.array(*[F.lit(f" {n.upper()} ") if k % 2 else F.lit(n) for k, n in enumerate(names)]), (F.col("event_id") % len(names) + 1).cast("int"))
    return table(s, d, "events").select("event_id", normalize.level(said).alias("level"))


_SPELLED = [(n, k) for k, v in normalize.LEVELS.items() for n in v] + [("custom", "custom"), ("", "")]


def _latest(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id", "ts")


def _money(c):
    return F.sum(F.col(c).cast("decimal(18,4)")).cast("double")


_STATS = "SELECT _l, count(*) AS total_count, count(DISTINCT _l) AS level_count, min(_t) AS earliest_timestamp, max(_t) AS latest_timestamp, count(*) AS count_by_level FROM {v} {w} GROUP BY _l"
_RANGE = "WHERE _t >= TIMESTAMP '2024-01-05' AND _t <= TIMESTAMP '2024-01-20 12:00:00'"
_LEVEL = "CASE " + " ".join(f"WHEN event_type IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in normalize.LEVELS.items()) + " ELSE event_type END"

ENTRIES = {
    "stats_by_level": (lambda s, d: op.stats(view(s, d)), _STATS.format(v=VIEW, w="")),
    "stats_range": (lambda s, d: op.stats(view(s, d), _A, _B), _STATS.format(v=VIEW, w=_RANGE)),
    "logs_range_level_limit": (lambda s, d: op.logs(view(s, d), _A, _B, "ERROR", 100, tie=("event_id",)), f"SELECT * FROM {VIEW} {_RANGE} AND _l = 'error' ORDER BY _t DESC, event_id LIMIT 100"),
    "search_ilike": (lambda s, d: op.search(view(s, d), "ERR", 100, tie=("event_id",)), f"SELECT * FROM {VIEW} WHERE _m ILIKE '%err%' OR _s ILIKE '%err%' ORDER BY _t DESC, event_id LIMIT 100"),
    "search_wildcards": (lambda s, d: op.search(view(s, d), "c_i%user 1", 100, tie=("event_id",)), f"SELECT * FROM {VIEW} WHERE _m ILIKE '%c_i%user 1%' OR _s ILIKE '%c_i%user 1%' ORDER BY _t DESC, event_id LIMIT 100"),
    "logs_where_null": (lambda s, d: op.logs(view(s, d), _A, None, None, 200, "_l = null AND _m != 'x = null' AND user_id <> NULL", tie=("event_id",)), f"SELECT * FROM {VIEW} WHERE _t >= TIMESTAMP '2024-01-05' AND _l IS NULL AND _m <> 'x = null' AND user_id IS NOT NULL ORDER BY _t DESC, event_id LIMIT 200"),
    "interval_list": (lambda s, d: table(s, d, "events").where(op.within("ts", _SPANS)).select("event_id", "ts"), "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04 06:00:00' OR ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20 01:30:00'"),
    "stream_names": (lambda s, d: tables.streams(_by_kind(s, d)), "SELECT DISTINCT event_type AS stream FROM events ORDER BY 1"),
    "stream_summary": (lambda s, d: tables.summary(_by_kind(s, d)), f"SELECT event_type AS stream, count(*) AS n, min(_t) AS first_time, max(_t) AS last_time, CAST(sum(strlen(_m)) AS BIGINT) AS message_bytes FROM (SELECT v.*, e.event_type FROM {VIEW} v JOIN events e USING (event_id)) GROUP BY 1"),
    "stream_schema": (lambda s, d: tables.schema(view(s, d)).select("name", "type", "n_values"), "SELECT unnest(['_s','_t','_l','_m','user_id','value','event_id']) AS name, unnest(['string','timestamp_ntz','string','string','bigint','double','bigint']) AS type, unnest([count(_s), count(_t), count(_l), count(_m), count(user_id), count(value), count(event_id)]) AS n_values FROM " + VIEW),
    "sql_parameters": (lambda s, d: op.sql(s, "SELECT _l, count(*) AS n FROM `my-stream` WHERE value > :least AND _m <> 'FROM events' GROUP BY _l", {"least": 20}, {"my-stream": view(s, d)}), f"SELECT _l, count(*) AS n FROM {VIEW} WHERE value > 20 AND _m <> 'FROM events' GROUP BY _l"),
    "norm_level": (lambda s, d: table(s, d, "events").select("event_id", normalize.level(F.col("event_type")).alias("level")), f"SELECT event_id, {_LEVEL} AS level FROM events"),
    "norm_level_spellings": (_spelled, f"SELECT event_id, [{', '.join(repr(k) for _, k in _SPELLED)}][event_id % {len(_SPELLED)} + 1] AS level FROM events"),
    "norm_severity": (lambda s, d: table(s, d, "events").select("event_id", normalize.severity(F.col("event_id") % 25).alias("level")), "SELECT event_id, CASE WHEN event_id % 25 <= 5 THEN 'debug' WHEN event_id % 25 <= 9 THEN 'info' WHEN event_id % 25 <= 13 THEN 'warn' WHEN event_id % 25 <= 17 THEN 'error' ELSE 'fatal' END AS level FROM events"),
    "asof_join": (_asof, "SELECT e.event_id, r.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY ALL) r ON e.user_id = r.user_id AND e.ts >= r.ts"),
    "qualify_latest_per_user": (_latest, "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "join_inner": (lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), _money("o_totalprice").alias("total")), "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "join_semi": (lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_anti": (lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderkey % 5 = 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 = 0)"),
    "agg_rollup": (lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "time_bucket_hour": (lambda s, d: table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n")), "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1"),
}
QUERIES = {k: v[0] for k, v in ENTRIES.items()}
ORACLE_SQL = {k: v[1] for k, v in ENTRIES.items()}
