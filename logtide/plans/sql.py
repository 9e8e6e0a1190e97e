"""Registered queries in SQL over the driver tables: what any SQL user of the log engine runs, in Spark's spelling and in DuckDB's."""

from datetime import datetime

from pyspark.sql import functions as F

from logtide.operators import attributes, logs, tables

_D = "CAST(sum(CAST({0} AS DECIMAL(18,4))) AS DOUBLE)"

#: Name to (tables, Spark SQL, DuckDB SQL or None where both read the same text).
STATEMENTS = {
    "join_left": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", None),
    "join_right": ("nation supplier", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000", None),
    "join_full": ("customer supplier", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) s ON c_nationkey = s_nationkey", None),
    "join_in_subquery": ("orders customer", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", None),
    "join_chain": ("lineitem orders customer nation region", f"SELECT r_name, n_name, {_D.format('l_extendedprice')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name", None),
    "join_trace": ("events", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) WHERE a.event_type = 'error' AND b.event_type = 'purchase'", None),
    "join_interval": ("events", "SELECT a.event_id, count(b.event_id) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL 1 HOUR AND b.ts < a.ts WHERE a.event_type = 'error' GROUP BY a.event_id", None),
    "join_lateral": ("customer orders", "SELECT c_custkey, x.n FROM customer JOIN LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') x ON true", None),
    "agg_count": ("events", "SELECT count(*) AS n FROM events", None),
    "agg_filter": ("lineitem", f"SELECT l_shipdate, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, {_D.format('l_quantity')} AS quantity, min(l_tax) AS least, max(l_tax) AS most FROM lineitem GROUP BY l_shipdate", None),
    "agg_avg": ("lineitem", "SELECT l_returnflag, round(avg(l_extendedprice), 2) AS mean FROM lineitem GROUP BY l_returnflag", None),
    "agg_distinct": ("events", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type", None),
    "agg_percentile": ("lineitem", "SELECT l_linestatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS median FROM lineitem GROUP BY l_linestatus", None),
    "agg_having": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 12", None),
    "agg_cube": ("lineitem", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "agg_grouping_sets": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "window_ranking": ("orders", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS q, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "window_analytic": ("events", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(event_id) OVER w AS first, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "window_rows": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM events", None),
    "window_range_interval": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events", None),
    "topk_offset": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10", None),
    "set_union": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "set_intersect": ("customer orders", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", None),
    "set_except": ("customer orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0", None),
    "join_theta": ("nation supplier", "SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey > n_nationkey AND s_acctbal > 100 * n_nationkey GROUP BY n_name", None),
    "cte_recursive": ("orders", "WITH RECURSIVE m(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM m WHERE k < 12) SELECT k, count(o_orderkey) AS n FROM m LEFT JOIN orders ON extract(MONTH FROM o_orderdate) = k GROUP BY k", None),
    "cte": ("orders", "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM orders o JOIN big b ON o.o_custkey = b.o_custkey AND o.o_totalprice = b.top", None),
    "dedupe": ("events", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, ts, event_id"),
    "pivot": ("events", "SELECT * FROM (SELECT user_id, event_type FROM events) PIVOT (count(event_type) FOR event_type IN ('click' AS click, 'error' AS error, 'view' AS view))", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id"),
    "unpivot": ("part", "SELECT p_partkey, what, amount FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (amount FOR what IN (size, price))", None),
    "expression_filter": ("events", "SELECT event_id FROM events WHERE (try_cast(split_part(event_type, 'r', 1) AS INT) IS NULL AND value BETWEEN 10 AND 50 AND event_type NOT LIKE 'c%')", None),
    "json_extract": ("events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "functions_text": ("part", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substr(p_type, 2, 4) AS s, replace(p_brand, '#', '-') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS d, concat(p_brand, '/', p_type) AS c FROM part", None),
    "functions_time": ("orders", "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS us FROM orders", "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, epoch_us(o_orderdate) AS us FROM orders"),
    "functions_math": ("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_orderkey % 7 AS r, abs(l_tax - 1) AS a, floor(l_quantity / 3) AS f FROM lineitem", None),
    "functions_array": ("orders", "SELECT k, size(a) AS n, element_at(a, 1) AS first, array_contains(a, 3) AS has FROM (SELECT o_custkey AS k, sort_array(collect_set(month(o_orderdate))) AS a FROM orders GROUP BY o_custkey)", "SELECT k, len(a) AS n, a[1] AS first, list_contains(a, 3) AS has FROM (SELECT o_custkey AS k, list_sort(list(DISTINCT month(o_orderdate))) AS a FROM orders GROUP BY o_custkey)"),
}


def _run(names: str, text: str):
    def query(spark, d):
        return logs.sql(spark, text, streams={n: spark.read.parquet(f"{d}/{n}.parquet") for n in names.split()})

    return query


def _maps(spark, d):
    """Attributes of every kind: in all rows, in some, in few, of mixed types, and one named like a column."""
    n, text = F.col("event_id"), lambda c: c.cast("string")
    every = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("ratio"), text(n / 4), F.lit("even"), text(n % 2 == 0), F.lit("event_id"), F.lit("own"))
    half = F.create_map(F.lit("big"), text(n * 3000000000), F.lit("mixed"), F.when(n % 4 == 0, "a\"b").otherwise("7"))
    few = F.create_map(F.lit("rare"), text(n))
    none = F.create_map().cast("map<string,string>")
    parts = F.map_concat(every, F.when(n % 2 == 0, half).otherwise(none), F.when(n % 50 == 0, few).otherwise(none))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", parts.alias("attributes"))


def _census(spark, d):
    df = _maps(spark, d)
    return attributes.resolve(attributes.census(df), df.count())


def _promoted(spark, d):
    df = _maps(spark, d)
    return attributes.promote(df, attributes.promoted(attributes.census(df), df.count()))


def _unpacked(spark, d):
    """Every key and value out of promoted columns and overflow again."""
    rows = attributes.unpacked(_promoted(spark, d), ["event_id"])
    return rows.select("event_id", F.explode("attributes").alias("key", "value")).groupBy("key").agg(F.count("value").alias("n"), F.sum(F.length("value")).alias("size"))


def _aligned(spark, d):
    """Promoted rows under the schema of an earlier file."""
    return attributes.align(_promoted(spark, d), {"event_id": "bigint", "k": "bigint", "gone": "double"}).select("event_id", "k", "gone", attributes.meta_value("rare").alias("rare"), attributes.meta_value("mixed").alias("mixed"))


def _widened(spark, d):
    """Int, bigint and text under one name."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return tables.union_widening([
        e.where("event_id % 3 = 0").select("event_id", F.col("user_id").cast("int").alias("x")), e.where("event_id % 3 = 1").select("event_id", F.col("user_id").alias("x"), "value"),
        e.where("event_id % 3 = 2").select("event_id", F.col("event_type").alias("x")),
    ])


def _approximate(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"))


def _union_by_name(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    noon = F.lit(datetime(2024, 1, 15))
    return tables.hot_and_cold(e.where(F.col("ts") < noon).select("event_id", "value"), e.where(F.col("ts") >= noon).select("event_type", "event_id"))


QUERIES = {k: _run(v[0], v[1]) for k, v in STATEMENTS.items()} | {
    "attribute_census": _census, "attribute_promotion": _promoted, "meta_unpack": _unpacked, "schema_align": _aligned, "union_by_name": _union_by_name, "union_by_name_widen": _widened, "agg_approximate": _approximate,
    "sample": _run("events", "SELECT * FROM events TABLESAMPLE (10 PERCENT) REPEATABLE (7)"),
}
_KEYS = """SELECT 'k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT 'ratio', CAST(event_id / 4 AS VARCHAR) FROM events
 UNION ALL SELECT 'even', CAST(event_id % 2 = 0 AS VARCHAR) FROM events UNION ALL SELECT 'event_id', 'own' FROM events UNION ALL SELECT 'big', CAST(event_id * 3000000000 AS VARCHAR) FROM events WHERE event_id % 2 = 0
 UNION ALL SELECT 'mixed', CASE WHEN event_id % 4 = 0 THEN 'a"b' ELSE '7' END FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'rare', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 50 = 0"""
ORACLE_SQL = {k: v[2] or v[1] for k, v in STATEMENTS.items()} | {
    "attribute_census": f"""WITH m AS ({_KEYS}) SELECT key, count(*) AS n, CASE key WHEN 'k' THEN 'int' WHEN 'ratio' THEN 'double' WHEN 'even' THEN 'boolean' WHEN 'big' THEN 'bigint' WHEN 'rare' THEN 'int' ELSE 'string' END AS type,
 count(*) < 0.1 * (SELECT count(*) FROM events) AS overflow FROM m GROUP BY key""",
    "attribute_promotion": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id / 4 AS ratio, event_id % 2 = 0 AS even, CASE WHEN event_id % 2 = 0 THEN event_id * 3000000000 END AS big,
 CASE WHEN event_id % 4 = 0 THEN 'a"b' WHEN event_id % 2 = 0 THEN '7' END AS mixed, '{"event_id":"own"' || CASE WHEN event_id % 50 = 0 THEN ',"rare":' || event_id ELSE '' END || '}' AS _meta FROM events""",
    "meta_unpack": f"WITH m AS ({_KEYS}) SELECT key, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS size FROM m GROUP BY key",
    "schema_align": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS gone, CASE WHEN event_id % 50 = 0 THEN CAST(event_id AS VARCHAR) END AS rare,
 CASE WHEN event_id % 4 = 0 THEN 'a"b' WHEN event_id % 2 = 0 THEN '7' END AS mixed FROM events""",
    "union_by_name_widen": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS x, CASE WHEN event_id % 3 = 1 THEN value END AS value FROM events",
    "union_by_name": "SELECT event_id, value FROM events WHERE ts < TIMESTAMP '2024-01-15' UNION ALL BY NAME SELECT event_type, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
}
