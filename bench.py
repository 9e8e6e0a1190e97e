"""Times the log queries and ingest; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logtide.operators import tables
from logtide.plans import catalog, sql, stored
from logtide.sources import ingest

d, n = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
spark = SparkSession.builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", n).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
took = {}
for name, f in (catalog.QUERIES | sql.QUERIES | stored.QUERIES).items():
    f(spark, d).write.format("noop").mode("overwrite").save()
    began = time.time()
    f(spark, d).write.format("noop").mode("overwrite").save()
    took[name] = round(time.time() - began, 3)
# The published baseline appends batches of 1,000 entries of five attributes; here the same entries come as JSON, are parsed, checked and stored.
folder = tempfile.mkdtemp(prefix="spark-bench-")
e = spark.read.parquet(f"{d}/events.parquet")
attributes = F.struct(*[F.col("event_id").cast("string").alias(f"a{k}") for k in range(5)])
entry = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_t"), F.lit("INFO").alias("_l"), F.rpad("event_type", 85, "x").alias("_m"), attributes.alias("attributes"))
batches = e.groupBy(F.floor(F.col("event_id") / 1000)).agg(F.to_json(F.struct(F.lit("bench").alias("_s"), F.collect_list(entry).alias("entries"))).alias("value"))
batches.select("value").write.text(f"{folder}/in")
rows, rate = e.count(), 0.0
for turn in range(2):
    began = time.time()
    tables.append(ingest.json_entries(spark.read.text(f"{folder}/in"))[0], f"{folder}/root", turn + 1)
    rate = rows / (time.time() - began)
print(json.dumps({"metric": "log_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "ingest_rows_per_sec": round(rate), "sf": d.rsplit("sf", 1)[-1]}))
