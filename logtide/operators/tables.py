"""Stored streams: Parquet by batch, stream and day; compaction of closed days and months; all tiers as one frame.

A root folder has three tiers: ``hot/batch=/stream=/day=``, ``daily/stream=/period=/through=`` and
``monthly/stream=/period=/through=``. ``through`` is the last batch whose rows a compacted folder holds, so readers know
from folder names alone which rows a folder replaces: nothing is counted twice or lost between a compaction and the
clean-up after it, and a compaction that fails leaves folders that no reader sees or that are whole.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)
#: Columns that the tiers add.
PLACE = ["stream", "day", "month"]


def fold(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: null gives way, integers widen, numbers become double, anything else is text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, _WHOLE + _REAL) and isinstance(b, _WHOLE + _REAL):
        return T.DoubleType()
    return T.StringType()


def union_widening(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column that frames hold in different types takes the type that holds all of them."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds[f.name] = fold(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    out = None
    for df in frames:
        cast = df.select([F.col(f"`{f.name}`") if f.dataType == kinds[f.name] else F.col(f"`{f.name}`").cast(kinds[f.name]).alias(f.name) for f in df.schema])
        out = cast if out is None else out.unionByName(cast, allowMissingColumns=True)
    return out


def hot_and_cold(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Union by name with widening; columns that one side lacks are null there."""
    return union_widening([cold, hot])


def _same_schema(spark: SparkSession, base: str, files: list[str]) -> list[list[str]]:
    """``files`` in groups that Spark can merge: all, or halves of halves; only footers are read, by Spark's tasks."""
    try:
        _ = spark.read.option("basePath", base).option("mergeSchema", "true").parquet(*files).schema
        return [files]
    except (PySparkException, Py4JJavaError) as e:
        if len(files) == 1 or "CANNOT_MERGE_SCHEMAS" not in str(e):
            raise
        middle = len(files) // 2
        return _same_schema(spark, base, files[:middle]) + _same_schema(spark, base, files[middle:])


def _files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files under ``path``, as Spark lists them; one footer is read."""
    try:
        return sorted(map(unquote, spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "false").parquet(path).inputFiles()))
    except AnalysisException:
        return []


def read_folder(spark: SparkSession, path: str, partitions: str = "") -> DataFrame | None:
    """All files under ``path`` with the columns of all of them, widened; None if there is none.

    ``partitions`` gives the partition columns' types, as in ``stream string, day date``; names are never guessed at.
    """
    files = _files(spark, path)
    if not files:
        return None
    named = T._parse_datatype_string(partitions).fields if partitions else []
    frames: dict[str, tuple[T.StructType, list[str]]] = {}
    for group in _same_schema(spark, path, files):
        schema = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*group).schema
        plain = T.StructType([f for f in schema if f.name not in {p.name for p in named}] + named)
        frames.setdefault(plain.json(), (plain, []))[1].extend(group)
    whole = len(frames) == 1  # then Spark lists the folder itself and prunes its partitions
    return union_widening([spark.read.option("basePath", path).schema(s).parquet(*([path] if whole else g)) for s, g in frames.values()])


def append(df: DataFrame, root: str, batch: int | None = None) -> int:
    """Adds entries as one batch and returns its number; a batch that is written again replaces itself.

    One writer at a time: numbers follow each other. One shuffle on stream and day keeps files few, AQE splits hot days.
    """
    if batch is None:
        batch = last_batch(df.sparkSession, root) + 1
    rows = df.withColumn("stream", F.col("_s")).withColumn("day", F.to_date("_t"))
    rows.hint("rebalance", "stream", "day").write.mode("overwrite").option("compression", "zstd").partitionBy("stream", "day").parquet(f"{root}/hot/batch={batch}")
    return batch


def _hot(spark: SparkSession, root: str) -> DataFrame | None:
    return read_folder(spark, f"{root}/hot", "batch bigint, stream string, day date")


def _tier(spark: SparkSession, root: str, tier: str) -> DataFrame | None:
    return read_folder(spark, f"{root}/{tier}", "stream string, period date, through bigint")


def last_batch(spark: SparkSession, root: str) -> int:
    """The greatest batch number of any tier, by the names of folders; 0 for an empty root."""
    found = (re.findall(r"/(?:batch|through)=(\d+)/", f)[-1:] for tier in ("hot", "daily", "monthly") for f in _files(spark, f"{root}/{tier}"))
    return max((int(m[0]) for m in found if m), default=0)


def _visible(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The rows of each tier that no later tier holds too; the newest of a period's folders replaces the others."""
    hot, daily, monthly = _hot(spark, root), _tier(spark, root, "daily"), _tier(spark, root, "monthly")
    out, newest = {}, {}
    if monthly is not None:
        newest["m"] = monthly.groupBy("stream", F.col("period").alias("month")).agg(F.max("through").alias("in_month"))
        rows = monthly.withColumnRenamed("period", "month").join(newest["m"], ["stream", "month"])
        out["monthly"] = rows.where("through = in_month").drop("through", "in_month").withColumn("day", F.to_date("_t"))
    month = lambda df: df.withColumn("month", F.trunc("day", "month"))
    if daily is not None:
        days = month(daily.withColumnRenamed("period", "day"))
        if monthly is not None:
            days = days.join(newest["m"], ["stream", "month"], "left").where("through > coalesce(in_month, 0)").drop("in_month")
        newest["d"] = days.groupBy("stream", "day").agg(F.max("through").alias("in_day"))
        out["daily"] = days.join(newest["d"], ["stream", "day"]).where("through = in_day").drop("through", "in_day")
    if hot is not None:
        rows = month(hot)
        if monthly is not None:
            rows = rows.join(newest["m"], ["stream", "month"], "left").where("batch > coalesce(in_month, 0)").drop("in_month")
        if daily is not None:
            rows = rows.join(newest["d"], ["stream", "day"], "left").where("batch > coalesce(in_day, 0)").drop("in_day")
        out["hot"] = rows.drop("batch")
    return out


def scan(spark: SparkSession, root: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """All entries of a root, each once, with ``stream``, ``day`` and ``month``; day bounds prune folders of all tiers.

    Files of different columns and types are read by name into the widest type. A root without files is an empty frame
    of the fixed columns.
    """
    parts = list(_visible(spark, root).values())
    df = union_widening(parts) if parts else spark.createDataFrame([], "_s string, _t timestamp, _l string, _m string, _traceid string, _spanid string, _duration_ms int, stream string, day date, month date")
    if start is not None:
        df = df.where((F.col("month") >= F.lit(start.replace(day=1))) & (F.col("day") >= F.lit(start)))
    return df if end is None else df.where((F.col("month") <= F.lit(end.replace(day=1))) & (F.col("day") <= F.lit(end)))


def compact(spark: SparkSession, root: str, now: date | datetime, tier: str = "daily", rows_per_file: int = 0) -> int:
    """Moves closed days (``daily``) or months (``monthly``) that have newer rows into sorted files; returns the last batch held.

    Only periods with rows in an earlier tier are written, together with what the tier held of them. Range partitioning
    by stream and time splits a stream that holds most rows; ``rows_per_file`` caps the rows of a file. The open day or
    month stays. Rows that come late for a closed period go with the next run; ``vacuum`` deletes what is replaced.
    """
    today = now.date() if isinstance(now, datetime) else now
    through, seen = last_batch(spark, root), _visible(spark, root)
    unit, closed = ("month", F.col("month") < F.lit(today.replace(day=1))) if tier == "monthly" else ("day", F.col("day") < F.lit(today))
    fresh = [df.where(closed) for k, df in seen.items() if k == "hot" or (tier == "monthly" and k == "daily")]
    if not fresh:
        return through
    touched = union_widening([df.select("stream", unit) for df in fresh]).distinct()
    old = [seen[tier].where(closed).join(touched, ["stream", unit], "left_semi")] if tier in seen else []
    rows = union_widening(fresh + old).withColumn("period", F.col(unit)).drop("day", "month").withColumn("through", F.lit(through).cast("bigint"))
    laid = rows.repartitionByRange("stream", "period", "_t").sortWithinPartitions("stream", "period", "_t")
    writer = laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy("stream", "period", "through").parquet(f"{root}/{tier}")
    return through


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes the folders whose rows a later folder holds; returns how many. Run it when no reader of an older plan is left."""
    kept: dict[str, set] = {}
    keys = {"hot": ["batch", "stream", "day"], "daily": ["stream", "period", "through"], "monthly": ["stream", "period", "through"]}
    hot, daily, monthly = _hot(spark, root), _tier(spark, root, "daily"), _tier(spark, root, "monthly")
    there = {k: {tuple(r) for r in df.select(keys[k]).distinct().collect()} for k, df in (("hot", hot), ("daily", daily), ("monthly", monthly)) if df is not None}
    month: dict = {}
    for s, p, t in there.get("monthly", ()):
        month[s, p] = max(t, month.get((s, p), 0))
    day: dict = {}
    for s, p, t in there.get("daily", ()):
        if t > month.get((s, p.replace(day=1)), 0):
            day[s, p] = max(t, day.get((s, p), 0))
    kept["monthly"] = {(s, p, t) for (s, p), t in month.items()}
    kept["daily"] = {(s, p, t) for (s, p), t in day.items()}
    kept["hot"] = {(b, s, d) for b, s, d in there.get("hot", ()) if b > max(month.get((s, d.replace(day=1)), 0), day.get((s, d), 0))}
    jvm, n = spark._jvm, 0
    folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for tier, folders in there.items():
        for key in folders - kept[tier]:
            path = jvm.org.apache.hadoop.fs.Path("/".join([root, tier, *(f"{k}={folder(str(v))}" for k, v in zip(keys[tier], key))]))
            n += bool(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True))
    return n


def streams(entries: DataFrame) -> DataFrame:
    """Streams in order of their names."""
    return entries.select(F.col("_s").alias("stream")).distinct().orderBy("stream")


def summary(entries: DataFrame) -> DataFrame:
    """A row for each stream: its entries, first and last time, and bytes of message text."""
    return entries.groupBy(F.col("_s").alias("stream")).agg(
        F.count("*").alias("n"), F.min("_t").alias("first_time"), F.max("_t").alias("last_time"), F.coalesce(F.sum(F.octet_length("_m")), F.lit(0)).alias("message_bytes")
    )


def schema(entries: DataFrame) -> DataFrame:
    """A row for each column: name, type, whether it may be null, and how many values it holds, in one pass."""
    held = entries.select([F.count(F.col(f"`{f.name}`")).alias(f"c{k}") for k, f in enumerate(entries.schema)])
    rows = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.col(f"c{k}").alias("n_values")) for k, f in enumerate(entries.schema)]
    return held.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
