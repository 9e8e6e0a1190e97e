"""Joins that Spark SQL has no word for."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], tie: str | None = None, right_time: str | None = None) -> DataFrame:
    """Each left row with the ``values`` of the last right row of its ``keys`` at or before its ``time``; null if there is none.

    Of right rows at one time the greatest ``tie`` wins (by default the greatest values). Rows meet by key and day: the
    last right row of each day is carried over to later days as one small row, so a key with a long history is many
    tasks. ``values`` may not be names of left columns.
    """
    right_time = right_time or time
    day = lambda df: df.withColumn("_day", F.to_date("_time"))
    rank = F.struct(F.col(right_time).alias("t"), *([F.col(tie).alias("tie")] if tie else []), *[F.col(v).alias(f"v_{v}") for v in values])
    r = day(right.dropna(subset=[*keys, right_time]).select(*[F.col(k) for k in keys], F.col(right_time).alias("_time"), rank.alias("_right")))
    row = left.select(*[F.col(k) for k in keys], F.col(time).alias("_time"), F.struct(*left.columns).alias("_left"))
    days = r.groupBy(*keys, "_day").agg(F.max("_right").alias("_last")).unionByName(day(row).select(*keys, "_day").distinct(), allowMissingColumns=True)
    days = days.groupBy(*keys, "_day").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*keys, "_day", F.last("_last", ignorenulls=True).over(before).alias("_carried")).where("_carried IS NOT NULL")
    both = day(row).unionByName(r, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_day").orderBy("_time", F.col("_right").isNull(), "_right").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_own", F.last("_right", ignorenulls=True).over(so_far)).where("_left IS NOT NULL").join(carried, [*keys, "_day"], "left")
    best = F.coalesce("_own", "_carried")
    return met.select("_left.*", *[best[f"v_{v}"].alias(v) for v in values])
