"""The ready-made log queries, over a frame with the fixed log columns ``_s _t _l _m``."""

import re
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def between(df: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Inclusive bounds on ``_t``, cut to whole seconds; both reach the scan as pushed filters.

    Frames of ``tables.scan`` get the same bounds on ``day`` and ``month``, which prune folders before any file is opened.
    """
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        bound = bound.replace(microsecond=0)
        keep = lambda c, v: F.col(c) >= F.lit(v) if low else F.col(c) <= F.lit(v)  # noqa: B023, E731
        df = df.where(keep("_t", bound))
        for c, v in (("day", bound.date()), ("month", bound.date().replace(day=1))):
            if dict(df.dtypes).get(c) == "date":
                df = df.where(keep(c, v))
    return df


def within(column: str | Column, intervals: Iterable[tuple[datetime, datetime]]) -> Column:
    """Whether a time lies in any of the closed ``intervals``: overlapping ones merged, an OR of BETWEENs that is pushed down."""
    merged: list[list[datetime]] = []
    for start, end in sorted(x for x in intervals if x[0] <= x[1]):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    c, out = F.col(column) if isinstance(column, str) else column, F.lit(False)
    for k, (start, end) in enumerate(merged):
        out = c.between(F.lit(start), F.lit(end)) if not k else out | c.between(F.lit(start), F.lit(end))
    return out


def null_shorthand(expression: str) -> str:
    """``x != null`` and ``x <> null`` as IS NOT NULL, ``x = null`` as IS NULL; text in quotes stays as it is."""
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)", expression)
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"(?i)\s*(?:!=|<>)\s*null\b", " IS NOT NULL", parts[k])
        parts[k] = re.sub(r"(?i)\s*(?<![<>!=])==?\s*null\b", " IS NULL", parts[k])
    return "".join(parts)


def newest(df: DataFrame, limit: int, tie: tuple[str, ...] = ("_s", "_m")) -> DataFrame:
    """The newest entries first; equal times go by ``tie``."""
    return df.orderBy(F.desc("_t"), *[F.col(c).asc_nulls_last() for c in tie]).limit(limit)


def logs(df: DataFrame, start=None, end=None, level: str | None = None, limit: int = 1000, where: str | None = None, tie: tuple[str, ...] = ("_s", "_m")) -> DataFrame:
    """Newest entries first, of a level, within bounds and by any SQL condition ``where``, null shorthand included."""
    df = between(df, start, end)
    if level:
        df = df.where(F.col("_l") == level.lower())
    if where:
        df = df.where(F.expr(null_shorthand(where)))
    return newest(df, limit, tie)


def search(df: DataFrame, text: str, limit: int = 1000, start=None, end=None, tie: tuple[str, ...] = ("_s", "_m")) -> DataFrame:
    """Newest entries whose message or stream holds ``text``; ``%`` and ``_`` in it are wildcards."""
    if not text.strip():
        raise ValueError("the search text is blank")
    like = "%" + text.replace("\\", "\\\\") + "%"
    return newest(between(df, start, end).where(F.col("_m").ilike(like) | F.col("_s").ilike(like)), limit, tie)


def stats(df: DataFrame, start=None, end=None) -> DataFrame:
    """A row for each level, most frequent first."""
    return (
        between(df, start, end)
        .groupBy("_l")
        .agg(
            F.count("*").alias("total_count"),
            F.max(F.when(F.col("_l").isNotNull(), 1).otherwise(0)).cast("long").alias("level_count"),
            F.min("_t").alias("earliest_timestamp"),
            F.max("_t").alias("latest_timestamp"),
            F.count("*").alias("count_by_level"),
        )
        .orderBy(F.desc("count_by_level"), "_l")
    )


def sql(spark: SparkSession, text: str, params: dict | list | None = None, streams: dict[str, DataFrame] | None = None) -> DataFrame:
    """Runs Spark SQL over ``streams`` by their names, which may hold any characters, with ``params`` for its markers.

    The names are views while the text is analysed and gone afterwards.
    """
    streams = streams or {}
    for name, df in streams.items():
        df.createOrReplaceTempView(f"`{name}`")
    try:
        return spark.sql(text, args=params)
    finally:
        for name in streams:
            spark.catalog.dropTempView(name)
