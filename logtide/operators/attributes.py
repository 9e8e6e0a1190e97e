"""Attribute maps: how often each key occurs, its type, promotion to columns and the JSON overflow column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys that become columns, and the least share of rows a key must be in.
MOST_KEYS, LEAST_SHARE = 100, 0.1
_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"


def census(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """``(key, n, type)`` over all rows: one pass of partial counts by key, whatever the number of keys.

    Values are JSON texts of scalars or plain texts. Nulls count as present and give way to any type; all int, then all
    bigint, all double, all boolean, all timestamp, else string; a key with nulls only is string. The order of rows
    never matters.
    """
    rows = df.select(F.explode(attributes).alias("key", "value"))
    all_of = lambda c: F.coalesce(F.bool_and(F.when(F.col("value").isNotNull(), c)), F.lit(False))
    fits = lambda t: all_of(F.col("value").try_cast(t).isNotNull())
    kind = F.when(fits("int"), "int").when(fits("bigint"), "bigint").when(fits("double"), "double").when(all_of(F.lower("value").isin("true", "false")), "boolean")
    kind = kind.when(all_of(F.col("value").rlike(_TIME) & F.col("value").try_cast("timestamp").isNotNull()), "timestamp").otherwise("string")
    return rows.groupBy("key").agg(F.count("*").alias("n"), kind.alias("type"))


def resolve(counts: DataFrame, rows: int, most: int = MOST_KEYS, least: float = LEAST_SHARE) -> DataFrame:
    """``counts`` with ``overflow``: true for keys in under ``least`` of the ``rows``, and for all keys if there are over ``most``."""
    many = counts.agg((F.count("*") > most).alias("many"))  # one row
    return counts.join(F.broadcast(many)).select("key", "n", "type", (F.col("many") | (F.col("n") < least * rows)).alias("overflow"))


def promoted(counts: DataFrame, rows: int, most: int = MOST_KEYS, least: float = LEAST_SHARE) -> list[tuple[str, str]]:
    """Keys that become columns, with their types, by name: ``most`` at most, as more keys all overflow."""
    return [(r.key, r.type) for r in resolve(counts, rows, most, least).where("NOT overflow").orderBy("key").collect()]


def promote(df: DataFrame, keys: list[tuple[str, str]], attributes: str = "attributes", meta: str = "_meta") -> DataFrame:
    """Each key of ``keys`` as a column of its type; the rest as JSON text in ``meta``, null if there is none.

    A key named like a column of ``df``, letter case aside, stays in ``meta``, and so does a value that its column's
    type cannot hold, so nothing is lost. ``meta`` keeps numbers and booleans as such where their text is JSON's own.
    """
    taken = {c.lower() for c in [*df.columns, meta]}
    fit = []
    for k, t in keys:
        if k.lower() not in taken:
            taken.add(k.lower())
            fit.append((k, t))
    value = lambda k: F.col(attributes)[k]
    cols = [value(k).try_cast(t).alias(k) for k, t in fit]
    rest: Column = F.col(attributes)
    if fit:
        def stays(k: Column, v: Column) -> Column:
            held = F.lit(False)
            for name, t in fit:
                held = held | ((k == name) & (v.isNull() | v.try_cast(t).isNotNull()))
            return ~held

        rest = F.map_filter(attributes, stays)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != attributes], *cols, F.when(F.size(rest) > 0, _json(rest)).alias(meta))


def _json(attributes: Column) -> Column:
    """JSON text of a map of texts; numbers, booleans and null stand without quotes."""
    bare = lambda v: v.rlike(r"^(-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false)$")
    text = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    pair = lambda e: F.concat(text(e["key"]), F.lit(":"), F.when(e["value"].isNull(), "null").when(bare(e["value"]), e["value"]).otherwise(text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(attributes), pair), ","), F.lit("}"))


def meta_value(key: str, meta: str = "_meta") -> Column:
    """One attribute out of the overflow."""
    return F.from_json(meta, "map<string,string>")[key]


def unpacked(df: DataFrame, fixed: list[str], meta: str = "_meta", attributes: str = "attributes") -> DataFrame:
    """The map again: promoted columns that are not null, and the overflow over them; bad JSON adds nothing."""
    own = [c for c in df.columns if c not in (*fixed, meta)]
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in own])) if own else F.create_map().cast("map<string,string>")
    more = F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(pairs, lambda k, v: v.isNotNull() & ~F.map_contains_key(more, k))
    return df.select(*[F.col(f"`{c}`") for c in fixed], F.map_concat(kept, more).alias(attributes))


def align(df: DataFrame, schema: dict[str, str], meta: str = "_meta") -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones are null, others go to ``meta`` beside what it held."""
    extra = [c for c in df.columns if c not in schema and c != meta]
    have = {c: F.col(f"`{c}`") for c in df.columns}
    cols = [have[c].try_cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in schema.items() if c != meta]
    old = F.coalesce(F.from_json(have[meta], "map<string,string>"), F.create_map().cast("map<string,string>")) if meta in have else F.create_map().cast("map<string,string>")
    new = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), have[c].cast("string").alias("value")) for c in extra])) if extra else F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter(old, lambda k, v: ~k.isin(extra)) if extra else old, F.map_filter(new, lambda k, v: v.isNotNull()))
    return df.select(*cols, F.when(F.size(both) > 0, _json(both)).alias(meta))
