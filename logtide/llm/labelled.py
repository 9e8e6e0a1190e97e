"""Labelled rows for the two trained scorers: who may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


#: Most bytes of a text that is learned from: with the bound on rows, it bounds what a fit holds. Scoring takes any text whole.
LONGEST = 1 << 17


def sample(docs: DataFrame, labels: DataFrame, target: str, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """``(id, text, label)`` of at most ``per_class[label]`` labelled rows of each label, none of them held out.

    Rows are taken by a hash of their id, so that the choice is the same every time and in every order. The ids are a
    table of at most ``sum(per_class.values())`` rows, which bounds what is broadcast; texts over ``longest`` bytes are
    left out, which bounds what is collected. Null ids, labels and texts are left out too; an id with several labels
    has the least, one with several texts the least of them. No row is left out of scoring.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(target).cast("int").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    ids = None
    for label, bound in per_class.items():
        part = rows.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(bound)
        ids = part if ids is None else ids.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= longest)
    return texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
