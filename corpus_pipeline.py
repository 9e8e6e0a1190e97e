"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import bpe, contamination, near, rules, suffix
from logtide.llm.storage import written
from logtide.llm.workers import tidy

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    """``(row, text)``: each row as one value, which is carried along, so that no column's name can clash."""
    return docs.select(F.struct(*_COLUMNS).alias("row"), "text")


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select([F.col(f"row.{c}").alias(c) for c in _COLUMNS])


def _key(doc_id: Column, th: Column) -> Column:
    """Tells rows apart by id, null ids included, and text; never null."""
    return F.struct(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), doc_id.isNull().alias("none"), th.alias("th"))


def _text_hash(text: Column) -> Column:
    """A null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")).cast("binary"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each row whose own text passes the current policy.

    Rows with null or repeated ids, repeated rows and very long texts are judged like any other; null and empty texts
    fail; an empty table stays empty; columns beside those of documents may have any name and are dropped.
    """
    return _kept(rules.ledger(_rows(docs), "row").where(rules.passes("v1")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: five-word shingle sets of Jaccard similarity 0.8 or more.

    It is the one with the least id, null ids last, then the least text hash. Rows equal in id and text are one; rows
    that share only an id, or have none, are different documents. Null and empty texts are copies of each other; texts
    are compared whole; an empty table stays empty; other columns may have any name and are dropped.
    """
    found = near.near_copies(docs)
    order = F.struct(F.col("id").isNull().alias("n"), "id", "th")
    keep = found.groupBy("component").agg(F.min(order).alias("k")).select(_key(F.col("k.id"), F.col("k.th")).alias("key"))
    keyed = _rows(docs).select("row", _key(F.col("row.doc_id"), _text_hash(F.col("text"))).alias("key"))
    return _kept(keyed.join(keep, "key", "left_semi").dropDuplicates(["key"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of 200-byte strings, keeping the first; documents stay, characters are never split.

    Rows are told apart by id and text; null ids come first, repeated ids in the order of their text hashes, and rows
    equal in both are cut alike. Null, empty and short texts stay as they are; very long ones are cut whole; an empty
    table stays empty; other columns may have any name and are dropped.
    """
    spans = suffix.repeated_spans(docs, keep_first=True)
    marks = spans.select(_key(F.col("id"), F.col("th")).alias("key"), "spans")
    keyed = _rows(docs).select("row", _key(F.col("row.doc_id"), _text_hash(F.col("text"))).alias("key"), F.col("text").cast("binary").alias("text"))
    both = keyed.join(marks, "key", "left").select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, at in zip(batch.column(1), batch.column(2)):
                data, at = text.as_py(), at.as_py()
                if at and data:
                    raw = np.frombuffer(data, np.uint8)
                    first = np.flatnonzero(raw & 0xC0 != 0x80)  # a character goes if all of its bytes go
                    gone = np.logical_and.reduceat(suffix.removed(data, at), first)
                    data = raw[~np.repeat(gone, np.diff(np.r_[first, len(raw)]))].tobytes()
                out.append(None if data is None else data.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    done = both.mapInArrow(tidy(cut), f"row {dict(both.dtypes)['row']}, text string")
    text = F.col("text")
    changed = {"text": text, "n_chars": F.char_length(text).cast(dict(docs.dtypes)["n_chars"])}
    return done.select([changed.get(c, F.col(f"row.{c}")).alias(c) for c in _COLUMNS])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each row whose own text is contaminated.

    Rows with null or repeated ids, repeated rows and very long texts are judged like any other; null and empty texts
    stay; an empty table, or an empty benchmark, changes nothing; other columns may have any name and are dropped.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(contamination.digest(contamination.contamination(_rows(docs), bench, "row"), "row").where("NOT contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row that is left: null and repeated ids, repeated rows, null, empty and very long texts included."""
    return bpe.digest(bpe.token_rows(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("bpe", tokens),
]
#: SQL can express neither fingerprints nor merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order, each over the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
