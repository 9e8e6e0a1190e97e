"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read the bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.workers import tidy

_SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words"]

#: Rule name to failure condition over the measurements, by bit from 0. Rules are only ever added at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "upper_case": "100 * n_upper > 60 * n_letters",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "word_variety": "n_distinct_words * n_distinct_words < 4 * n_words",  # distinct words grow like the root of a text's length
}
#: Version to the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case", "word_length", "word_variety"),
}


def measure(data: bytes | None) -> list[int]:
    """The values of ``MEASURES`` for one UTF-8 text. Null counts as empty; words are runs of non-white-space ASCII-wise."""
    data = data or b""
    words = data.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8"))
    symbols = sum(map(data.count, (bytes([c]) for c in _SYMBOLS)))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    repeated = 0
    if len(words) >= 3:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
        _, which, count = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[which] > 1)
        hit = np.zeros(len(words), dtype=bool)
        for k in range(3):
            hit[twice + k] = True
        repeated = int(hit.sum())
    text = joined.decode("utf-8")
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = sum(map(str.isalpha, text))
    return [len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters, len(set(words))]


def mask(names: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, *MEASURES, failed)``: bit k of ``failed`` is set if the k-th rule fails.

    One row for each input row; null and empty texts have no words and fail ``few_words``; repeated rows stay; an
    empty table gives an empty table. Only the two named columns are read, others may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([measure(x.as_py()) for x in batch.column(1)], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.copy()) for c in got.T)], ["id", *MEASURES])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = chosen.mapInArrow(tidy(run), f"id {dict(chosen.dtypes)['id']}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return rows.select(F.col("id").alias(id_col), *MEASURES, failed.alias("failed"))


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows it fails, and rows that only it fails, from the bits alone."""
    on = mask(POLICIES[policy])
    cells = rows.groupBy(F.col("failed").bitwiseAND(F.lit(on).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    one = lambda n: F.lit(mask((n,))).cast("long")
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), one(n).alias("bit")) for n in POLICIES[policy]])).alias("r")
    return cells.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
