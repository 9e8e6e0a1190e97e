"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words and a block is two of them. Strings of one length are searched together: a shift table says
how far the window may move past a block, a suffix table holds the strings that end in a block, and a first-word
test and a direct comparison confirm each occurrence.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.storage import written
from logtide.llm.workers import tidy

#: Bytes of benchmark text in one set of search tables, which take six times as much or less. More text means more passes, not larger tables.
SHARD_BYTES = 8 << 20
#: Words of an item in one part; longer items are cut into parts that overlap by a window.
PART = 4096
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
_LOW = (1 << 32) - 1
_digest = xxhash.xxh3_64_intdigest


def words_of(data: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: digits, letters a-z after lower-casing A-Z, and everything beyond ASCII."""
    return (data or b"").translate(_TABLE).split()


class WuManber:
    """Search tables for ``items`` = [(item id, words)] cut into windows of ``width`` words.

    Flat arrays: the text once, where its words begin, and for each window size the shift of each block's hash, and
    the windows ordered by the hashes of their last block and first word.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int = 13):
        items = [(name, words) for name, words in items if words]
        flat = [w for _, words in items for w in words]
        size = np.array([len(words) for _, words in items], np.int64)
        self.names, self.firsts = [name for name, _ in items], array("q", (np.cumsum(size) - size).tolist())
        self.text = b" ".join(flat)
        length = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        self.begin = array("q", np.r_[0, np.cumsum(length)].tolist())
        one = np.fromiter(map(_digest, flat), np.uint64, len(flat))
        two = np.fromiter((_digest(a + b" " + b) for a, b in zip(flat, flat[1:])), np.uint64, max(len(flat) - 1, 0))
        first = np.array(self.firsts, np.int64)
        self.classes = []
        for k in sorted({int(n) for n in np.minimum(size, width)}):
            own = np.minimum(size, width) == k
            many = (size - k + 1)[own]
            starts = np.repeat(first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            block = min(2, k)
            keys, bits = (one if block == 1 else two), max(8, int(4 * len(starts)).bit_length())
            shift = np.full(1 << bits, k - block + 1, np.uint8)
            for end in range(block, k + 1):  # the shifts fall, so the last that is set is the least
                shift[(keys[starts + end - block] & np.uint64((1 << bits) - 1)).astype(np.int64)] = k - end
            full = (keys[starts + k - block] & ~np.uint64(_LOW)) | (one[starts] & np.uint64(_LOW))
            order = np.argsort(full, kind="stable")
            self.classes.append((k, block, shift.tobytes(), (1 << bits) - 1, array("Q", full[order].tobytes()), array("q", starts[order].tobytes())))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(start, words, place in the tables) of every occurrence of a window."""
        n, begin = len(words), self.begin
        for size, block, shift, mask, keys, starts in self.classes:
            at = size
            while at <= n:
                key = _digest(words[at - 1] if block == 1 else words[at - 2] + b" " + words[at - 1])
                step = shift[key & mask]
                if step:
                    at += step
                    continue
                key = (key & ~_LOW) | (_digest(words[at - size]) & _LOW)
                k = bisect_left(keys, key)
                if k < len(keys) and keys[k] == key:
                    found = b" ".join(words[at - size : at])
                    while k < len(keys) and keys[k] == key:
                        s = starts[k]
                        if self.text[begin[s] : begin[s + size] - 1] == found:
                            yield at - size, size, s
                        k += 1
                at += 1

    def owner(self, place: int) -> str:
        return self.names[bisect_right(self.firsts, place) - 1]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    width: int = 13, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``(id_col, n_words, hits, items)``: hits is a packed bitmap of the words inside occurrences, items the sorted ids.

    The benchmark is cut into parts of ``PART`` words, overlapping by a window, and these are dealt to shards, twice as
    many until none holds more than ``shard_bytes``; each shard's tables travel to the tasks of one pass, and passes
    chain without a shuffle. Items without an id are not searched for. Null and empty texts have no words, items
    without words no windows; an empty benchmark hits nothing; repeated rows stay; very long texts are searched whole;
    other columns are not read and may have any name.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where("item IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                parts = [words[k : k + PART + width - 1] for k in range(0, max(1, len(words) - width + 1), PART)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts)), pa.array(list(range(len(parts))), pa.int32()), pa.array([b" ".join(p) for p in parts], pa.binary())], ["item", "part", "text"])

    parts = written(items.mapInArrow(tidy(cut), "item string, part int, text binary"), "benchmark-parts")
    shards = max(1, -(-parts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // shard_bytes))
    deal = lambda n: F.pmod(F.xxhash64("item", "part"), F.lit(n))
    while shards > 1 and parts.groupBy(deal(shards)).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] > 2 * shard_bytes:
        shards *= 2
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"id {dict(chosen.dtypes)['id']}, text binary, n_words long, hits binary, items array<string>"
    out = chosen.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("hits"), F.array().cast("array<string>").alias("items"))
    for shard in range(shards):
        part = parts.where(deal(shards) == shard).collect()  # bounded by twice shard_bytes
        tables = WuManber([(r.item, bytes(r.text).split()) for r in part], width)
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = shared.value
            for batch in batches:
                rows = []
                for text, hits, names in zip(batch.column(1), batch.column(3), batch.column(4)):
                    words = words_of(text.as_py())
                    old = hits.as_py()
                    hit = np.zeros(len(words), bool) if not old else np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                    found = set(names.as_py())
                    for at, size, place in search.find(words):
                        hit[at : at + size] = True
                        found.add(search.owner(place))
                    rows.append((len(words), np.packbits(hit).tobytes() if hit.any() else b"", sorted(found)))
                n, h, i = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(i, pa.list_(pa.string()))], ["id", "text", "n_words", "hits", "items"])

        out = out.mapInArrow(tidy(run), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the item ids and the verdict from ``contamination``'s rows, by built-in functions."""
    hex_bits = F.hex("hits")
    n_hit = F.aggregate(F.split(hex_bits, ""), F.lit(0).cast("long"), lambda acc, c: acc + F.coalesce(F.bit_count(F.conv(F.nullif(c, F.lit("")), 16, 10).cast("long")), F.lit(0)))
    return rows.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
