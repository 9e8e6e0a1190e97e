"""Token ids in patched frame-of-reference blocks.

A block holds up to ``BLOCK`` ids of one document: the least id is taken off each, the rest packed at the width that
fits a given percentile of them; larger ones are exceptions, kept whole in a list. Each document's record begins with
an index of its block starts, and each record of the file holds where its document starts among all ids.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm import bpe
from logtide.llm.storage import written
from logtide.llm.workers import tidy

BLOCK, PERCENTILE = 1024, 95
_HEAD = struct.Struct("<IHBH")  # least id, ids, width, exceptions


def _bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other."""
    room = 2 if width <= 16 else 4
    raw = values.astype(f"<u{room}").view(np.uint8)
    if width == 8 * room:
        return raw.tobytes()
    return np.packbits(np.unpackbits(raw.reshape(-1, room), axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def _values(data: bytes, at: int, size: int, width: int) -> np.ndarray:
    """``size`` values of ``width`` bits from byte ``at``: each lies within the eight bytes from where it begins."""
    room = np.frombuffer(data, np.uint8, -(-size * width // 8), at)
    room = np.concatenate([room, np.zeros(8, np.uint8)])
    bit = np.arange(size, dtype=np.int64) * width
    eight = np.ndarray(len(room) - 7, "<u8", room, strides=(1,))
    return ((eight[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """One document's record: number of blocks, their starts, then the blocks."""
    blocks = []
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK]
        low = int(part.min())
        rest = (part - np.uint32(low)).astype(np.uint32)
        width = int(np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k]).bit_length()
        odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        blocks.append(_HEAD.pack(low, len(part), width, len(odd)) + _bits(rest, width) + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes())
    starts = np.cumsum([0] + [len(b) for b in blocks[:-1]]) if blocks else []
    return struct.pack("<I", len(blocks)) + np.array(starts, "<u4").tobytes() + b"".join(blocks)


def unpack(record: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a record; the index leads to the blocks that hold them, no other is read."""
    n = struct.unpack_from("<I", record)[0]
    one = begin // BLOCK
    last = n if end is None else min(n, -(-end // BLOCK))
    out = []
    for start in np.frombuffer(record, "<u4", n, 4)[one:last].tolist():
        at = 4 + 4 * n + start
        low, size, width, odd = _HEAD.unpack_from(record, at)
        at += _HEAD.size
        ids = _values(record, at, size, width)
        at += -(-size * width // 8)
        ids[np.frombuffer(record, "<u2", odd, at)] = np.frombuffer(record, "<u4", odd, at + 2 * odd)
        out.append(ids + np.uint32(low))
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    return ids[begin - one * BLOCK : None if end is None else end - one * BLOCK]


def _rank(i) -> tuple:
    return (0,) if i is None else (1, i)


def shard_bounds(ids: DataFrame, shards: int, per_shard: int = 100) -> list:
    """Ids that cut ``ids(id)`` into ``shards`` ranges of about equal size: at most ``shards * per_shard`` sampled ids are looked at."""
    n = ids.count()
    share = min(1.0, 2.0 * shards * per_shard / max(n, 1))
    seen = ids if share == 1.0 else ids.sample(share, seed=7)
    found = sorted(map(_rank, (r.id for r in seen.orderBy(F.xxhash64("id")).limit(shards * per_shard).collect())))
    return [found[len(found) * k // shards] for k in range(1, shards)] if found else []


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write and reopen the files: records ``(id, n_tokens, record, shard, before)`` in ascending id order by shard.

    ``before`` counts the ids of the shard's earlier records. Shards are id ranges cut by ids alone, so that texts are
    encoded once, and records are moved once, to the place where they are written. Null texts count as empty and hold
    the end id alone; rows with one id follow each other by record; null ids come first; other columns are not read. An
    id that many rows share has shards of its own, cut by the hash of their texts.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(chosen.dtypes)["id"]
    bounds = shard_bounds(chosen.select("id"), shards)

    def place(i, order: bytes) -> int:
        """An id's shard; one that is a bound more than once is dealt over all shards that it fills, by its records' hashes."""
        low, high = bisect_left(bounds, _rank(i)), bisect_right(bounds, _rank(i))
        return high if high - low < 2 else low + 1 + int.from_bytes(order[:4], "big") * (high - low) // (1 << 32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in bpe.batches_of(texts):
                part = batch.slice(i, j - i)
                ids = [np.append(x, np.uint32(end_id)) for x in bpe.encode(path, texts[i:j])]
                records = list(map(pack, ids))
                orders = [xxhash.xxh64_digest(x) for x in records]
                shard = list(map(place, part.column(0).to_pylist(), orders))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(records, pa.binary()), pa.array(shard, pa.int32()), pa.array(orders, pa.binary())], ["id", "n_tokens", "record", "shard", "order"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = 0, None
        for batch in batches:
            n, shard = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            before = np.empty(len(n), np.int64)
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(shard)) + 1):
                if len(part):
                    total = total if shard[part[0]] == last else 0
                    before[part] = total + np.cumsum(n[part]) - n[part]
                    total, last = total + int(n[part].sum()), shard[part[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "before"])

    records = chosen.mapInArrow(tidy(encode, "bpe"), f"id {kind}, n_tokens long, record binary, shard int, order binary")
    ordered = records.repartitionById(shards, "shard").sortWithinPartitions("shard", "id", "order").drop("order")
    return written(ordered.mapInArrow(tidy(count, "bpe"), f"id {kind}, n_tokens long, record binary, shard int, before long"), "tokens")


def read_tokens(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, start, n_tokens, ids_crc32)`` from the files: a running sum over the shards' totals, a row each, gives every start."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # as many rows as shards

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [unpack(x.as_py()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], ["id", "shard", "before", "n_tokens", "ids_crc32"])

    kind = dict(files.dtypes)["id"]
    rows = files.select("id", "shard", "before", "record").mapInArrow(tidy(crc), f"id {kind}, shard int, before long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(earlier), "shard").select(F.col("id").alias(id_col), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
