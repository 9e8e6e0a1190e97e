"""Repeated byte strings over all documents by suffix order and longest-previous-factor arrays.

Every start of a ``length``-byte string belongs to the least hash of the 32-byte grams inside it, so equal strings meet
under one hash. Runs of starts with one such gram are slices. Only slices of hashes that occur twice go on, equal slices
as one, cut into pieces by the place of the gram. Pieces with the bytes around it in common meet, and a suffix order
over a batch of them gives, through previous and next smaller positions, the longest factor that starts earlier; the
mirrored pass gives the longest that starts later. Where more than ``PIECES`` different slices share a hash, pieces are
cut down to one start: the bytes in common are then the whole string, so equal pieces are one row with their number and
first place, and no suffix order grows with the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.skew import met_by
from logtide.llm.storage import dropped, written
from logtide.llm.workers import tidy

GRAM = 32
LENGTH = 200
#: Bytes of pieces in one suffix order, about.
BATCH = 1 << 21
#: Slices in one batch of rows, about.
ROWS = 20_000
#: Different slices of one hash that meet in a suffix order; with at most ``length - GRAM`` bytes around it, each adds little.
PIECES = 4096
_ODD, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 31) - 1)


def slices(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts, place of the gram in the first string) of the runs of one text.

    A run holds the starts whose strings have their least gram, the leftmost of equal ones, at the same place; so one
    string is never twice in one slice, and equal strings have their gram at the same offset. Empty if the text is
    shorter than ``length``.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h, k = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 1
        mult = _ODD
        while k < GRAM:
            h, k, mult = h[:-k] * mult + h[k:], 2 * k, mult * mult * np.uint64(3)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    width, k = length - GRAM + 1, 1
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    while 2 * k <= width:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    low = np.minimum(low[: len(h) - width + 1], low[width - k :][: len(h) - width + 1])
    start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    at = (low[start] & _PLACE).astype(np.int64)
    return h[at], start, np.diff(np.r_[start, len(low)]), at - start


def pieces(part: bytes, n: int, o: int, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(core hash, first start, number of starts) of the pieces of a slice.

    A piece holds the starts whose gram offset is in one of three bands. The bytes that all strings of a band have in
    common around the gram are its core, so equal strings meet under one core, and the gram alone brings none together.
    """
    band, out = (length - GRAM) // 3 + 1, []
    for b in range((o - n + 1) // band, o // band + 1):
        most, least = min(o, band * b + band - 1), max(o - n + 1, band * b)
        end = o + length - min(band * b + band - 1, length - GRAM)
        out.append((xxhash.xxh3_64_intdigest(part[o - band * b : end], b) - (1 << 63), o - most, most - least + 1))
    return out


def longest_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts`` in ``data``, the longest match, up to ``length`` bytes, with an earlier and with a later one of them.

    Suffix order by prefix doubling up to ``length``; then the previous and next smaller positions in that order, found
    by pointer jumping, hold the longest earlier match, and the larger ones the longest later match. The ranks of the
    doubling steps give the length of a match by halving.
    """
    n = len(data)
    at = np.arange(n)
    room = np.zeros(2 * length, np.int32)

    def ranked(x: np.ndarray) -> np.ndarray:
        return np.unique(x, return_inverse=True)[1].astype(np.int32) + 1

    def pair(r: np.ndarray, gap: int, of: np.ndarray) -> np.ndarray:
        return ranked(r[of].astype(np.int64) * (n + 257) + r[of + gap])

    levels = [(1, np.r_[data.astype(np.int32) + 1, room])]  # each with zeros behind, smaller than any rank
    while 2 * levels[-1][0] <= length:
        depth, r = levels[-1]
        levels.append((2 * depth, np.r_[pair(r, depth, at), room]))
    depth, r = levels[-1]
    final = pair(r, length - depth, starts) if depth < length else r[starts]
    by = np.lexsort((starts, final))
    order, kind = starts[by], np.r_[final[by], -1]
    place = np.empty(n, np.int64)
    place[order] = at[: len(order)]

    def nearest(keys: np.ndarray, step: int) -> np.ndarray:
        """Index of the nearest entry to the left (-1) or right (1) with a smaller key; len if none."""
        m = len(keys)
        k = np.r_[keys, -(1 << 60)]
        to = np.arange(m) + step
        to[(to < 0) | (to >= m)] = m
        while (more := np.flatnonzero(k[to] > keys)).size:
            to[more] = np.r_[to, m][to[more]]
        return to

    def match(of: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Bytes that the entries ``of`` and ``to`` have in common; none with no entry."""
        there = to < len(order)
        a, b = order[of], order[np.where(there, to, of)]
        same = np.zeros(len(of), np.int64)
        for depth, r in reversed(levels):
            same += depth * (r[a + same] == r[b + same])
        return np.where(there, np.minimum(same, length), 0)

    def longest(keys: np.ndarray) -> np.ndarray:
        """The longer match of the two nearest entries with smaller keys."""
        left, right = nearest(keys, -1), nearest(keys, 1)
        out = np.where((kind[left] == kind[:-1]) | (kind[right] == kind[:-1]), length, 0)
        rest = np.flatnonzero(out == 0)  # those of equal rank match in full
        out[rest] = np.maximum(match(rest, left[rest]), match(rest, right[rest]))
        return out

    back = place[starts]
    return longest(order)[back], longest(-order)[back]


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cols, held = [], [], 0
            for k, text in enumerate(batch.column(1)):
                data = text.as_py()
                mins, lo, size, o = slices(data, length)
                ends = (lo + size + length - 1).tolist()
                own = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(lo.tolist(), ends)), np.uint64, len(lo))
                row.append(np.full(len(lo), k))
                cols.append((mins.view(np.int64), own.view(np.int64), lo << 32 | size << 16 | o))
                held += len(lo)
                if held >= ROWS or k + 1 == len(batch):
                    same = batch.select(["id", "th"]).take(pa.array(np.concatenate(row)))
                    yield pa.RecordBatch.from_arrays([*same.columns, *(pa.array(np.concatenate(c)) for c in zip(*cols))], ["id", "th", "m", "s", "w"])
                    row, cols, held = [], [], 0

    return docs.mapInArrow(tidy(run), f"id {dict(docs.dtypes)['id']}, th long, m long, s long, w long")


#: Parts of ``w``: first start, number of starts and the gram's offset of a slice.
_LO, _N, _O = "int(shiftright(w, 32))", "int(shiftright(w, 16) & 65535)", "int(w & 65535)"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True, most: int = PIECES) -> DataFrame:
    """``(id, th, spans)``: byte ranges to remove from each text that has any; th is the text's XXH64.

    A ``length``-byte string goes if it also starts earlier (in the order of id, th, place), or with ``keep_first`` false,
    anywhere else. Hashes are counted by partial aggregation before anything meets; equal slices meet as one row.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    base = base.withColumn("th", F.xxhash64("text")).where(F.octet_length("text") >= length)
    kind = dict(base.dtypes)["id"]
    anchors = written(_anchors(base, length), "anchors")
    twice = written(anchors.groupBy("m").agg(F.count("*").alias("c")).where("c > 1"), "twice")
    met = written(met_by(anchors, twice, ["m"], "c", anchors.count()).drop("c"), "repeats")
    dropped(anchors), dropped(twice)
    slices_ = written(met.groupBy("m", "s").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "w")).alias("one")), "slices")
    kinds = written(slices_.groupBy("m").agg(F.count("*").alias("k")).where("k > 1"), "kinds")
    wanted = met_by(slices_.select("m", "s", "one"), kinds, ["m"], "k", slices_.count()).select("one.id", "one.th", F.struct("m", "s", "one.w", (F.col("k") > most).alias("fine")).alias("x"))
    wanted = wanted.groupBy("id", "th").agg(F.collect_list("x").alias("x"))  # bounded by a text's slices
    texts = base.join(wanted, base["id"].eqNullSafe(wanted["id"]) & (base["th"] == wanted["th"])).select(wanted["id"], wanted["th"], "text", F.explode("x").alias("x"))
    parts = texts.select("id", "th", "text", "x.*").selectExpr("m", "s", "id", "th", f"{_LO} AS lo", f"{_N} AS n", f"{_O} AS o", "fine", f"substring(text, {_LO} + 1, {_N} + {length - 1}) AS part")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, core, first, size, part = [], [], [], [], []
            for k, (lo, n, o, fine, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lo", "n", "o", "fine", "part")))):
                if fine:
                    for f in range(n):
                        row.append(k), core.append(xxhash.xxh3_128_digest(data[f : f + length])), first.append(f), size.append(1), part.append(None)
                    continue
                for c, f, many in pieces(data, n, o, length):
                    row.append(k), core.append(c.to_bytes(8, "big", signed=True)), first.append(f), size.append(many), part.append(data[f : f + many + length - 1])
            same = batch.select(["m", "s", "id", "th", "lo"]).take(pa.array(row, pa.int64()))
            more = [pa.array(core, pa.binary()), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(part, pa.binary())]
            yield pa.RecordBatch.from_arrays([*same.columns, *more], [*same.schema.names, "core", "first", "n", "part"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
            begin = np.cumsum([0] + [len(r[4]) for r in rows])
            bounds = np.cumsum([0] + [r[3] for r in rows])
            starts = np.arange(bounds[-1]) + np.repeat(begin[:-1] - bounds[:-1], np.diff(bounds))
            earlier, later = longest_factors(text, starts, length)
            hit = (earlier if keep_first else np.maximum(earlier, later)) >= length
            out = [(*r[:4], np.packbits(hit[i:j]).tobytes()) for r, i, j in zip(rows, bounds, bounds[1:]) if hit[i:j].any()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["m", "s", "first", "n", "bits"])

        rows, group, size, last = [], [], 0, None
        for batch in batches:
            for core, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if core != last:
                    if len(group) > 1:  # a core that occurs once repeats nothing
                        rows += group
                        size += sum(len(r[4]) for r in group)
                    group, last = [], core
                    if size > BATCH:
                        yield solve(rows)
                        rows, size = [], 0
                if not group or group[-1][:3] != row[:3]:  # a repeated input row
                    group.append(row)
        rows += group if len(group) > 1 else []
        if rows:
            yield solve(rows)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.array(x) for x in batch.column(2).to_pylist()]
            bits = [np.packbits(np.bincount(x, minlength=x.max() + 1).astype(bool)).tobytes() for x in at]
            out = [pa.array([0] * len(at), pa.int32()), pa.array([int(x.max()) + 1 for x in at], pa.int32()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *out], ["m", "s", "first", "n", "bits"])

    cores = written(parts.mapInArrow(tidy(cut), f"m long, s long, id {kind}, th long, lo int, core binary, first int, n int, part binary"), "pieces")
    whole = cores.where("part IS NOT NULL")
    ordered = whole.repartition("core").sortWithinPartitions("core", F.col("id").asc_nulls_first(), "th", F.col("lo") + F.col("first"))
    bits = ordered.select("core", "m", "s", "first", "n", "part").mapInArrow(tidy(order), "m long, s long, first int, n int, bits binary")
    fine = cores.where("part IS NULL").select("core", "m", "s", "first", F.struct("id", "th", (F.col("lo") + F.col("first")).alias("at")).alias("place")).distinct()
    equal = written(fine.groupBy("core").agg(F.count("*").alias("k"), F.min("place").alias("least")).where("k > 1"), "equal")
    hit = met_by(fine, equal, ["core"], "k", equal.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0])
    hit = hit.where("place > least") if keep_first else hit
    fine_bits = hit.groupBy("m", "s").agg(F.collect_list("first").alias("at")).mapInArrow(tidy(told), "m long, s long, first int, n int, bits binary")
    bits = bits.unionByName(fine_bits).groupBy("m", "s").agg(F.collect_list(F.struct("first", "n", "bits")).alias("bits"))
    facts = written(slices_.join(bits, ["m", "s"], "left").where("c > 1 OR bits IS NOT NULL"), "facts")
    dropped(cores), dropped(equal), dropped(slices_), dropped(kinds)
    first = F.col("one.id").eqNullSafe(F.col("id")) & (F.col("one.th") == F.col("th")) & (F.col("one.w") == F.col("w"))
    everything = (~first) if keep_first else (F.col("c") > 1)
    hits = met_by(met, facts, ["m", "s"], "c", met.count()).withColumn("whole", everything).where("whole OR bits IS NOT NULL")
    hits = hits.select("id", "th", "whole", "bits", F.expr(_LO).alias("lo"), F.expr(_N).alias("n"))
    span = lambda lo, n, bits: F.struct(lo.alias("lo"), n.alias("n"), bits.alias("bits"))
    all_of = F.array(span(F.col("lo"), F.col("n"), F.lit(None).cast("binary")))
    some_of = F.transform("bits", lambda x: span(F.col("lo") + x["first"], x["n"], x["bits"]))
    return hits.select("id", "th", F.explode(F.when(F.col("whole"), all_of).otherwise(some_of)).alias("x")).groupBy("id", "th").agg(F.collect_set("x").alias("spans"))


def removed(data: bytes, spans: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """For each byte of a text, whether a string that goes covers it."""
    step = np.zeros(len(data) + 1, np.int64)
    for x in spans or ():
        at = np.arange(x["n"]) if x["bits"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]))
        np.add.at(step, x["lo"] + at, 1)
        np.add.at(step, x["lo"] + at + length, -1)
    return np.cumsum(step[:-1]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True, most: int = PIECES) -> DataFrame:
    """One row for each input row: ``(id_col, th, n_bytes, n_removed, n_spans, kept binary)``; kept is what is left.

    Null and empty texts, and those shorter than ``length``, lose nothing. Rows with equal id and text are one in the
    order of ``keep_first`` and get the same result. An empty table gives an empty table; other columns are not read.
    """
    spans = repeated_spans(docs, id_col, text_col, length, keep_first, most)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    both = base.join(spans, base["id"].eqNullSafe(spans["id"]) & (base["th"] == spans["th"]), "left").select(base["id"], base["th"], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(batch.column(2), batch.column(3)):
                data, marks = text.as_py(), marks.as_py()
                if not marks:
                    out.append((len(data), 0, 0, data))
                    continue
                gone = removed(data, marks, length)
                out.append((len(data), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), np.frombuffer(data, np.uint8)[~gone].tobytes()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["id", "th", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(tidy(run), f"id {dict(both.dtypes)['id']}, th long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
