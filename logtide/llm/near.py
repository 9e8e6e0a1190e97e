"""Near copies by shingle-set similarity: SimHash candidates by tiled exact comparison, each confirmed by exact Jaccard.

A node is a distinct set of shingles. Sets of similarity ``least`` have sizes within that ratio, so tiles hold one size
class and one range of population counts, and only tiles of neighbouring classes, whose counts can be within the
radius, meet. Inside a tile pair a candidate within the radius must also pass its odd sketches: a bit of a sketch is the
parity of the set's hashes in a bucket, so two sketches never differ in more bits than the sets differ in shingles, and a
pair whose sketches differ in more than ``(1 - least) / (1 + least)`` of both sizes together is dropped without loss.

Pairs are confirmed in three steps. First a spanning forest of the candidates inside each tile; then one of each pair of
tiles over what confirmed links connect already, so that a dense group hands on few pairs; last every candidate pair
still unconnected of those tile pairs in which a link was not confirmed, as it may have stood for another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm import simhash
from logtide.llm.components import connected_components
from logtide.llm.storage import dropped, written
from logtide.llm.workers import tidy

#: Bits within which fingerprints of sets are candidates, by measured recall (README), and bytes of nodes in a tile, about.
RADIUS, TILE = 20, 4 << 20
#: Population counts in a range; sketch bits for each shingle of the largest set of a class, at least.
RANGE, SKETCH = 16, 4
#: Keys, of eight bytes each, that are broadcast to the texts that they stand for; more are joined.
FEW = 100_000
_ROWS, _FIXED, _KEY = 32, 28, 16


def shingle_set(data: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's ``width``-word shingles; words as in ``simhash.fingerprint``."""
    return np.unique(simhash.shingles(data, width, seed))


def size_class(size: int, least: float) -> int:
    """Sets of similarity ``least`` are in one class or in neighbouring ones; -1 for the empty set."""
    return int(math.log(size) / math.log(1.01 / least)) if size else -1


def sketch_bits(kind: int, least: float) -> int:
    """Bits of the odd sketches of a class, a power of two."""
    return max(64, 1 << math.ceil(math.log2(SKETCH * (1.01 / least) ** (kind + 1))))


def node(found: np.ndarray, least: float = 0.8) -> bytes:
    """A shingle set's node: a 128-bit key, its fingerprint, its size and its odd sketch."""
    bits = sketch_bits(size_class(len(found), least), least)
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    head = np.array([(simhash.majority(found), len(found))], [("fp", "<u8"), ("size", "<u4")]).tobytes()
    return xxhash.xxh3_128_digest(found.tobytes()) + head + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Tile:
    """Nodes and labels of a tile, ordered by size."""

    def __init__(self, rows: list[bytes]):
        wide = (len(rows[0]) - _FIXED - _KEY) // 8
        kind = np.dtype([("key", f"V{_KEY}"), ("fp", "<u8"), ("size", "<u4"), ("odd", "<u8", (wide,)), ("label", "<u8", (2,))])
        t = np.frombuffer(b"".join(rows), kind)
        t = t[np.argsort(t["size"], kind="stable")]
        self.key, self.fp, self.size = t["key"], np.ascontiguousarray(t["fp"]), t["size"].astype(np.int64)
        self.odd, self.label = np.ascontiguousarray(t["odd"]), t["label"]

    def folded(self, wide: int) -> np.ndarray:
        odd = self.odd
        while odd.shape[1] > wide:
            odd = odd[:, : odd.shape[1] // 2] ^ odd[:, odd.shape[1] // 2 :]
        return odd


def candidates(a: Tile, b: Tile, radius: int, least: float, same: bool, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of ``a`` and ``b`` within ``radius`` whose sizes and sketches allow ``least`` and whose labels differ.

    Each once if ``same``; a spanning forest of them if ``forest``.
    """
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    wide = min(a.odd.shape[1], b.odd.shape[1])
    odd_a, odd_b = a.folded(wide), b.folded(wide)
    label = np.unique(np.concatenate([a.label] if same else [a.label, b.label]), axis=0, return_inverse=True)[1].reshape(-1)
    shift, room = 0 if same else len(a.fp), max(1, (1 << 21) // wide)
    for k in range(0, len(a.fp), _ROWS):
        fp, size = a.fp[k : k + _ROWS], a.size[k : k + _ROWS]
        lo = k if same else int(np.searchsorted(b.size, np.floor(size[0] * least), "left"))
        hi = int(np.searchsorted(b.size, np.ceil(size[-1] / least), "right"))
        hit = np.bitwise_count(fp[:, None] ^ b.fp[None, lo:hi]) <= radius
        i, j = np.divmod(np.flatnonzero(hit), max(hi - lo, 1))
        i, j = i + k, j + lo
        if same:
            once = i < j
            i, j = i[once], j[once]
        for s in range(0, len(i), room):
            x, y = i[s : s + room], j[s : s + room]
            open_ = label[x] != label[y + shift]
            x, y = x[open_], y[open_]
            both = a.size[x] + b.size[y]
            far = np.bitwise_count(odd_a[x] ^ odd_b[y]).sum(axis=1, dtype=np.int64)
            ok = np.maximum(far, np.abs(2 * b.size[y] - both)) * (1 + least) <= (1 - least) * both + 1e-6
            x, y, far = x[ok], y[ok], far[ok]
            if not forest:
                left.append(x), right.append(y)
                continue
            near = np.argsort(far, kind="stable")
            x, y = x[near], y[near]
            while len(x):
                left.append(x[:1]), right.append(y[:1])
                label[label == label[y[0] + shift]] = label[x[0]]
                open_ = label[x] != label[y + shift]
                x, y = x[open_], y[open_]
    return np.concatenate(left), np.concatenate(right)


def tiles(nodes: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """``(t, q, c, nodes)`` from distinct ``nodes(node, size, label)``: tiles of one size class and range of counts."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [size_class(x, least) for x in batch.column(1).to_pylist()]
            c = [int.from_bytes(x[_KEY : _KEY + 8], "little").bit_count() // RANGE for x in batch.column(0).to_pylist()]
            whole = [x + y for x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(c, pa.int32()), pa.array(whole, pa.binary())], ["q", "c", "node"])

    sized = nodes.where("size > 0").select("node", "size", "label").mapInArrow(tidy(sort), "q int, c int, node binary")
    sized = written(sized, "near-classes")
    parts = sized.groupBy("q", "c").agg(F.ceil(F.sum(F.octet_length("node")) / tile).alias("n"))  # as many rows as classes
    dealt = sized.join(F.broadcast(parts), ["q", "c"]).withColumn("part", F.pmod(F.xxhash64(F.expr(f"substring(node, 1, {_KEY})")), F.col("n")))
    out = written(dealt.groupBy("q", "c", "part").agg(F.collect_list("node").alias("nodes")).withColumn("t", F.xxhash64("q", "c", "part")), "near-tiles")
    dropped(sized)
    return out


def tile_pairs(found: DataFrame, radius: int, inside: bool) -> DataFrame:
    """``(s, t)`` of the tiles that can hold a pair: each with itself if ``inside``, else with others."""
    if inside:
        return found.select(F.col("t").alias("s"), "t")
    keys = found.select("t", "q", "c")
    first = keys.select(F.col("t").alias("s"), F.col("q").alias("p"), F.col("c").alias("o"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    met = first.withColumn("q", F.col("p") + F.col("d")).join(keys, "q")
    close = (F.abs(F.col("c") - F.col("o")) - 1) * RANGE < radius
    return met.where(close & ((F.col("p") != F.col("q")) | (F.col("s") < F.col("t")))).select("s", "t")


def near_pairs(found: DataFrame, pairs: DataFrame, radius: int = RADIUS, least: float = 0.8, forest: bool = False) -> DataFrame:
    """Candidate pairs ``(s, t, a, b)`` of keys from tile pairs: all of different labels, or a forest of each tile pair's."""
    first, second = (found.select(F.col("t").alias(t), F.col("nodes").alias(n)) for t, n in (("s", "x"), ("t", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, t, x, y in zip(*batch.columns):
                s, t, a = s.as_py(), t.as_py(), Tile(x.as_py())
                b = a if s == t else Tile(y.as_py())
                at = candidates(a, b, radius, least, s == t, forest)
                ends = [pa.array([v.tobytes() for v in c.key[k]], pa.binary()) for c, k in zip((a, b), at)]
                many = len(at[0])
                yield pa.RecordBatch.from_arrays([pa.array([s] * many, pa.int64()), pa.array([t] * many, pa.int64()), *ends], ["s", "t", "a", "b"])

    meet = pairs.join(first, "s").join(second, "t").select("s", "t", "x", "y")
    return meet.mapInArrow(tidy(run), "s long, t long, a binary, b binary")


def shingle_sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame, width: int, seed: int) -> DataFrame:
    """``(key, found)`` for each key in ``pairs``, from one text of each.

    Copies of a text are one before they are moved; a few keys, by the size of their table, go to the texts instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), width, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "found"])

    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = written(rows.groupBy("key").agg(F.min("th").alias("th")).join(ends, "key").select("th", "key"), "near-wanted")
    texts = docs.select("th", "text").join(F.broadcast(wanted.select("th")), "th", "left_semi") if wanted.count() <= FEW else docs.select("th", "text")
    texts = texts.groupBy("th").agg(F.first("text").alias("text")).join(wanted, "th")
    return texts.select("key", "text").mapInArrow(tidy(run), "key binary, found binary")


def judged(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(s, t, a, b, sure)``: whether a pair's exact Jaccard similarity is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = []
            for x, y in zip(batch.column(4), batch.column(5)):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                sure.append(both / (len(a) + len(b) - both) >= least)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sure, pa.bool_())], ["s", "t", "a", "b", "sure"])

    meet = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("s", "t", "a", "b", "x", "y")
    return meet.mapInArrow(tidy(run), "s long, t long, a binary, b binary, sure boolean")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = RADIUS, least: float = 0.8, seed: int = 42, tile: int = TILE
) -> DataFrame:
    """One row ``(id, th, component)`` for each different id and text; th is ``xxhash64`` of the text's bytes.

    Rows are in one component if pairs of similarity ``least`` or more link them. Texts of fewer than ``width`` words
    are one shingle; null texts and texts without words are copies of each other. Null ids are ids like any other;
    repeated rows are one; an empty table gives an empty table; other columns are not read and may have any name.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), width, seed) for x in batch.column(2)]
            made = [pa.array([node(x, least) for x in found], pa.binary()), pa.array(list(map(len, found)), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "th", "node", "size"])

    made = base.select("id", "th", "text").mapInArrow(tidy(run), f"id {dict(base.dtypes)['id']}, th long, node binary, size long")
    rows = written(made.withColumn("key", F.expr(f"substring(node, 1, {_KEY})")), "near-nodes")
    nodes = rows.groupBy("key").agg(F.first("node").alias("node"), F.first("size").alias("size"))
    links = None

    def labelled(parts: DataFrame | None) -> DataFrame:
        if parts is None:
            return nodes.withColumn("label", F.col("key"))
        return nodes.join(parts.withColumnRenamed("node", "key"), "key", "left").select("node", "size", F.coalesce("component", "key").alias("label"))

    def step(found: DataFrame, pairs: DataFrame, forest: bool) -> DataFrame:
        """Judges candidates of ``pairs`` of tiles and adds what holds to the links."""
        nonlocal links
        new = written(near_pairs(found, pairs, radius, least, forest), "near-pairs")
        sets = written(shingle_sets(base, rows, new, width, seed), "shingle-sets")
        told = written(judged(new, sets, least), "near-judged")
        dropped(new), dropped(sets)
        sure = told.where("sure").select("a", "b")
        links = sure if links is None else links.union(sure)
        return told

    found = tiles(labelled(None), least, tile)
    told = step(found, tile_pairs(found, radius, True), True)
    again = told.where("NOT sure").select("s", "t").distinct()
    parts = connected_components(links)
    dropped(found)
    found = tiles(labelled(parts), least, tile)
    told = step(found, tile_pairs(found, radius, False), True)
    again = written(again.union(told.where("NOT sure").select("s", "t").distinct()), "near-again")
    parts = connected_components(links)
    if again.head(1):
        dropped(found)
        found = tiles(labelled(parts), least, tile)
        step(found, again, False)
        parts = connected_components(links)
    dropped(found)
    named = rows.select("id", "th", "key").distinct().join(parts.withColumnRenamed("node", "key"), "key", "left")
    return named.select("id", "th", F.coalesce("component", "key").alias("component"))
