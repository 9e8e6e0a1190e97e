"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared tile against tile with exclusive-or and bit counts. A tile holds fingerprints whose
first two 16-bit quarters have equal population counts; inside it they are ordered by the counts of the other two.
The sum of the differences of the four counts never exceeds the number of differing bits, so tile pairs, and runs
inside a tile pair, whose counts differ by more than the radius are skipped without loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.components import connected_components
from logtide.llm.storage import written

#: Fingerprints in a tile, about. Bounds what a comparing task holds.
TILE = 4096
_BLOCK = 1 << 15


def shingles(data: bytes | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of a UTF-8 text's ``width``-word shingles, repeats included; none if it has no words.

    A-Z are lower-cased, words are runs of anything but space, tab, LF, VT, FF and CR; fewer words are one shingle.
    """
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(text, seed)], dtype=np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(text[i:j], seed) for i, j in zip(begin[: 1 - width or None].tolist(), end[width - 1 :].tolist())),
        np.uint64,
        len(words) - width + 1,
    )


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _BLOCK):
        part = hashes[k : k + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text's ``width``-word shingles, as an unsigned integer; 0 if it has no words; repeats count."""
    return majority(shingles(data, width, seed))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 4, seed: int = 42) -> DataFrame:
    """``(id, fp)``; fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, fp long")


def compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between tiles ``a`` and ``b``, or within ``a`` if ``same``.

    Fewer links than fingerprints come out, however dense a group of near copies is; what they connect is the same.
    """

    def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q3, q4 = (np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int16) for s in (32, 48))
        order = np.argsort(q3 * 32 + q4, kind="stable")
        return x[order], q3[order], q4[order]

    def upper(x: np.ndarray) -> int:
        return [int(np.bitwise_count((x[0] >> np.uint64(s)) & np.uint64(0xFFFF))) for s in (0, 16)]

    a, a3, a4 = runs(a)
    b, b3, b4 = (a, a3, a4) if same else runs(b)
    left = radius - sum(abs(i - j) for i, j in zip(upper(a), upper(b)))
    label = np.arange(len(a) + (0 if same else len(b)))
    own, other = label[: len(a)], label if same else label[len(a) :]
    links = []
    edge = np.flatnonzero(np.diff(a3.astype(np.int32) * 32 + a4, prepend=-1, append=-1))
    for i, j in zip(edge[:-1], edge[1:]):
        near = np.flatnonzero(np.abs(b3 - a3[i]) + np.abs(b4 - a4[i]) <= left)
        if same:
            near = near[near >= i]
        if not len(near):
            continue
        for k in range(i, j, max(1, (1 << 20) // len(near))):
            top = min(j, k + max(1, (1 << 20) // len(near)))
            hits = np.bitwise_count(a[k:top, None] ^ b[None, near]) <= radius
            for row in np.flatnonzero(hits.sum(axis=1) > (1 if same else 0)):
                at = near[hits[row]]
                found, first = np.unique(other[at], return_index=True)
                mine = own[k + row]
                for lab, c in zip(found.tolist(), at[first].tolist()):
                    mine = own[k + row]
                    if lab != mine and other[c] != mine:
                        links.append((int(a[k + row]), int(b[c])))
                        label[label == other[c]] = mine
    return links


def tile_links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect distinct fingerprints ``fps(fp)`` exactly as all pairs within ``radius`` would.

    Tiles meet by an equality join on the cell of population counts, each cell with those around it.
    """
    quarter = lambda s: F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(0xFFFF))
    cells = fps.select("fp", quarter(0).alias("q1"), quarter(16).alias("q2"))
    sizes = cells.groupBy("q1", "q2").agg(F.ceil(F.count("*") / tile).alias("n"))  # 17 * 17 rows at most
    tiles = written(
        cells.join(F.broadcast(sizes), ["q1", "q2"])
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("n")))
        .groupBy("q1", "q2", "part")
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    around = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])).alias("step")
    keys = tiles.select("q1", "q2", "part")
    pairs = (
        keys.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("part").alias("p"), steps)
        .select("p1", "p2", "p", (F.col("p1") + F.col("step.i")).alias("q1"), (F.col("p2") + F.col("step.j")).alias("q2"))
        .join(keys, ["q1", "q2"])
        .where("p1 <> q1 OR p2 <> q2 OR p <= part")
    )
    first = tiles.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("part").alias("p"), F.col("fps").alias("a"))
    meet = pairs.join(first, ["p1", "p2", "p"]).join(tiles.withColumnRenamed("fps", "b"), ["q1", "q2", "part"])
    same = (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")) & (F.col("p") == F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in zip(*batch.columns):
                got = compare(*(x.values.to_numpy().view(np.uint64) for x in (a, b)), radius, s.as_py())
                ends = np.array(got, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    return meet.select("a", "b", same.alias("s")).mapInArrow(run, "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42
) -> DataFrame:
    """One row for each input row: ``(id_col, fingerprint, component_id, n_copies)``.

    Rows link if their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the least id that links
    reach, the row's own included; ``n_copies`` counts rows with the same fingerprint. Equal fingerprints are one
    node, so a group of copies costs one comparison, and tile pairs hand on spanning forests instead of pairs.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows stay repeated; a null id never
    is a component id unless nothing else is in the component; an empty table gives an empty table. Only the two
    named columns are read, other columns may have any name.
    """
    rows = written(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n_copies"))
    parts = connected_components(tile_links(nodes.select("fp"), radius))
    joined = written(nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "nodes")
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id", "n_copies")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_copies",
    )
