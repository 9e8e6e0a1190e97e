"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm import skew
from logtide.llm.skew import met_by
from logtide.llm.storage import dropped, written


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
    met = met_by(both.where("v > u"), least, ["u"], "c", 2 * total)
    return met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. Edges come as (a, b) with b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
    linked = met_by(edges, least, ["a"], "c", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges(a, b)``, any orientation, to ``(node, component)`` for every node that has an edge to another.

    The component is the least node. Each round writes its edges to the shared folder, so that the plan stays
    short and a lost executor repeats one round at most. Minima are aggregated before they are joined, and those of
    nodes with very many neighbours go by broadcast. An empty table gives an empty table.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    shape, total = None, edges.count()
    for _ in range(max_rounds if total else 1):
        if not total:
            break
        stars = _large_star(edges, total)
        if total > skew.SMALL:
            stars = written(stars, "stars")
        last, edges = edges, written(_small_star(stars, total), "edges")
        dropped(last)
        if total > skew.SMALL:
            dropped(stars)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == shape:
            break
        shape = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b"), F.col("b"))
    ).distinct()
