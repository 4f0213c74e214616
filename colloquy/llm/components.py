"""Connected components of an edge table by alternating large-star and small-star rounds, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import checkpoint


def _minima(pairs: DataFrame) -> DataFrame:
    """The smallest of each u and its v; pre-aggregated, so a node with many neighbours is no hot row."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _pairs(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Each row's ``pairs`` of columns as rows (u, v); one pass, where a union would read ``rows`` once for each."""
    return rows.select(F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))).alias("p")).select("p.u", "p.v")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One round: large links each larger neighbour to the smallest node around, small each smaller one and the node."""
    if large:
        pairs = _pairs(pairs, ("u", "v"), ("v", "u"))
    joined = pairs.join(_minima(pairs), "u")
    out = _pairs(joined.where("v > u"), ("v", "m")) if large else _pairs(joined, ("v", "m"), ("u", "m"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: longs); the root is the smallest node reachable.

    Self-edges and repeated edges do not matter. Each round's table is checkpointed; only a count and a checksum reach the
    driver. The rounds grow with the logarithm of the size of a component.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most):
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).collect()[0]
        if seen == (state.n, state.x) or not state.n:
            break
        seen = (state.n, state.x)
        now = checkpoint(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"components have not settled in {most} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
