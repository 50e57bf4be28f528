"""Connected components of an undirected graph by alternating large-star and small-star rounds of joins and aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star round on directed pairs (u, v): neighbours are linked to the least of u's neighbourhood.

    The least neighbour is an aggregation with partial results; no neighbourhood is collected, so a hub is only
    a key with many rows of the join, which adaptive execution splits.
    """
    if larger:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = around.join(least, "u")
    if larger:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(vertices: DataFrame, edges: DataFrame, ws: Workspace, ident: str = "id", most_rounds: int = 60) -> DataFrame:
    """(ident, component): the least vertex linked directly or indirectly; a vertex without edges is its own component.

    edges: a, b, of the same orderable type. Loops, repeats, reversed pairs and null ends change nothing.
    """
    live = ws.keep(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        after = ws.keep(_star(_star(live, larger=True), larger=False))
        ws.drop(live)
        live = after
        # the rounds are over when the set of links no longer changes
        now = live.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    joined = vertices.select(ident).where(F.col(ident).isNotNull()).distinct().join(live, F.col(ident) == F.col("u"), "left")
    return joined.select(ident, F.coalesce("v", ident).alias("component"))


def redundancy(components: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, components, multi, largest, redundant): redundant is how many could go if one of each component stayed."""
    sizes = components.groupBy(*by, "component").agg(F.count("*").alias("_s"))
    return sizes.groupBy(*by).agg(
        F.coalesce(F.sum("_s"), F.lit(0)).alias("n"),
        F.count("*").alias("components"),
        F.count_if(F.col("_s") > 1).alias("multi"),
        F.coalesce(F.max("_s"), F.lit(0)).alias("largest"),
        (F.coalesce(F.sum("_s"), F.lit(0)) - F.count("*")).alias("redundant"),
    )
