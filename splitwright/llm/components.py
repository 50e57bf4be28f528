"""Consolidating pairwise matches into groups: connected components on a two-dimensional grid.

Vertices are hashed into ``b`` blocks and every edge goes to the cell (block of one end, block of the
other) of a ``b`` x ``b`` grid. Each cell runs a local union-find over its edges and names, for each of its
vertices, a local representative. A vertex meets at most ``2b - 1`` cells, those of its row and its
column; their representatives are exchanged through one aggregation by vertex, the least becomes the
vertex's parent, and the representatives that disagree become the edges of the next, smaller graph. The
rounds end when all cells agree, which is when the parents no longer change.

A hub of a third of all edges is spread over the ``b`` cells of its row; a cell's memory is bounded by the
vertices of two blocks, because edges are folded into a forest as they stream in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import Workspace

#: Edges a grid cell should hold; the side of the grid follows from the number of edges.
EDGES_PER_CELL = 200_000
#: Edges a cell buffers before it folds them into its forest.
FOLD_AT = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All vertices of the edges and the least vertex of each one's component."""
    ids, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    parent = np.arange(len(ids))
    while len(a):
        ra, rb = parent[a], parent[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return ids, ids[parent]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    held = 0
    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= FOLD_AT:
            ids, roots = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [ids], [roots], 0
    if us:
        ids, roots = forest(np.concatenate(us), np.concatenate(vs))
        for k in range(0, len(ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 50_000]), pa.array(roots[k : k + 50_000])], names=["v", "r"])


def grid_components(edges: DataFrame, ws: Workspace, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (u long, v long); loops count as vertices.

    Null ends drop the edge. The root is the least vertex of the component. Empty in, empty out.
    """
    live = ws.keep(edges.where("u is not null and v is not null").select(F.col("u").cast("long"), F.col("v").cast("long")))
    rounds: list[DataFrame] = []
    while n := live.count():
        b = max(1, math.ceil(math.sqrt(n / edges_per_cell)))
        seed = len(rounds)
        row, column = (F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(b)) for c in ("u", "v"))
        local = live.repartition(b * b, row, column).mapInArrow(_cells, "v long, r long")
        # collect_set is bounded: a vertex has at most one representative from each cell of its row and column
        met = local.groupBy("v").agg(F.min("r").alias("parent"), F.collect_set("r").alias("rs"))
        found = ws.keep(
            met.select(
                "v",
                "parent",
                F.array_contains("rs", F.col("v")).alias("stays"),
                F.array_remove("rs", F.col("parent")).alias("others"),
            )
        )
        rounds.append(found)
        ws.drop(live)
        live = ws.keep(found.where(F.size("others") > 0).select(F.explode("others").alias("u"), F.col("parent").alias("v")).distinct())
    if not rounds:
        return live.select("v", F.col("u").alias("root"))
    ws.drop(live)
    labels = None
    for k, found in reversed(list(enumerate(rounds))):
        # a vertex that is a representative somewhere is settled by a later round, if there is one that has it
        if labels is None:
            labels = found.select("v", F.col("parent").alias("root"))
            continue
        later = labels.select(F.col("v").alias("p"), "root")
        done = found.join(later, found["parent"] == later["p"], "left").select("v", F.coalesce("root", "parent").alias("root"))
        again = labels.select(F.col("v").alias("w"))
        labels = ws.keep(labels.unionByName(done.join(again, done["v"] == again["w"], "left_anti")))
    return labels


def named_components(links: DataFrame, ws: Workspace, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """Components of links between named vertices, apart for each ``level``.

    links: level, kind_a, name_a, kind_b, name_b. Returns level, kind, name, root (a long that is common to
    a component and differs between components). Vertices are 64-bit hashes; two names that share one
    are detected and all names hashed anew, so the result doesn't depend on luck.
    """
    links = ws.keep(links.where("name_a is not null and name_b is not null"))
    for seed in range(8):
        ident: dict[str, Column] = {e: F.xxhash64(F.lit(seed), "level", f"kind_{e}", f"name_{e}") for e in "ab"}
        ends = links.select(
            F.explode(
                F.array(*[F.struct(ident[e].alias("v"), F.struct("level", F.col(f"kind_{e}").alias("kind"), F.col(f"name_{e}").alias("name")).alias("at")) for e in "ab"])
            ).alias("e")
        ).select("e.v", "e.at")
        vertices = ws.keep(ends.groupBy("v").agg(F.min("at").alias("at"), F.max("at").alias("other")))
        if vertices.where(F.col("at") != F.col("other")).isEmpty():
            break
        ws.drop(vertices)
    else:
        raise RuntimeError("vertex hashes collide under every seed")
    roots = grid_components(links.select(ident["a"].alias("u"), ident["b"].alias("v")), ws, edges_per_cell)
    return vertices.select("v", "at").join(roots, "v").select("at.level", "at.kind", "at.name", "root")


def scene_links(pairs: DataFrame, memberships: DataFrame, epsilons: tuple[float, ...]) -> DataFrame:
    """Links between stems, once for each epsilon (``level`` is its position) at which they hold.

    A listed membership links its stem to a vertex that stands for the (epsilon, component_id) group, so a
    group of any size needs no aggregation. Rows with a null name, score, epsilon or id give no link.
    """
    levels = F.array(*[F.lit(float(e)) for e in epsilons])

    def at(value: Column) -> Column:
        return F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(epsilons) - 1)), lambda k: value <= F.element_at(levels, k + 1)))

    score = N.effective_score("score", "raw_max_dist", "aligned_max_dist")
    by_score = pairs.where(~N.low_info("low_info", "n_boxes")).select(
        at(score).alias("level"),
        F.lit("stem").alias("kind_a"),
        N.stem("stem_a").alias("name_a"),
        F.lit("stem").alias("kind_b"),
        N.stem("stem_b").alias("name_b"),
    )
    by_list = memberships.where("component_id is not null and not isnan(epsilon)").select(
        at(F.col("epsilon")).alias("level"),
        F.lit("group").alias("kind_a"),
        F.concat_ws(":", F.col("epsilon").cast("string"), F.col("component_id").cast("string")).alias("name_a"),
        F.lit("stem").alias("kind_b"),
        N.stem("stem").alias("name_b"),
    )
    return by_score.unionByName(by_list).distinct()


def scene_components(
    pairs: DataFrame,
    memberships: DataFrame,
    ws: Workspace,
    epsilons: tuple[float, ...] = (0.01, 0.02, 0.05),
    edges_per_cell: int = EDGES_PER_CELL,
) -> DataFrame:
    """(epsilon, component_id, component_size, stem) for each stem in a component of two or more.

    component_id is the component's first stem in code-point order. Repeated, reversed and self pairs
    change nothing; null names, low-info rows and rows without a score give no link.
    """
    found = named_components(scene_links(pairs, memberships, epsilons), ws, edges_per_cell).where("kind = 'stem'")
    sizes = found.groupBy("level", "root").agg(F.min("name").alias("component_id"), F.count("*").alias("component_size"))
    text = F.element_at(F.array(*[F.lit(str(e)) for e in epsilons]), F.col("level") + 1)
    return (
        found.join(sizes.where("component_size > 1"), ["level", "root"])
        .select(text.alias("epsilon"), "component_id", "component_size", F.col("name").alias("stem"))
    )
