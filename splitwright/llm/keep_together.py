"""Splits that keep related records together: component swap search.

Images tied by a common group or a common stem, directly or through others, form components; a
component goes to one split as a whole. The search starts from a hashed assignment and moves or exchanges whole
components, accepting worse states by a falling temperature, to bring both the sizes of the splits and the
shares of every label close to the wanted proportions.

The search runs in three passes, all by the same annealing, each told what the passes before have filled. First come the components of
more than a thousandth of all images, fewer than a thousand whatever the data: no shard could make up for one of them. Then all
others, dealt by hash into shards of bounded size; every shard is annealed by several chains at once, each in a task of its own, and the
best chain is kept. One shard is held back to the end: it takes up what the others missed, each by a part of an image.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import Workspace
from .components import named_components

SHARES = {"train": 0.7, "valid": 0.2, "test": 0.1}
#: Components of one annealing problem, chains on each, steps of a chain for each component.
SHARD = 2_000
CHAINS = 3
STEPS = 12
#: Tasks for each core among which the searches are dealt, if there are as many.
SEARCH_TASKS = 4
#: A component of more than 1/HEAVY of all images goes into the first pass.
HEAVY = 1_000


def _vertices(images: DataFrame) -> DataFrame:
    """image_id, the kind and name of the vertex an image hangs on, and its group; a row for each listing."""
    # the stem is read once, the pass that reads it is the only one over the images
    named = images.where("image_id is not null").withColumn("stem", N.stem("filename"))
    s = F.col("stem")
    return named.select(
        "image_id",
        "group_id",
        "stem",
        F.when(s.isNotNull(), "stem").when(F.col("group_id").isNotNull(), "group").otherwise("image").alias("kind"),
        F.coalesce(s, F.col("group_id").cast("string"), F.col("image_id").cast("string")).alias("name"),
        N.split_label("split").alias("listed"),
        F.coalesce(F.col("family"), N.family(s)).alias("label"),
    )


def image_components(listings: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(image_id, component, label), one row for each image, and (group_id, component).

    listings: as ``_vertices`` gives them, kept. Images sharing a group_id or a stem are tied; an image with neither is a component of its own.
    """
    vertex = F.struct("kind", "name")
    per = ws.keep(
        listings.groupBy("image_id")
        .agg(F.min(vertex).alias("a"), F.max(vertex).alias("b"), F.coalesce(F.min("label"), F.lit("")).alias("label"))
        .select("image_id", "label", F.col("a.kind").alias("kind"), F.col("a.name").alias("name"), (F.col("a") != F.col("b")).alias("several"))
    )
    # a stem is tied to its group; a vertex that has no other to be tied to, to itself
    both = F.col("stem").isNotNull() & F.col("group_id").isNotNull()
    links = listings.select(
        F.col("kind").alias("kind_a"), F.col("name").alias("name_a"),
        F.when(both, "group").otherwise(F.col("kind")).alias("kind_b"), F.when(both, F.col("group_id").cast("string")).otherwise(F.col("name")).alias("name_b"),
    )
    # an image listed under different names ties them
    several = ws.keep(per.where("several").select("image_id", F.col("kind").alias("kind_a"), F.col("name").alias("name_a")))
    if not several.isEmpty():
        again = listings.select("image_id", F.col("kind").alias("kind_b"), F.col("name").alias("name_b"))
        links = links.unionByName(several.join(again, "image_id").drop("image_id"))
    found = named_components(links.withColumn("level", F.lit(0)), ws).select("kind", "name", F.col("root").alias("component"))
    of_group = found.where("kind = 'group'").select(F.col("name").cast("long").alias("group_id"), "component")
    return per.join(found, ["kind", "name"]).select("image_id", "component", "label"), of_group


def latest_moves(moves: DataFrame) -> DataFrame:
    """(group_id, moved_to, moved_images): where each group's latest move put it.

    admitted: the move's split; returned: train; another direction or an unread split: unknown. Of moves at
    the same time the one with the highest move_id counts; moves without a group or a time count for nothing.
    """
    direction = F.lower(N.strip("direction"))
    to = F.when(direction == "admitted", N.split_label("split")).when(direction == "returned", F.lit("train"))
    last = F.max(F.struct("moved_at", "move_id", to.alias("to"), "n_images"))
    return (
        moves.where("group_id is not null and moved_at is not null")
        .groupBy("group_id")
        .agg(last.alias("m"))
        .select("group_id", F.col("m.to").alias("moved_to"), F.col("m.n_images").alias("moved_images"))
    )


def _bit(split: Column) -> Column:
    return F.when(split == "train", 1).when(split == "valid", 2).when(split == "test", 4).otherwise(0)


def with_moves(listings: DataFrame, moves: DataFrame) -> DataFrame:
    """The listings with the bit of each one's current split and moved_images of its group's latest move."""
    # a moved group is where its move put it, even if that can't be read
    current = F.when(F.col("moved").isNotNull(), F.col("moved_to")).otherwise(F.col("listed"))
    last = latest_moves(moves).withColumn("moved", F.lit(True))
    return listings.join(last, "group_id", "left").withColumn("bit", _bit(current)).drop("moved", "moved_to", "listed")


def present_state(now: DataFrame, ws: Workspace) -> DataFrame:
    """(group_id, n_images, moved_images, splits, torn) of every group with images as things stand now.

    now: as ``with_moves`` gives it. splits is a bit set (train 1, valid 2, test 4) of the current splits of the group's images and of all
    images that share a stem with one of them; unknown splits aside. torn: more than one of them, or the latest move
    knew of fewer images than the group has.
    """
    by_stem = now.where("stem is not null").groupBy("stem").agg(F.bit_or("bit").alias("bits"), F.min("bit").alias("least"), F.max("bit").alias("most"))
    # a stem whose images all have the same split tells a group nothing that its own image doesn't
    mixed = ws.keep(by_stem.where("least != most").select("stem", "bits"))
    state = (
        now.where("group_id is not null")
        .join(mixed, "stem", "left")
        .groupBy("group_id")
        .agg(
            F.count_distinct("image_id").alias("n_images"),
            F.max("moved_images").alias("moved_images"),  # the same in all rows of a group
            F.bit_or(F.col("bit").bitwiseOR(F.coalesce("bits", F.lit(0)))).alias("splits"),
        )
    )
    torn = (F.bit_count("splits") > 1) | F.coalesce(F.col("moved_images") < F.col("n_images"), F.lit(False))
    return state.withColumn("torn", torn)


def anneal(rows: list[list[tuple[int, float]]], wanted: np.ndarray, weight: np.ndarray, start: np.ndarray, seed: int, steps: int) -> tuple[float, np.ndarray]:
    """Least excess found and the assignment that has it.

    rows: what each component brings, as (column, amount); wanted: the amount by split and column that isn't too much; weight: what an
    excess of one costs, by column. Half of the steps move one component, half exchange two of different splits; the best state is
    then polished by single moves and exchanges of neighbours in size until none helps.
    """
    rng = np.random.default_rng(seed)
    k, n = len(wanted), len(rows)
    at = start.tolist()
    off = (-wanted).tolist()
    for s, row in zip(at, rows):
        for c, v in row:
            off[s][c] += v
    w = weight.tolist()

    def cost() -> float:
        return sum(w[c] * x for split in off for c, x in enumerate(split) if x > 0)

    def change(a: int, b: int, shift: list[tuple[int, float]]) -> float:
        """What taking ``shift`` from split a to split b costs."""
        fa, fb, out = off[a], off[b], 0.0
        for c, v in shift:
            x, y = fa[c], fb[c]
            p, q = x - v, y + v
            # comparisons in place of max(), which takes twice as long
            out += w[c] * ((p if p > 0.0 else 0.0) - (x if x > 0.0 else 0.0) + (q if q > 0.0 else 0.0) - (y if y > 0.0 else 0.0))
        return out

    def take(a: int, b: int, shift: list[tuple[int, float]]) -> None:
        fa, fb = off[a], off[b]
        for c, v in shift:
            fa[c] -= v
            fb[c] += v

    # components that bring the same are of one kind; what exchanging two kinds shifts is worked out once
    kinds: dict[tuple[tuple[int, float], ...], int] = {}
    kind = [kinds.setdefault(tuple(row), len(kinds)) for row in rows]
    shifts: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def between(i: int, j: int) -> list[tuple[int, float]]:
        key = kind[i], kind[j]
        found = shifts.get(key)
        if found is None:
            net = dict(rows[i])
            for c, v in rows[j]:
                net[c] = net.get(c, 0.0) - v
            found = shifts[key] = [(c, v) for c, v in net.items() if v]
        return found

    now = best = cost()
    # what was changed since the best state: (component, split it came from)
    since: list[tuple[int, int]] = []
    if n:
        heat = max(now, 1e-6) / 10
        pick, other, to, luck = (x.tolist() for x in (rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(0, k, steps), rng.random(steps)))
        for t in range(steps):
            if best <= 1e-12:
                break
            i, j = pick[t], other[t]
            a = at[i]
            b = at[j] if t % 2 else to[t]
            if a == b:
                continue
            shift = between(i, j) if t % 2 else rows[i]
            d = change(a, b, shift)
            warm = heat * (1 - t / steps) ** 3
            if d <= 0 or (warm > 0 and luck[t] < math.exp(-d / warm)):
                take(a, b, shift)
                at[i] = b
                since.append((i, a))
                if t % 2:
                    at[j] = a
                    since.append((j, b))
                now += d
                if now < best - 1e-12:
                    best = now
                    since.clear()
    # back to the best state, then downhill
    for i, a in reversed(since):
        take(at[i], a, rows[i])
        at[i] = a
    order = sorted(range(n), key=lambda i: (rows[i], i))
    helped = True
    while helped and cost() > 1e-12:
        helped = False
        for i in order:
            for b in range(k):
                if b != at[i] and change(at[i], b, rows[i]) < -1e-12:
                    take(at[i], b, rows[i])
                    at[i] = b
                    helped = True
        for i, j in zip(order, order[1:]):
            if at[i] != at[j]:
                shift = between(i, j)
                if change(at[i], at[j], shift) < -1e-12:
                    take(at[i], at[j], shift)
                    at[i], at[j] = at[j], at[i]
                    helped = True
    return cost(), np.array(at, dtype=np.int64)


def hashed_start(ids: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A split for each component id, by its hash alone, in the target's proportions."""
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    edges = np.cumsum(target) / max(float(np.sum(target)), 1e-9)
    return np.minimum(np.searchsorted(edges, mixed / float(1 << 53), side="right"), len(target) - 1)


@dataclass
class SplitPlan:
    """What the search decided: assignment (image_id, component, split), groups (group_id, split, n_images, moved_images, torn)."""

    assignment: DataFrame
    groups: DataFrame


def _searched(comps: DataFrame, goals: DataFrame, order: list[str], share: list[float], shards: int, chains: int, steps: int, ws: Workspace) -> DataFrame:
    """(component, split) of the best chain of each shard.

    comps: shard, component, size, labels; goals: shard, label (null for the sizes) and want, an array by split.
    """
    chain = F.explode(F.array(*[F.lit(c) for c in range(chains)])).alias("chain")
    k = len(order)

    def search(key: tuple[Any, ...], held: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("component", ignore_index=True)
        labels = {label: c for c, label in enumerate(sorted(x for x in goal["label"] if x is not None), start=1)}
        wanted = np.zeros((k, 1 + len(labels)))
        for label, want in zip(goal["label"], goal["want"]):
            wanted[:, labels[label] if label is not None else 0] = want
        rows = [[(0, float(size)), *[(labels[label], float(v)) for label, v in sorted(dict(own).items())]] for size, own in zip(held["size"], held["labels"])]
        total = float(held["size"].sum())
        # the sizes weigh as much as all labels together, a label as much as its share of the images
        weight = np.ones(1 + len(labels)) / max(total, 1.0)
        weight[0] *= 2
        ids = held["component"].to_numpy()
        start = hashed_start(ids, np.maximum(wanted[:, 0], 0) + np.array(share) * 1e-6)
        cost, at = anneal(rows, wanted, weight, start, seed=(int(key[0]) + 1) * 1009 + int(key[1]), steps=steps * len(rows))
        return pd.DataFrame({"shard": key[0], "chain": key[1], "cost": cost, "component": ids, "at": at})

    # by the number of searches, whatever their bytes; a task, which writes a file, takes several only where all cores have enough of them
    tasks = max(1, min(shards * chains, SEARCH_TASKS * ws.spark.sparkContext.defaultParallelism))
    left = comps.select("shard", chain, "component", "size", "labels").repartition(tasks, "shard", "chain")
    right = goals.select("shard", chain, "label", "want").repartition(tasks, "shard", "chain")
    tried = ws.keep(
        left.groupBy("shard", "chain").cogroup(right.groupBy("shard", "chain")).applyInPandas(search, "shard int, chain int, cost double, component long, at int")
    )
    best = tried.groupBy("shard").agg(F.min(F.struct("cost", "chain")).alias("b")).select("shard", F.col("b.chain").alias("chain"))
    names = F.array(*[F.lit(s) for s in order])
    return tried.join(best, ["shard", "chain"]).select("component", F.element_at(names, F.col("at") + 1).alias("split"))


def _amounts(comps: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, k): images by label of the components, with a row of the sizes under a null label."""
    entries = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("label"), F.col("size").alias("k"))), F.transform(F.map_entries("labels"), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("k"))))
    return comps.select(*keys, F.explode(entries).alias("e")).groupBy(*keys, "e.label").agg(F.sum("e.k").alias("k"))


def _goals(all_of: DataFrame, filled: DataFrame | None, own: DataFrame, pool: DataFrame, order: list[str], share: list[float]) -> DataFrame:
    """(shard, label, want): each shard's part of what is still wanted of each label by split.

    all_of: label, k of all images; filled: split, label, k of what is placed; own: shard, label, k of each shard; pool: label, k of all that
    is still to be placed in this pass and later. A shard's part is its share of the pool.
    """
    wanted = all_of.select("label", *[(F.col("k") * p).alias(f"w{s}") for s, p in enumerate(share)])
    if filled is not None:
        held = filled.groupBy("label").agg(*[F.sum(F.when(F.col("split") == name, F.col("k")).otherwise(0)).alias(f"h{s}") for s, name in enumerate(order)])
        both = wanted.join(held.withColumnRenamed("label", "_l"), F.col("label").eqNullSafe(F.col("_l")), "left")
        wanted = both.select("label", *[(F.col(f"w{s}") - F.coalesce(f"h{s}", F.lit(0))).alias(f"w{s}") for s in range(len(order))])
    rest = pool.select(F.col("label").alias("_p"), F.col("k").alias("_pool"))
    joined = own.join(wanted.withColumnRenamed("label", "_w"), F.col("label").eqNullSafe(F.col("_w"))).join(rest, F.col("label").eqNullSafe(F.col("_p")))
    return joined.select("shard", "label", F.array(*[F.col(f"w{s}") * F.col("k") / F.col("_pool") for s in range(len(order))]).alias("want"))


def plan_splits(
    images: DataFrame,
    moves: DataFrame,
    ws: Workspace,
    shares: dict[str, float] | None = None,
    shard: int = SHARD,
    chains: int = CHAINS,
    steps: int = STEPS,
) -> SplitPlan:
    """Assign every image a split in the given shares, whole components at a time.

    Every image with an image_id gets exactly one split; repeated listings count once. Empty input gives empty
    frames. Every component and every label takes part in the search. If one component is larger than every split's share, the
    proportions can't be met; sizes are then as close as whole components allow. steps: of a chain, for each of its components.
    """
    shares = shares or SHARES
    order = list(shares)
    share = [shares[s] / sum(shares.values()) for s in order]
    now = ws.keep(with_moves(_vertices(images), moves))
    per, group_components = image_components(now, ws)
    counts = per.groupBy("component", "label").agg(F.count("*").alias("k"))
    sized = ws.keep(counts.groupBy("component").agg(F.sum("k").alias("size"), F.map_from_entries(F.collect_list(F.struct("label", "k"))).alias("labels")))
    total, n = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-n // shard))
    heavy = F.col("size") * HEAVY > total
    # -1: the first pass; 0: the shard that comes last
    comps = sized.withColumn("shard", F.when(heavy, -1).otherwise(F.pmod(F.xxhash64("component"), F.lit(shards))).cast("int"))
    amounts = ws.keep(_amounts(comps, "shard"))
    all_of = amounts.groupBy("label").agg(F.sum("k").alias("k"))
    # -1, 1 and 0: which of the three passes have components
    passes = {r[0] for r in amounts.select(F.signum("shard").cast("int")).distinct().collect()}
    decided: DataFrame | None = None
    for which, condition, tasks in ((-1, "shard = -1", 1), (1, "shard > 0", shards - 1), (0, "shard = 0", 1)):
        if which not in passes:
            continue
        mine = comps.where(condition)
        later = amounts.where(condition if condition == "shard = 0" else "shard >= 0")
        pool = later.groupBy("label").agg(F.sum("k").alias("k"))
        filled = None if decided is None else _amounts(comps.join(decided, "component"), "split")
        own = amounts.where(condition)
        if condition == "shard = -1":
            # what the others can fill up later is no excess, but half of that room is left to them
            pool = own.join(all_of.withColumnsRenamed({"label": "_l", "k": "_all"}), F.col("label").eqNullSafe(F.col("_l"))).select("label", (2 * F.col("k") * F.col("_all") / (F.col("k") + F.col("_all"))).alias("k"))
        goals = _goals(all_of, filled, own, pool, order, share)
        found = ws.keep(_searched(mine, goals, order, share, tasks, chains, steps, ws))
        decided = found if decided is None else decided.unionByName(found)
    if decided is None:
        decided = per.select("component", F.lit(None).cast("string").alias("split"))
    assignment = per.select("image_id", "component").join(decided, "component").select("image_id", "component", "split")
    of_group = group_components.join(decided, "component").select("group_id", "split")
    groups = present_state(now, ws).join(of_group, "group_id").select("group_id", "split", "n_images", "moved_images", "torn")
    return SplitPlan(assignment, groups)
