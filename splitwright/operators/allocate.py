"""Re-splitting by whole units: feasibility, admitting units to close class deficits, returning units to restore sizes.

The units, their classes and their splits stay distributed. The driver keeps what is bounded by the classes
and the split sizes asked for: the deficits, the units chosen so far, and how many candidates of each size there are. The greedy choice fetches
the best few hundred candidates at a time and asks again when a unit it hasn't seen could be better.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import SPLITS
from ..session import Workspace
from . import timeline

LEAST = 5
EVALUATION = ("test", "valid")
#: Candidates the greedy choice fetches at a time.
FETCH = 500


def build_units(images: DataFrame, components: DataFrame, taus: int | Sequence[int], key: str = "key", second: str = "second") -> DataFrame:
    """(image_id, unit), or (tau, image_id, unit) for several taus: every image in exactly one unit that moves as a whole.

    A timed image belongs to its burst at ``tau``; another one to its stem's component (id, component); what neither
    reaches, rows with a null key included, is a unit of its own. All taus are swept in one pass over the timeline.
    """
    several = [taus] if isinstance(taus, int) else list(taus)
    starts = timeline.session_starts(images.select("image_id", key, second), key, second, ["image_id"], several)
    bursts = starts.select("image_id", "tau", F.concat_ws(":", F.lit("burst"), F.col(key), F.col("start_s")).alias("burst"))
    linked = components.select(F.col("id").alias("_stem"), F.concat(F.lit("scene:"), F.col("component")).alias("scene"))
    untimed = images.where(F.col(key).isNull() | F.col(second).isNull()).select("image_id", "stem")
    others = untimed.join(linked, F.col("stem") == F.col("_stem"), "left").select(
        "image_id", F.explode(F.array(*[F.lit(t) for t in several])).alias("tau"), F.coalesce("scene", F.concat(F.lit("image:"), F.col("image_id").cast("string"))).alias("burst")
    )
    out = bursts.unionByName(others).select("tau", "image_id", F.col("burst").alias("unit"))
    return out.drop("tau") if isinstance(taus, int) else out


def describe_units(units: DataFrame, images: DataFrame, boxes: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(unit, n, only_split, mixed) and (unit, class_id, n_boxes): what the allocator needs to know of each unit, by tau where units have one.

    only_split is null for a unit with images of several splits or of none. boxes: image_id, class_id.
    """
    keys = [c for c in ("tau", "unit") if c in units.columns]
    known = F.col(split)
    per = units.join(images.select("image_id", split), "image_id").groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.when(F.min(F.coalesce(known, F.lit("?"))) == F.max(F.coalesce(known, F.lit("?"))), F.min(known)).alias("only_split"),
        (F.count_distinct(known) > 1).alias("mixed"),
    )
    # boxes of an image and class are counted before the image is repeated for each tau
    held = boxes.groupBy("image_id", "class_id").agg(F.count("*").alias("k"))
    classes = units.join(held, "image_id").groupBy(*keys, "class_id").agg(F.sum("k").alias("n_boxes"))
    return per, classes


def class_deficits(boxes: DataFrame, images: DataFrame, classes: DataFrame, least: int = LEAST, split: str = "split") -> DataFrame:
    """(class_id, split, have, short) for valid and test: how many boxes each class is short of ``least``; all classes are listed."""
    held = boxes.join(images.select("image_id", split), "image_id").groupBy("class_id").agg(*[F.count_if(F.col(split) == s).alias(s) for s in EVALUATION])
    full = classes.select("class_id").join(held, "class_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.coalesce(s, F.lit(0)).alias("have")) for s in EVALUATION]))
    return full.select("class_id", each.alias("e")).select("class_id", "e.split", "e.have", F.greatest(F.lit(least) - F.col("e.have"), F.lit(0)).alias("short"))


def feasibility(unit_classes: DataFrame, classes: DataFrame, settings: Sequence[str], least: int = LEAST) -> DataFrame:
    """(setting, class_id, n_units, n_qualifying, n_boxes, verdict): could the class be given to two splits by moving whole units?

    unit_classes: setting, unit, class_id, n_boxes. A unit qualifies with at least ``least`` boxes of the class. No unit: absent; one:
    single_unit; two that qualify: has_alternatives; otherwise insufficient. Every setting has a row for every class.
    """
    per = unit_classes.groupBy("setting", "class_id").agg(
        F.count("*").alias("n_units"), F.count_if(F.col("n_boxes") >= least).alias("n_qualifying"), F.sum("n_boxes").alias("n_boxes")
    )
    full = classes.select("class_id", F.explode(F.array(*[F.lit(s) for s in settings])).alias("setting")).join(per, ["setting", "class_id"], "left").na.fill(0)
    verdict = (
        F.when(F.col("n_units") == 0, "absent")
        .when(F.col("n_units") == 1, "single_unit")
        .when(F.col("n_qualifying") >= 2, "has_alternatives")
        .otherwise("insufficient")
    )
    return full.select("setting", "class_id", "n_units", "n_qualifying", "n_boxes", verdict.alias("verdict"))


def sizes_summing_to(counts: dict[int, int], target: int) -> dict[int, int] | None:
    """How many units of each size make up the target exactly, or None; fewest units of the later sizes are used.

    The table has at most ``target`` + 1 sums, whatever the number of units.
    """
    reach: dict[int, dict[int, int]] = {0: {}}
    for size in sorted((s for s in counts if 0 < s <= target), reverse=True):
        grown = dict(reach)
        for total, used in reach.items():
            for k in range(1, counts[size] + 1):
                now = total + k * size
                if now > target:
                    break
                if now not in grown:
                    grown[now] = used | {size: k}
        reach = grown
        if target in reach:
            break
    return reach.get(target)


@dataclass
class Allocation:
    """moves (unit, from_split, to_split, n); the class shortages left; splits whose size could not be restored."""

    moves: DataFrame
    unmet: dict[tuple[int, str], int]
    size_failures: dict[str, int]
    admitted: dict[str, int] = field(default_factory=dict)


def _value(short: dict[tuple[int, str], int], split: str) -> Column:
    """Boxes of short classes that a unit would bring to the split."""
    parts = [F.least(F.coalesce(F.try_element_at("has", F.lit(c)), F.lit(0)), F.lit(k)) for (c, s), k in short.items() if s == split]
    return sum(parts, F.lit(0))


def _worth(row, short: dict[tuple[int, str], int], split: str, order: int) -> tuple[float, int, int, int]:
    value = sum(min(row["has"].get(c, 0), k) for (c, s), k in short.items() if s == split)
    return value / row["n"], -row["n"], -order, row["luck"]


def allocate(
    units: DataFrame, unit_classes: DataFrame, boxes: DataFrame, images: DataFrame, classes: DataFrame, ws: Workspace, least: int = LEAST, seed: int = 1
) -> Allocation:
    """Admit train units to valid and test until no class is short, then return as many images to train, in whole units.

    A unit is worth the boxes of short classes it brings for each of its images; of equal ones the smaller goes first, test before
    valid, then by a seeded hash. Returned are units of the split alone whose removal leaves each of their classes at the least,
    judged one by one; their sizes must sum up exactly, else the split is reported and stays as it is.
    """
    spark = units.sparkSession
    held = class_deficits(boxes, images, classes, least).collect()  # two a class
    short = {(r["class_id"], r["split"]): r["short"] for r in held if r["short"] > 0}
    have = {(r["class_id"], r["split"]): r["have"] for r in held}
    needed = [c for c, _ in short]
    luck = F.xxhash64(F.lit(seed), F.col("unit"))
    train = units.where("only_split = 'train'").select("unit", "n", luck.alias("luck"))
    useful = unit_classes.where(F.col("class_id").isin(needed)).select("unit").distinct() if needed else unit_classes.select("unit").limit(0)
    pool = ws.keep(
        unit_classes.join(train.join(useful, "unit", "left_semi"), "unit")
        .groupBy("unit", "n", "luck")
        .agg(F.map_from_entries(F.collect_list(F.struct("class_id", "n_boxes"))).alias("has"))  # at most one entry a class
    )
    moves: list[tuple[str, str, str, int]] = []
    admitted = {s: 0 for s in EVALUATION}
    taken: set[str] = set()
    while short:
        options = [
            F.struct((_value(short, s) / F.col("n")).alias("rate"), (-F.col("n")).alias("n"), F.lit(-k).alias("order"), F.col("luck"))
            for k, s in enumerate(EVALUATION)
        ]
        ranked = pool.select("unit", "n", "luck", "has", F.greatest(*options).alias("o")).where("o.rate > 0")
        left = ranked.join(F.broadcast(spark.createDataFrame([(u,) for u in taken], "unit string")), "unit", "left_anti") if taken else ranked
        top = left.orderBy(F.desc("o"), "unit").limit(FETCH).collect()
        if not top:
            break
        # worths only fall as shortages close: while the best fetched unit beats the last one, no unit that wasn't fetched can
        bar = tuple(top[-1]["o"]) if len(top) == FETCH else None
        open_ = {r["unit"]: r for r in top}
        while short and open_:
            worth, unit, to = max((_worth(r, short, s, k), u, s) for u, r in open_.items() for k, s in enumerate(EVALUATION))
            if worth[0] <= 0 or (bar is not None and len(open_) < len(top) and worth <= bar):
                break
            row = open_.pop(unit)
            taken.add(unit)
            moves.append((unit, "train", to, row["n"]))
            admitted[to] += row["n"]
            for c, k in row["has"].items():
                have[(c, to)] = have.get((c, to), 0) + k
            short = {key: least - have[key] for key in short if have[key] < least}
    failures: dict[str, int] = {}
    returned: list[DataFrame] = []
    for s in EVALUATION:
        if not admitted[s]:
            continue
        room = spark.createDataFrame([(c, have[(c, t)] - least) for (c, t) in have if t == s], "class_id int, room long")
        unsafe = unit_classes.join(F.broadcast(room), "class_id").where(F.col("n_boxes") > F.col("room")).select("unit").distinct()
        mine = units.where(F.col("only_split") == s)
        safe = ws.keep(mine.join(unsafe, "unit", "left_anti").where(F.col("n") <= admitted[s]).select("unit", "n", luck.alias("luck")))
        counts = {r["n"]: r["k"] for r in safe.groupBy("n").agg(F.count("*").alias("k")).collect()}  # at most one row a size up to the target
        chosen = sizes_summing_to(counts, admitted[s])
        if chosen is None:
            failures[s] = admitted[s]
            continue
        take = spark.createDataFrame(sorted(chosen.items()), "n long, take int")
        ranked = safe.withColumn("_at", F.row_number().over(Window.partitionBy("n").orderBy("luck", "unit")))
        picked = ranked.join(F.broadcast(take), "n").where(F.col("_at") <= F.col("take"))
        returned.append(picked.select("unit", F.lit(s).alias("from_split"), F.lit("train").alias("to_split"), F.col("n").cast("long").alias("n")))
    out = spark.createDataFrame(moves, "unit string, from_split string, to_split string, n long")
    for df in returned:
        out = out.unionByName(df)
    return Allocation(ws.keep(out), short, failures, admitted)


def assignment_after(units: DataFrame, images: DataFrame, moves: DataFrame, split: str = "split") -> DataFrame:
    """(image_id, before, after): each image's split before and after the moves of its unit."""
    target = moves.select(F.col("unit").alias("_u"), "to_split")
    joined = units.join(images.select("image_id", F.col(split).alias("before")), "image_id").join(target, F.col("unit") == F.col("_u"), "left")
    return joined.select("image_id", "before", F.coalesce("to_split", "before").alias("after"))


def sizes_held(assignment: DataFrame) -> DataFrame:
    """(split, before, after): sizes of the splits on both sides."""
    two = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("split")), F.struct(F.lit("after").alias("side"), F.col("after").alias("split"))))
    known = assignment.select(two.alias("t")).select("t.side", "t.split").where(F.col("split").isin(*SPLITS))
    return known.groupBy("split").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("before", "after")])


def sweep_table(rows: Sequence[dict], spark) -> DataFrame:
    """One row for each setting that was tried; smallest: the least tau of those that satisfy."""
    best = min((r["tau"] for r in rows if r["ok"]), default=None)
    schema = "tau int, n_units long, n_straddling long, n_moved long, n_unmet int, sizes_held boolean, cross_pairs long, satisfies boolean, smallest boolean"
    return spark.createDataFrame([(*r.values(), r["tau"] == best) for r in rows], schema)
