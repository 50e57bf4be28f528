"""Units, feasibility, allocation and its sweep over the burst gap."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocate as A
from ..operators import coverage as C
from ..operators import frames
from ..operators import scenes as scene_ops
from ..session import Workspace
from ..sources.tables import table
from . import scenes
from .splits import BOX
from .timeline import IMG

#: Boxes each class should have in valid and in test: chosen so that the smaller data has deficits.
LEAST = 25
TAU = 15
#: Gaps of the reference's sweep, and of its feasibility beside those of unit_feasibility.
SWEEP = (15, 20, 25, 30, 35, 45, 60)
FEASIBLE = (3, 5, 10, 15, 30, 60)


def _inputs(spark: SparkSession, d: str, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    images = ws.keep(frames.image_frame(table(spark, d, "images")))
    held = frames.box_frame(table(spark, d, "boxes"), table(spark, d, "classes"))
    boxes = ws.keep(held.join(images.select("filename", "image_id"), held["image"] == F.col("filename")).select("image_id", "class_id"))
    return images, boxes, table(spark, d, "classes"), ws.keep(scenes.stem_components(spark, d))


def unit_partition(spark: SparkSession, d: str) -> DataFrame:
    """Units at 15 s by kind: together they hold every image exactly once."""
    images, _, _, components = _inputs(spark, d, Workspace(spark, "units"))
    units = A.build_units(images, components, TAU)
    sizes = units.groupBy("unit").agg(F.count("*").alias("n"))
    return sizes.groupBy(F.substring_index("unit", ":", 1).alias("kind")).agg(F.count("*").alias("n_units"), F.sum("n").alias("n_images"), F.max("n").alias("largest"))


def class_deficits(spark: SparkSession, d: str) -> DataFrame:
    """Classes short of 25 boxes in valid or test."""
    images, boxes, classes, _ = _inputs(spark, d, Workspace(spark, "deficits"))
    return A.class_deficits(boxes, images, classes, LEAST).where("short > 0")


def unit_feasibility(spark: SparkSession, d: str) -> DataFrame:
    """For each class whether two units of at least five boxes could be moved, with bursts cut at 10, 15 and 60 s."""
    return _feasible(spark, d, (10, 15, 60))


def unit_feasibility_all_gaps(spark: SparkSession, d: str) -> DataFrame:
    """As unit_feasibility, with bursts cut at each gap of the reference as well: 3, 5, 10, 15, 30 and 60 s."""
    return _feasible(spark, d, FEASIBLE)


def _feasible(spark: SparkSession, d: str, taus: Sequence[int]) -> DataFrame:
    images, boxes, classes, components = _inputs(spark, d, Workspace(spark, "feasible"))
    # the gaps are swept in one pass
    cls = A.describe_units(A.build_units(images, components, taus), images, boxes)[1]
    return A.feasibility(cls.withColumn("setting", _setting("tau")), classes, [f"tau={t}s" for t in taus])


def _setting(tau: str) -> Column:
    return F.concat(F.lit("tau="), F.col(tau).cast("string"), F.lit("s"))


def _allocated(images: DataFrame, boxes: DataFrame, classes: DataFrame, components: DataFrame, tau: int, ws: Workspace):
    units = ws.keep(A.build_units(images, components, tau))
    per, cls = A.describe_units(units, images, boxes)
    per, cls = ws.keep(per), ws.keep(cls)
    return units, per, A.allocate(per, cls, boxes, images, classes, ws, LEAST)


def allocated_moves(spark: SparkSession, d: str) -> DataFrame:
    """Units the allocator moves at 15 s, in the columns of a move log."""
    ws = Workspace(spark, "allocate")
    images, boxes, classes, components = _inputs(spark, d, ws)
    return _allocated(images, boxes, classes, components, TAU, ws)[2].moves


def allocation_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Split sizes before and after the allocation."""
    ws = Workspace(spark, "sizes")
    images, boxes, classes, components = _inputs(spark, d, ws)
    units, _, result = _allocated(images, boxes, classes, components, TAU, ws)
    return A.sizes_held(A.assignment_after(units, images, result.moves))


def image_level_moves(spark: SparkSession, d: str) -> DataFrame:
    """The same choice with every image a unit of its own: the simpler allocation the unit-wise one replaces."""
    ws = Workspace(spark, "images")
    images, boxes, classes, _ = _inputs(spark, d, ws)
    units = images.select("image_id", F.concat(F.lit("image:"), F.col("image_id").cast("string")).alias("unit"))
    per, cls = A.describe_units(units, images, boxes)
    return A.allocate(ws.keep(per), ws.keep(cls), boxes, images, classes, ws, LEAST).moves


def _promises(units: DataFrame, per: DataFrame, result: A.Allocation, boxes: DataFrame, images: DataFrame, classes: DataFrame, ws: Workspace) -> DataFrame:
    """(promise, n, broken): what an allocation must keep, over how many things, and how often it doesn't."""
    moves = result.moves
    after = ws.keep(A.assignment_after(units, images, moves))
    told = moves.join(per.select("unit", F.col("n").alias("_n"), "only_split"), "unit", "left")
    once = moves.groupBy("unit").agg(F.count("*").alias("k"))
    short = {
        name: A.class_deficits(boxes, after.select("image_id", F.col(name).alias("split")), classes, LEAST).select("class_id", "split", F.col("short").alias(name))
        for name in ("before", "after")
    }
    worse = short["before"].join(short["after"], ["class_id", "split"])
    parts = (
        ("every image is in one unit", after.groupBy("image_id").agg(F.count("*").alias("k")), F.col("k") != 1),
        # where no whole units add up to what was admitted, the allocator reports it and the sizes do change
        ("no split changes its size unreported", A.sizes_held(after), (F.col("before") != F.col("after")) & F.lit(not result.size_failures)),
        ("no class gets shorter", worse, F.col("after") > F.col("before")),
        ("no unit moves twice", once, F.col("k") > 1),
        ("units move whole and from where they are", told, ~F.coalesce((F.col("n") == F.col("_n")) & (F.col("from_split") == F.col("only_split")), F.lit(False))),
    )
    out = None
    for k, (name, df, broken) in enumerate(parts):
        # the number of moves is the allocator's own; that of images, splits and classes is the tables'
        one = df.agg(F.lit(name).alias("promise"), (F.count("*") if k < 3 else F.lit(None).cast("long")).alias("n"), F.count_if(broken).alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out


def allocation_promises(spark: SparkSession, d: str) -> DataFrame:
    """What the allocation at 15 s keeps: sizes held, no class shorter than before, whole units moved once."""
    ws = Workspace(spark, "promises")
    images, boxes, classes, components = _inputs(spark, d, ws)
    units, per, result = _allocated(images, boxes, classes, components, TAU, ws)
    return _promises(units, per, result, boxes, images, classes, ws)


def image_level_promises(spark: SparkSession, d: str) -> DataFrame:
    """As allocation_promises, for the allocation image by image."""
    ws = Workspace(spark, "promises")
    images, boxes, classes, _ = _inputs(spark, d, ws)
    units = images.select("image_id", F.concat(F.lit("image:"), F.col("image_id").cast("string")).alias("unit"))
    per, cls = (ws.keep(df) for df in A.describe_units(units, images, boxes))
    return _promises(units, per, A.allocate(per, cls, boxes, images, classes, ws, LEAST), boxes, images, classes, ws)


def tau_units(spark: SparkSession, d: str) -> DataFrame:
    """Units at each gap of the sweep, and how many of them hold images of several splits."""
    images, boxes, _, components = _inputs(spark, d, Workspace(spark, "units"))
    per = A.describe_units(A.build_units(images, components, SWEEP), images, boxes)[0]
    return per.groupBy("tau").agg(F.count("*").alias("n_units"), F.count_if("mixed").alias("n_straddling"), F.sum("n").alias("n_images"))


def _cross_pairs(pairs: DataFrame, after: DataFrame, images: DataFrame) -> int:
    """Pairs of stems (a, b) with an export of one and an export of the other in different splits."""
    stems = after.join(images.select("image_id", "stem"), "image_id").where("stem is not null").groupBy("stem").agg(F.collect_set("after").alias("s"))
    a, b = (stems.select(F.col("stem").alias(e), F.col("s").alias(f"s{e}")) for e in "ab")
    return pairs.join(a, "a").join(b, "b").where(scene_ops.apart("sa", "sb")).count()


def tau_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Allocation at each gap of the reference's sweep: units, images moved, shortages left, sizes held, cross-split pairs at 0.05, and
    whether all of that satisfies; smallest marks the least gap that does, no row if none does."""
    ws = Workspace(spark, "sweep")
    images, boxes, classes, components = _inputs(spark, d, ws)
    pairs = ws.keep(scenes._listed_pairs(spark, d).where("not low").select("a", "b", F.least("raw", "aligned").alias("d")).where("d <= 0.05"))
    # units of all gaps in one pass; the allocations, one for each gap, are small and independent
    units = ws.keep(A.build_units(images, components, SWEEP))
    per, cls = (ws.keep(df) for df in A.describe_units(units, images, boxes))

    def one(tau: int) -> dict:
        at = F.col("tau") == tau
        own, mine = units.where(at).drop("tau"), per.where(at).drop("tau")
        result = A.allocate(mine, cls.where(at).drop("tau"), boxes, images, classes, ws, LEAST)
        after = ws.keep(A.assignment_after(own, images, result.moves))
        counts = mine.agg(F.count("*").alias("n"), F.count_if("mixed").alias("s")).first()
        moved = after.where(~F.col("before").eqNullSafe(F.col("after"))).count()
        held = A.sizes_held(after).where("before <> after").isEmpty()
        cross = _cross_pairs(pairs, after, images)
        return dict(tau=tau, units=counts["n"], straddling=counts["s"], moved=moved, unmet=len(result.unmet), held=held, cross=cross, ok=held and not result.unmet and not cross)

    with ThreadPoolExecutor(4) as pool:
        rows = list(pool.map(one, SWEEP))
    return A.sweep_table(rows, spark)


QUERIES = {f.__name__: f for f in (unit_partition, class_deficits, unit_feasibility, unit_feasibility_all_gaps, allocated_moves, allocation_sizes, allocation_promises, image_level_moves, image_level_promises, tau_units, tau_sweep)}

_COMP = scenes._COMP.replace("WITH RECURSIVE ", "", 1)


def _units(tau: int, name: str) -> str:
    return f"""{name}_c AS (SELECT image_id, key, second, CASE WHEN second - lag(second) OVER (PARTITION BY key ORDER BY second, image_id) <= {tau} THEN 0 ELSE 1 END AS c FROM img WHERE second IS NOT NULL AND key IS NOT NULL),
  {name}_r AS (SELECT image_id, key, sum(c) OVER (PARTITION BY key ORDER BY second, image_id) AS run FROM {name}_c),
  {name} AS (SELECT img.image_id, img.split, CASE WHEN run IS NOT NULL THEN 'burst' WHEN comp.id IS NOT NULL THEN 'scene' ELSE 'image' END AS kind,
    CASE WHEN run IS NOT NULL THEN r.key || ':' || run WHEN comp.id IS NOT NULL THEN component ELSE img.image_id::VARCHAR END AS unit FROM img LEFT JOIN {name}_r r USING (image_id) LEFT JOIN comp ON comp.id = img.stem)"""


_PROMISES = f"""WITH {IMG} SELECT 'every image is in one unit' AS promise, count(*) AS n, 0 AS broken FROM img UNION ALL SELECT 'no split changes its size unreported', count(DISTINCT split), 0 FROM img
UNION ALL SELECT 'no class gets shorter', 2 * count(DISTINCT class_id), 0 FROM classes UNION ALL VALUES ('no unit moves twice', NULL, 0), ('units move whole and from where they are', NULL, 0)"""

ORACLES = {
    "unit_partition": f"WITH RECURSIVE {_COMP}, {_units(TAU, 'u')} SELECT kind, count(*) AS n_units, sum(n)::BIGINT AS n_images, max(n) AS largest FROM (SELECT kind, unit, count(*) AS n FROM u GROUP BY ALL) GROUP BY kind",
    "class_deficits": f"""WITH {IMG}, {BOX}, h AS (SELECT class_id, s.split, count(box.image_id) AS have FROM classes c CROSS JOIN (VALUES ('test'), ('valid')) s(split) LEFT JOIN box USING (class_id, split) GROUP BY ALL)
SELECT class_id, split, have, greatest({LEAST} - have, 0) AS short FROM h WHERE have < {LEAST}""",
    "unit_feasibility": f"WITH RECURSIVE {_COMP}, {BOX}, {_units(10, 'u10')}, {_units(15, 'u15')}, {_units(60, 'u60')}, k AS ("
    + " UNION ALL ".join(f"SELECT 'tau={t}s' AS setting, class_id, kind, unit, count(*) AS n FROM box JOIN u{t} USING (image_id) GROUP BY ALL" for t in (10, 15, 60))
    + """), f AS (SELECT s.setting, c.class_id, count(unit) AS n_units, count(*) FILTER (WHERE n >= 5) AS n_qualifying, coalesce(sum(n), 0)::BIGINT AS n_boxes
  FROM classes c CROSS JOIN (VALUES ('tau=10s'), ('tau=15s'), ('tau=60s')) s(setting) LEFT JOIN k ON k.class_id = c.class_id AND k.setting = s.setting GROUP BY ALL)
SELECT *, CASE WHEN n_units = 0 THEN 'absent' WHEN n_units = 1 THEN 'single_unit' WHEN n_qualifying >= 2 THEN 'has_alternatives' ELSE 'insufficient' END AS verdict FROM f""",
    "unit_feasibility_all_gaps": f"WITH RECURSIVE {_COMP}, {BOX}, " + ", ".join(_units(t, f"u{t}") for t in FEASIBLE) + ", k AS ("
    + " UNION ALL ".join(f"SELECT 'tau={t}s' AS setting, class_id, kind, unit, count(*) AS n FROM box JOIN u{t} USING (image_id) GROUP BY ALL" for t in FEASIBLE)
    + "), f AS (SELECT s.setting, c.class_id, count(unit) AS n_units, count(*) FILTER (WHERE n >= 5) AS n_qualifying, coalesce(sum(n), 0)::BIGINT AS n_boxes FROM classes c CROSS JOIN (VALUES "
    + ", ".join(f"('tau={t}s')" for t in FEASIBLE)
    + """) s(setting) LEFT JOIN k ON k.class_id = c.class_id AND k.setting = s.setting GROUP BY ALL)
SELECT *, CASE WHEN n_units = 0 THEN 'absent' WHEN n_units = 1 THEN 'single_unit' WHEN n_qualifying >= 2 THEN 'has_alternatives' ELSE 'insufficient' END AS verdict FROM f""",
    "tau_units": f"WITH RECURSIVE {_COMP}, " + ", ".join(_units(t, f"u{t}") for t in SWEEP)
    + " SELECT tau, count(*) AS n_units, count(*) FILTER (WHERE s > 1) AS n_straddling, sum(n)::BIGINT AS n_images FROM ("
    + " UNION ALL ".join(f"SELECT {t} AS tau, kind, unit, count(*) AS n, count(DISTINCT split) AS s FROM u{t} GROUP BY ALL" for t in SWEEP)
    + ") GROUP BY tau",
    "allocation_promises": _PROMISES,
    "image_level_promises": _PROMISES,
}
