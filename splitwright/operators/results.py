"""Collating measurements: repeatability of pairs, fronts, ranks, curves, agreement of sources, unanimity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace


def pair_gaps(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, gap, pct_of_mean, pct_of_max, pct_of_min, verdict) of groups meant to be two runs of the same.

    Blank values don't count. Two values are a pair; other numbers are a warning and have no mean or gap, for they
    must not be averaged silently. The denominators are named, for they differ.
    """
    v = F.when(~F.isnan(value), F.col(value))
    n = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    pair = F.col("n") == 2
    gap = F.col("_hi") - F.col("_lo")
    mean = (F.col("_hi") + F.col("_lo")) / 2
    return n.select(
        *keys,
        "n",
        F.when(pair, F.round(mean, 6)).alias("mean"),
        F.when(pair, F.round(gap, 6)).alias("gap"),
        *[F.when(pair & (whole > 0), F.round(100 * gap / whole, 4)).alias(f"pct_of_{name}") for name, whole in (("mean", mean), ("max", F.col("_hi")), ("min", F.col("_lo")))],
        F.when(pair, "pair").otherwise("warning").alias("verdict"),
    )


def pareto_front(df: DataFrame, ident: str, low: str, high: str, ws: Workspace) -> DataFrame:
    """Rows that no other row beats: none has at most its ``low`` and at least its ``high`` and one of them strictly.

    For each value of low only its best high can be on the front, and only if no smaller low has as much. Those best
    ones are laid out in ranges of low; the running maximum of earlier ranges is a table with one row for each range.
    """
    given = df.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    best = given.groupBy(low).agg(F.max(high).alias("_best"))
    laid = ws.keep(best.repartitionByRange(F.col(low)).withColumn("_part", F.spark_partition_id()))
    tops = laid.groupBy("_part").agg(F.max("_best").alias("_top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select("_part", F.max("_top").over(before).alias("_earlier"))
    within = Window.partitionBy("_part").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    seen = laid.join(F.broadcast(earlier), "_part").withColumn("_so_far", F.greatest(F.max("_best").over(within), F.col("_earlier")))
    front = seen.where(F.col("_so_far").isNull() | (F.col("_best") > F.col("_so_far"))).select(F.col(low).alias("_low"), "_best")
    on = given.join(front, (given[low] == F.col("_low")) & (given[high] == F.col("_best")))
    return on.select(ident, low, high)


def global_ranks(df: DataFrame, order: Sequence[Column], ident: str, ws: Workspace, name: str = "rank") -> DataFrame:
    """(ident, rank): place of each row in a total order, from 1, without one task that sees all rows.

    Ranges of the order are numbered apart and shifted by the number of rows in the ranges before.
    """
    laid = ws.keep(df.select(ident, *[c.alias(f"_o{k}") for k, c in enumerate(order)]))
    keys = [F.col(f"_o{k}") for k in range(len(order))] + [F.col(ident)]
    parts = ws.keep(laid.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_part", shift.alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    # one row for each range: small by construction
    return parts.withColumn("_at", within).join(F.broadcast(shifts), "_part").select(ident, (F.col("_at") + F.col("_shift")).cast("long").alias(name))


def closest_neighbours(df: DataFrame, value: str, ident: str, ws: Workspace, most: int = 1) -> DataFrame:
    """(a, b, gap): the ``most`` pairs of neighbours in the order of ``value`` with the least gap; ties by value and ident.

    Ranges of the order are walked apart; the last row of the range before is joined to each range's first.
    """
    laid = ws.keep(df.where(F.col(value).isNotNull()).select(value, ident).repartitionByRange(value, ident).withColumn("_part", F.spark_partition_id()))
    row = F.struct(F.col(value).alias("v"), F.col(ident).alias("i"))
    within = F.lag(row).over(Window.partitionBy("_part").orderBy(value, ident))
    lasts = laid.groupBy("_part").agg(F.max(row).alias("_l"))
    before = lasts.select("_part", F.lag("_l").over(Window.orderBy("_part")).alias("_before"))
    # one row for each range: small by construction
    joined = laid.withColumn("_p", within).join(F.broadcast(before), "_part").withColumn("_p", F.coalesce("_p", "_before")).where("_p is not null")
    pairs = joined.select(F.col("_p.i").alias("a"), F.col(ident).alias("b"), (F.col(value) - F.col("_p.v")).alias("gap"), F.col(value).alias("_v"))
    return pairs.orderBy("gap", "_v", "a", "b").limit(most).select("a", "b", F.round("gap", 6).alias("gap"))


def reduction_percent(before: Column, after: Column) -> Column:
    """By how many per cent of the first the second is less; null where there is no first."""
    return F.when(before > 0, F.round(100 * (before - after) / before, 4))


def nan_onset(curve: DataFrame, run: str, step: str, columns: Sequence[str]) -> DataFrame:
    """(run, column, first_nan, n_nan, recovered): the first step at which each column is NaN, and later steps at which it isn't.

    NULL is not NaN: a step without a value is neither an onset nor a recovery. Columns that never are NaN have nulls.
    """
    long = curve.select(run, step, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select(run, step, "e.column", "e.v")
    first = long.groupBy(run, "column").agg(F.min(F.when(F.isnan("v"), F.col(step))).alias("first_nan"), F.count_if(F.isnan("v")).alias("n_nan"))
    later = long.join(first.select(F.col(run).alias("_r"), F.col("column").alias("_c"), F.col("first_nan").alias("_f")), (F.col(run) == F.col("_r")) & (F.col("column") == F.col("_c")))
    back = later.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.col(step) > F.col("_f"))).groupBy(run, "column")
    steps = back.agg(F.array_join(F.sort_array(F.collect_list(step)), "|").alias("recovered"))
    return first.join(steps, [run, "column"], "left").select(run, "column", "first_nan", "n_nan", F.coalesce("recovered", F.lit("")).alias("recovered"))


def best_step(curve: DataFrame, run: str, step: str, weights: dict[str, float]) -> DataFrame:
    """(run, best_step, fitness): the step of the largest weighted sum, the earliest of equal ones; NaN sums don't count."""
    fit = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    scored = curve.select(run, step, fit.alias("_fit")).where(F.col("_fit").isNotNull() & ~F.isnan("_fit"))
    return scored.groupBy(run).agg(F.max(F.struct("_fit", (-F.col(step)).alias("_s"))).alias("_m")).select(run, (-F.col("_m._s")).alias("best_step"), F.round("_m._fit", 6).alias("fitness"))


def unanimity(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, n_values, only_value): whether a key's rows agree on each field; fields null throughout have no row."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("e")).select(key, "e.field", "e.v")
    one = long.where("v is not null").distinct().groupBy(key, "field").agg(F.count("*").alias("n_values"), F.min("v").alias("_v"))
    return one.select(key, "field", "n_values", F.when(F.col("n_values") == 1, F.col("_v")).alias("only_value"))


def key_sets_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right, equal): sizes of the symmetric difference; an inner join is safe only if it is empty."""
    both = left.select(key, F.lit(1).alias("_l")).distinct().join(right.select(key, F.lit(1).alias("_r")).distinct(), key, "full_outer")
    n = both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))
    return n.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def within_interval(value: Column, a: Column, b: Column) -> Column:
    """Whether the value lies between the two, whichever is larger; null where one of the three is."""
    return value.between(F.least(a, b), F.greatest(a, b))
