"""Split algebra: class by split, thresholds, ratios and deviations, transitions between two assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import SPLITS

SHARES = {"train": 70, "valid": 20, "test": 10}


def class_split_counts(boxes: DataFrame, classes: DataFrame, split: str = "split", image: str = "image_id") -> DataFrame:
    """(class_id, class_name, images_<s>, instances_<s>): distinct images and boxes of each class in each split, zeros included.

    One aggregation by (class, image) and one over it serve all six numbers.
    """
    per = boxes.groupBy("class_id", image, split).agg(F.count("*").alias("_n"))
    aggs: list[Column] = []
    for s in SPLITS:
        aggs.append(F.count_if(F.col(split) == s).alias(f"images_{s}"))
        aggs.append(F.sum(F.when(F.col(split) == s, F.col("_n")).otherwise(0)).alias(f"instances_{s}"))
    counted = per.groupBy("class_id").agg(*aggs)
    names = [c for c in counted.columns if c != "class_id"]
    # the dictionary has one row a class: small whatever the data
    return classes.join(counted, "class_id", "left").select("class_id", "class_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def threshold_histogram(counts: DataFrame, value: str, thresholds: Sequence[int]) -> DataFrame:
    """(threshold, n): how many rows have fewer than each threshold, classes of zero included."""
    one = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    return counts.select(one, F.col(value).alias("_v")).groupBy("threshold").agg(F.count_if(F.col("_v") < F.col("threshold")).alias("n"))


def ratio_by_group(df: DataFrame, key: str, split: str = "split", shares: dict[str, int] | None = None) -> DataFrame:
    """(key, n_<s>, total, pct_<s>, dev_<s>, max_abs_dev_pp, shape): each group's shares against the wanted ones.

    dev is in percentage points; shape says how far off the worst one is (balanced under 5, skewed under 30, single_split, lopsided).
    """
    shares = shares or SHARES
    names = list(shares)
    known = df.where(F.col(split).isin(names))
    n = known.groupBy(key).agg(*[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in names], F.count("*").alias("total"))
    pct = {s: 100 * F.col(f"n_{s}") / F.col("total") for s in names}
    out = n.select(
        "*",
        *[F.round(pct[s], 4).alias(f"pct_{s}") for s in names],
        *[F.round(pct[s] - shares[s], 4).alias(f"dev_{s}") for s in names],
        F.round(F.greatest(*[F.abs(pct[s] - shares[s]) for s in names]), 4).alias("max_abs_dev_pp"),
    )
    single = F.greatest(*[F.col(f"n_{s}") for s in names]) == F.col("total")
    shape = F.when(single, "single_split").when(F.col("max_abs_dev_pp") < 5, "balanced").when(F.col("max_abs_dev_pp") < 30, "skewed").otherwise("lopsided")
    return out.withColumn("shape", shape)


def deviation_by_shape(ratios: DataFrame) -> DataFrame:
    """(shape, n_groups, images, worst_pp): groups of each shape, what they hold and the worst deviation."""
    return ratios.groupBy("shape").agg(F.count("*").alias("n_groups"), F.sum("total").alias("images"), F.max("max_abs_dev_pp").alias("worst_pp"))


def transitions(df: DataFrame, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, before, after, n): rows moved from one label to another; null labels are kept as such."""
    return df.groupBy(*by, before, after).agg(F.count("*").alias("n"))


def changed_by(df: DataFrame, before: str, after: str, by: Sequence[str]) -> DataFrame:
    """(by, total, changed, unchanged, pct_changed): rows whose two labels differ, null against a label being a difference."""
    moved = ~F.col(before).eqNullSafe(F.col(after))
    n = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(moved).alias("changed"))
    return n.withColumn("unchanged", F.col("total") - F.col("changed")).withColumn("pct_changed", F.round(100 * F.col("changed") / F.col("total"), 4))


def rejected_boxes(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """(reason, n): boxes that are not valid, by the first reason that holds: class, void, range."""
    known = classes.select("class_id", F.lit(True).alias("_known")).distinct()
    sizes = [F.col(c) for c in ("cx", "cy", "w", "h")]
    void = F.lit(False)
    outside = F.lit(False)
    for c in sizes:
        void = void | c.isNull() | F.isnan(c)
        outside = outside | (c <= 0) | (c > 1)
    reason = F.when(F.col("_known").isNull(), "class").when(void, "void").when(outside, "range")
    return boxes.join(known, "class_id", "left").select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
