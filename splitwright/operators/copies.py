"""Differences between two copies of data, by a merge over shared range splits.

Both copies are reduced to one row a key (an aggregation with map-side combine, so repeated rows of one
key cost nothing), put into one frame and range-partitioned by the key. One sample of both copies sets the
split points, so a key's two rows always meet in the same partition; there they are sorted by key and copy and a single pass
compares each row with its neighbour, as a two-pointer merge does. The partitioning and the order satisfy
the pass, so nothing is shuffled or sorted again, and no partition holds more than two rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X

#: How far apart two mean areas must be to differ.
AREA_TOLERANCE = 0.0001
#: Compared fields of a manifest, in the order they are reported.
MANIFEST_FIELDS = ("split", "capture_group", "device", "background", "n_boxes", "mean_area", "exported_at")


def latest_by_key(df: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """One row a key: that of the highest version, ties broken by the fields' values; null keys are dropped."""
    newest = F.max(F.struct(F.col(version).alias("_version"), *fields)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *[F.col(f"_row.{f}").alias(f) for f in fields])


def merge_copies(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, in_left, in_right, l, r) with l and r as structs of ``fields``; keys must be unique in each copy.

    The two copies need the same types. Null keys match nothing and are dropped.
    """
    row = F.struct(*fields).alias("_row")
    both = left.select(key, F.lit(0).alias("_copy"), row).unionByName(right.select(key, F.lit(1).alias("_copy"), row))
    laid = both.where(F.col(key).isNotNull()).repartitionByRange(F.col(key)).sortWithinPartitions(key, "_copy")
    along = Window.partitionBy(key).orderBy("_copy")
    seen = laid.select(
        key,
        "_copy",
        "_row",
        F.lead("_row").over(along).alias("_next"),
        F.row_number().over(along).alias("_at"),
    ).where("_at = 1")
    void = F.lit(None)
    first = F.col("_copy") == 0
    return seen.select(
        key,
        first.alias("in_left"),
        (~first | F.col("_next").isNotNull()).alias("in_right"),
        F.when(first, F.col("_row")).otherwise(void).alias("l"),
        F.when(first, F.col("_next")).otherwise(F.col("_row")).alias("r"),
    )


def differs(l: Column, r: Column, tolerance: float | None = None) -> Column:
    """Whether two values differ; null equals null and differs from any value."""
    if tolerance is None:
        return ~l.eqNullSafe(r)
    # the tenth digit is noise of binary fractions
    return F.coalesce(F.round(F.abs(l - r), 10) > tolerance, ~(l.isNull() & r.isNull()))


def field_differences(merged: DataFrame, key: str, fields: list[str], tolerance: dict[str, float] | None = None) -> DataFrame:
    """(kind, item, field): only_left and only_right rows with field 'row', and one differs row for each unequal field."""
    tolerance = tolerance or {}
    unequal = F.array(
        *[F.when(differs(F.col(f"l.{f}"), F.col(f"r.{f}"), tolerance.get(f)), F.lit(f)) for f in fields]
    )
    found = (
        F.when(~F.col("in_right"), F.array(F.struct(F.lit("only_left").alias("kind"), F.lit("row").alias("field"))))
        .when(~F.col("in_left"), F.array(F.struct(F.lit("only_right").alias("kind"), F.lit("row").alias("field"))))
        .otherwise(F.transform(F.array_compact(unequal), lambda f: F.struct(F.lit("differs").alias("kind"), f.alias("field"))))
    )
    return merged.select(F.col(key).alias("item"), F.explode(found).alias("d")).select("d.kind", "item", "d.field")


def _number(c: Column | str) -> Column:
    n = N.strip(F.col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(n), n)


def manifest(df: DataFrame, split: str, instants: Callable[[str], Column]) -> DataFrame:
    """(stem, row_no, the compared fields) of a manifest copy; rows without a name are dropped."""
    texts = (split, "capture_group", "device_name", "background")
    read = df.select(
        N.stem(N.blank_to_null("image_name")).alias("stem"),
        F.col("row_no").cast("long").alias("row_no"),
        *[N.squeeze(c).alias(c) for c in texts],
        _number("n_boxes").alias("n_boxes"),
        _number("mean_area").alias("mean_area"),
        instants("exported_at").cast("double").alias("exported_at"),
    )
    folded = read.select("*", *[X.comparable(c, squeezed=True).alias(f"_{c}") for c in texts])
    return folded.select(
        "stem",
        "row_no",
        # a text that is no split is compared as text
        F.coalesce(N.split_label(split), F.col(f"_{split}")).alias("split"),
        F.col("_capture_group").alias("capture_group"),
        F.when(F.col("_device_name").isNotNull(), N.device_key("device_name")).alias("device"),
        F.col("_background").alias("background"),
        "n_boxes",
        "mean_area",
        "exported_at",
    )


def merged_manifests(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """The two manifest copies side by side, one row a stem."""
    fields = list(MANIFEST_FIELDS)
    first = manifest(v1, "v1_split", N.seconds_of)
    second = manifest(v2, "v2_split", X.instant_seconds)
    return merge_copies(
        latest_by_key(first, "stem", "row_no", fields), latest_by_key(second, "stem", "row_no", fields), "stem", fields
    )


def manifest_differences(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """(kind, item, field) of the two manifest copies: only_v1, only_v2 and differs.

    Superseded and repeated rows count for nothing; empty copies are legal, everything is then only in the other.
    """
    found = field_differences(merged_manifests(v1, v2), "stem", list(MANIFEST_FIELDS), {"mean_area": AREA_TOLERANCE})
    kind = F.replace(F.replace("kind", F.lit("left"), F.lit("v1")), F.lit("right"), F.lit("v2"))
    return found.select(kind.alias("kind"), "item", "field")


def changed_by_group(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """(capture_group, device, in_both, changed): stems in both copies by what the first says of them."""
    both = merged_manifests(v1, v2).where("in_left and in_right")
    return both.groupBy(F.col("l.capture_group").alias("capture_group"), F.col("l.device").alias("device")).agg(
        F.count("*").alias("in_both"), F.count_if(differs(F.col("l.split"), F.col("r.split"))).alias("changed")
    )


def wrong_counts(v1: DataFrame, v2: DataFrame, published: DataFrame) -> DataFrame:
    """(kind 'count', item, field) for each published row whose imgs_changed_split isn't the counted number.

    A group without a stem counts 0, a published null is wrong; rows without a device or group match those without.
    """
    counted = changed_by_group(v1, v2).select(F.col("capture_group").alias("g"), F.col("device").alias("d"), "changed")
    told = published.select(
        N.strip("capture_group").alias("written"),
        X.comparable("capture_group").alias("capture_group"),
        N.device_key("device_name").alias("device"),
        F.col("imgs_changed_split").cast("long").alias("told"),
    )
    same = F.col("capture_group").eqNullSafe(F.col("g")) & F.col("device").eqNullSafe(F.col("d"))
    wrong = told.join(counted, same, "left").where(~F.col("told").eqNullSafe(F.coalesce("changed", F.lit(0))))
    item = F.concat(F.coalesce("written", F.lit("")), F.lit("/"), F.coalesce("device", F.lit("")))
    return wrong.select(F.lit("count").alias("kind"), item.alias("item"), F.lit("imgs_changed_split").alias("field"))


def compare_manifests(v1: DataFrame, v2: DataFrame, published: DataFrame) -> DataFrame:
    """All findings of the comparison: (kind, item, field)."""
    return manifest_differences(v1, v2).unionByName(wrong_counts(v1, v2, published))
