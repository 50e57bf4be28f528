"""The frames most queries start from: one row an image, a manifest row a stem, valid boxes, current splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def image_frame(images: DataFrame) -> DataFrame:
    """One row for each image_id: filename, stem, split, family, device, key, second, bucket, capture_group, counter.

    Repeated listings are one image (the least of their values); rows without an id are no images. family is
    read from the name; key is the device key or FAMILY: and the family; second is ts, epoch or the name's time.
    """
    s = N.stem("filename")
    read = images.where("image_id is not null").select(
        "image_id",
        "filename",
        s.alias("stem"),
        N.split_label("split").alias("split"),
        N.family(s).alias("family"),
        N.device_key("device_name").alias("device"),
        F.coalesce(N.seconds_of("ts"), F.when(~F.isnan("epoch"), F.floor("epoch")), N.name_seconds(s)).alias("second"),
        N.date_bucket(s).alias("bucket"),
        N.strip("capture_group").alias("capture_group"),
        F.when(N.family(s) == "counter", F.substring(s, 5, 20)).try_cast("long").alias("counter"),
    )
    cols = [c for c in read.columns if c != "image_id"]
    one = read.groupBy("image_id").agg(*[F.min(c).alias(c) for c in cols])
    return one.withColumn("key", N.device_or_family("device", "family"))


def current_splits(frame: DataFrame, images: DataFrame, moves: DataFrame) -> DataFrame:
    """frame with ``moved_split``: the split after each group's latest move, else the listed one."""
    direction = F.lower(N.strip("direction"))
    to = F.when(direction == "admitted", N.split_label("split")).when(direction == "returned", F.lit("train"))
    last = (
        moves.where("group_id is not null and moved_at is not null")
        .groupBy("group_id")
        .agg(F.max(F.struct("moved_at", "move_id", to.alias("to"))).alias("m"))
        .select(F.col("group_id").alias("_g"), F.col("m.to").alias("_to"))
    )
    groups = images.where("image_id is not null").groupBy(F.col("image_id").alias("_i")).agg(F.min("group_id").alias("_group"))
    moved = groups.join(last, F.col("_group") == F.col("_g")).select("_i", "_to")
    return frame.join(moved, frame["image_id"] == moved["_i"], "left").select(*frame.columns, F.coalesce("_to", "split").alias("moved_split"))


def manifest_frame(manifest: DataFrame, split: str) -> DataFrame:
    """One row a stem, of the highest row_no: stem, claimed split, device, background, capture_group, n_boxes."""
    read = manifest.select(
        N.stem("image_name").alias("stem"),
        "row_no",
        N.split_label(split).alias("claimed"),
        N.device_key(N.blank_to_null("device_name")).alias("device"),
        F.lower(N.squeeze(N.blank_to_null("background"))).alias("background"),
        N.strip(N.blank_to_null("capture_group")).alias("capture_group"),
    ).where("stem is not null")
    fields = ["claimed", "device", "background", "capture_group"]
    newest = read.groupBy("stem").agg(F.max(F.struct("row_no", *fields)).alias("m"))
    return newest.select("stem", *[F.col(f"m.{f}").alias(f) for f in fields])


def box_frame(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct valid boxes: image, class_id, cx, cy, w, h."""
    ok = F.col("image").isNotNull()
    for c in ("cx", "cy", "w", "h"):
        ok = ok & (F.col(c) > 0) & (F.col(c) <= 1)
    return boxes.where(ok).join(classes.select("class_id").distinct(), "class_id", "left_semi").select("image", "class_id", "cx", "cy", "w", "h").distinct()
