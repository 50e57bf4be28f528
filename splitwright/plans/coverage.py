"""Devices by split, coverage of images by the manifests, agreement of claimed and actual splits, provenance claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import SPLITS
from ..operators import coverage as C
from ..operators import frames
from ..sources.tables import table
from .timeline import IMG
from . import sqltext as S

NO_ROW = "<no CSV row>"
FAMILIES = ["ts_underscore", "ts_compact_sub", "ts_compact", "counter", "clock", "unparsed"]


def _images(spark: SparkSession, d: str) -> DataFrame:
    return frames.image_frame(table(spark, d, "images"))


def _v1(spark: SparkSession, d: str) -> DataFrame:
    return frames.manifest_frame(table(spark, d, "manifest_v1"), "v1_split")


def _v2(spark: SparkSession, d: str) -> DataFrame:
    return frames.manifest_frame(table(spark, d, "manifest_v2"), "v2_split")


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """Images left-joined to the first manifest: claimed split, its device and background, whether listed."""
    row = _v1(spark, d).select("stem", "claimed", F.col("device").alias("csv_device"), "background", F.lit(True).alias("listed"))
    return _images(spark, d).join(row, "stem", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def device_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Images of each manifest device in each split, with a TOTAL row; images without a row under a label of their own."""
    joined = _joined(spark, d).withColumn("device", C.or_label("csv_device", NO_ROW))
    return C.split_counts(joined, "device", "split", SPLITS)


def family_vs_device(spark: SparkSession, d: str) -> DataFrame:
    """Devices by name family as a table with a column for each family."""
    joined = _joined(spark, d).withColumn("device", C.or_label("csv_device", NO_ROW))
    return C.widen(C.contingency(joined, "device", "family"), "device", "family", "n", FAMILIES)


def ambiguous_devices(spark: SparkSession, d: str) -> DataFrame:
    """Families with several devices and devices with several families."""
    images = _images(spark, d)
    one = C.ambiguous_keys(images, "family", "device").select(F.lit("family").alias("axis"), F.col("family").alias("item"), "n_values")
    two = C.ambiguous_keys(images, "device", "family").select(F.lit("device").alias("axis"), F.col("device").alias("item"), "n_values")
    return one.unionByName(two)


def single_split_devices(spark: SparkSession, d: str) -> DataFrame:
    """Devices and families all of whose images lie in one split."""
    images = _images(spark, d)
    devices = C.single_split_keys(images.where("device is not null"), "device", "split").select(F.lit("device").alias("axis"), F.col("device").alias("item"), "only_split", "n")
    families = C.single_split_keys(images, "family", "split").select(F.lit("family").alias("axis"), F.col("family").alias("item"), "only_split", "n")
    return devices.unionByName(families)


def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many images the manifest has and hasn't, by family, with a TOTAL row."""
    per = _joined(spark, d).groupBy("family").agg(F.count("*").alias("images"), F.count_if("listed").alias("listed"))
    total = per.agg(F.coalesce(F.sum("images"), F.lit(0)).alias("images"), F.coalesce(F.sum("listed"), F.lit(0)).alias("listed")).select(F.lit(C.TOTAL).alias("family"), "images", "listed")
    both = per.unionByName(total).withColumn("missing", F.col("images") - F.col("listed"))
    return both.withColumn("pct_missing", C.percent(F.col("missing"), F.col("images")))


def images_without_row(spark: SparkSession, d: str) -> DataFrame:
    """Images whose stem the first manifest doesn't have."""
    return C.only_in(_images(spark, d), _v1(spark, d), "stem").select("image_id", "stem", "split")


def rows_without_image(spark: SparkSession, d: str) -> DataFrame:
    """Manifest stems that no image has."""
    return C.only_in(_v1(spark, d), _images(spark, d), "stem").select("stem", "claimed", "device")


def repeated_manifest_names(spark: SparkSession, d: str) -> DataFrame:
    """Stems listed several times in a manifest: the last row wins, the repeats are reported."""
    read = table(spark, d, "manifest_v1").select(frames.N.stem("image_name").alias("stem")).where("stem is not null")
    return C.duplicate_keys(read, "stem")


def split_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Claimed by actual split of listed images, with a TOTAL row."""
    joined = _joined(spark, d).where("listed").withColumn("claimed", C.or_label("claimed", "<blank>"))
    return C.confusion(joined, "claimed", "split", SPLITS)


def split_confusion_by_family(spark: SparkSession, d: str) -> DataFrame:
    """Claimed by actual split for each name family."""
    joined = _joined(spark, d).where("listed").withColumn("claimed", C.or_label("claimed", "<blank>"))
    return C.confusion(joined, "claimed", "split", SPLITS, by="family")


def _cell(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).where((F.col("claimed") == "train") & (F.col("split") == "valid"))


def disagreement_composition(spark: SparkSession, d: str) -> DataFrame:
    """Images claimed as train and kept in valid, counted along four axes."""
    cell = _cell(spark, d).select(
        "family",
        C.or_label("csv_device", "<no device>").alias("device"),
        "bucket",
        C.or_label("background", "<blank>").alias("background"),
    )
    return C.composition(cell, {"family": "family", "device": "device", "date": "bucket", "background": "background"})


def disagreement_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether the devices of that cell are those of the other disagreeing images."""
    other = _joined(spark, d).where((F.col("claimed") == "valid") & (F.col("split") == "train"))
    return C.overlap_verdict(_cell(spark, d).where("csv_device is not null"), other.where("csv_device is not null"), "csv_device")


def provenance_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims on where the copies' stems come from, each PASS or FAIL with the count that decides it."""
    images, v1, v2 = _images(spark, d).select("stem"), _v1(spark, d), _v2(spark, d)
    flags = (
        images.select("stem", F.lit(1).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("b"))
        .unionByName(v1.select("stem", F.lit(0).alias("i"), F.lit(1).alias("a"), F.lit(0).alias("b")))
        .unionByName(v2.select("stem", F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(1).alias("b")))
        .where("stem is not null")
        .groupBy("stem")
        .agg(*[F.max(c).alias(c) for c in "iab"])
    )
    has = {c: F.col(c) == 1 for c in "iab"}
    n = flags.agg(
        F.count_if(has["a"] & ~has["b"]).alias("t1"),
        F.count_if(has["b"] & ~has["a"]).alias("t2"),
        F.count_if(has["a"] & ~has["i"]).alias("t3"),
        F.count_if(has["i"] & ~has["a"] & ~has["b"]).alias("t4"),
    )
    told = {
        "t1": "every stem of v1 is in v2",
        "t2": "every stem of v2 is in v1",
        "t3": "every stem of v1 has an image",
        "t4": "every image is in a copy",
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("claim"), F.lit(v).alias("statement"), F.col(k).alias("violations")) for k, v in told.items()]))
    return n.select(rows.alias("r")).select("r.*").withColumn("verdict", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def date_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Stems by date bucket in either copy, missing dates as 0."""
    a = _v1(spark, d).select(frames.N.date_bucket("stem").alias("bucket"))
    b = _v2(spark, d).select(frames.N.date_bucket("stem").alias("bucket"))
    return C.full_counts(a, b, "bucket", ("n_v1", "n_v2"))


QUERIES = {
    f.__name__: f
    for f in (
        device_by_split, family_vs_device, ambiguous_devices, single_split_devices, coverage_summary, images_without_row, rows_without_image,
        repeated_manifest_names, split_confusion, split_confusion_by_family, disagreement_composition, disagreement_overlap, provenance_claims, date_histogram,
    )
}


_V1 = S.manifest("v1", "manifest_v1", "v1_split")
_V2 = S.manifest("v2", "manifest_v2", "v2_split")
_J = f"WITH {IMG}, {_V1}, j AS (SELECT img.*, v1.claimed, v1.device AS csv_device, v1.background, v1.stem IS NOT NULL AS listed FROM img LEFT JOIN v1 ON v1.stem = img.stem)"
_COUNTS = "count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total"

ORACLES = {
    "device_by_split": f"{_J} SELECT CASE WHEN grouping(dev) = 1 THEN 'TOTAL' ELSE dev END AS device, {_COUNTS} FROM (SELECT *, coalesce(csv_device, '{NO_ROW}') AS dev FROM j) GROUP BY ROLLUP (dev)",
    "family_vs_device": f"{_J} SELECT coalesce(csv_device, '{NO_ROW}') AS device, "
    + ", ".join(f"count(*) FILTER (WHERE family = '{f}') AS {f}" for f in FAMILIES)
    + " FROM j GROUP BY 1",
    "ambiguous_devices": f"""WITH {IMG} SELECT 'family' AS axis, family AS item, count(DISTINCT device) AS n_values FROM img WHERE family IS NOT NULL GROUP BY family HAVING count(DISTINCT device) > 1
UNION ALL SELECT 'device', device, count(DISTINCT family) FROM img WHERE device IS NOT NULL GROUP BY device HAVING count(DISTINCT family) > 1""",
    "single_split_devices": f"""WITH {IMG} SELECT 'device' AS axis, device AS item, min(split) AS only_split, count(*) AS n FROM img WHERE split IS NOT NULL AND device IS NOT NULL GROUP BY device HAVING count(DISTINCT split) = 1
UNION ALL SELECT 'family', family, min(split), count(*) FROM img WHERE split IS NOT NULL GROUP BY family HAVING count(DISTINCT split) = 1""",
    "coverage_summary": f"""{_J} SELECT CASE WHEN grouping(family) = 1 THEN 'TOTAL' ELSE family END AS family, count(*) AS images, count(*) FILTER (WHERE listed) AS listed, count(*) FILTER (WHERE NOT listed) AS missing,
  round(100.0 * count(*) FILTER (WHERE NOT listed) / count(*), 1)::DOUBLE AS pct_missing FROM j GROUP BY ROLLUP (family)""",
    "images_without_row": f"{_J} SELECT image_id, stem, split FROM j WHERE NOT listed",
    "rows_without_image": f"WITH {IMG}, {_V1} SELECT stem, claimed, device FROM v1 WHERE NOT EXISTS (SELECT 1 FROM img WHERE img.stem = v1.stem)",
    "repeated_manifest_names": f"SELECT stem, count(*) AS n FROM (SELECT {S.stem('image_name')} AS stem FROM manifest_v1) WHERE stem IS NOT NULL GROUP BY stem HAVING count(*) > 1",
    "split_confusion": f"{_J} SELECT CASE WHEN grouping(cl) = 1 THEN 'TOTAL' ELSE cl END AS claimed, {_COUNTS} FROM (SELECT *, coalesce(claimed, '<blank>') AS cl FROM j WHERE listed) GROUP BY ROLLUP (cl)",
    "split_confusion_by_family": f"{_J} SELECT family, coalesce(claimed, '<blank>') AS claimed, {_COUNTS} FROM j WHERE listed GROUP BY 1, 2",
    "disagreement_composition": f"""{_J}, cell AS (SELECT * FROM j WHERE claimed = 'train' AND split = 'valid')
SELECT axis, value, count(*) AS n FROM (SELECT 'family' AS axis, family AS value FROM cell UNION ALL SELECT 'device', coalesce(csv_device, '<no device>') FROM cell
  UNION ALL SELECT 'date', bucket FROM cell UNION ALL SELECT 'background', coalesce(background, '<blank>') FROM cell) GROUP BY ALL""",
    "disagreement_overlap": f"""{_J}, a AS (SELECT DISTINCT csv_device AS k FROM j WHERE claimed = 'train' AND split = 'valid' AND csv_device IS NOT NULL),
  b AS (SELECT DISTINCT csv_device AS k FROM j WHERE claimed = 'valid' AND split = 'train' AND csv_device IS NOT NULL),
  n AS (SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both)
SELECT *, CASE WHEN n_left = n_both AND n_right = n_both THEN 'identical' WHEN n_both = 0 THEN 'disjoint' WHEN n_left = n_both THEN 'left_within_right' WHEN n_right = n_both THEN 'right_within_left' ELSE 'partial' END AS verdict FROM n""",
    "provenance_claims": f"""WITH {IMG}, {_V1}, {_V2}, n AS (SELECT 't1' AS claim, 'every stem of v1 is in v2' AS statement, (SELECT count(*) FROM (SELECT stem FROM v1 EXCEPT SELECT stem FROM v2)) AS violations
  UNION ALL SELECT 't2', 'every stem of v2 is in v1', (SELECT count(*) FROM (SELECT stem FROM v2 EXCEPT SELECT stem FROM v1))
  UNION ALL SELECT 't3', 'every stem of v1 has an image', (SELECT count(*) FROM (SELECT stem FROM v1 EXCEPT SELECT stem FROM img))
  UNION ALL SELECT 't4', 'every image is in a copy', (SELECT count(*) FROM (SELECT stem FROM img WHERE stem IS NOT NULL EXCEPT SELECT stem FROM v1 EXCEPT SELECT stem FROM v2)))
SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM n""",
    "date_histogram": f"""WITH {_V1}, {_V2}, b AS (SELECT stem, 1 AS x, 0 AS y FROM v1 UNION ALL SELECT stem, 0, 1 FROM v2)
SELECT CASE WHEN {S.name_digits('stem')} IS NOT NULL THEN substr({S.name_digits('stem')}, 1, 8) WHEN {S.family('stem')} = 'counter' THEN '<untimestamped:counter>' ELSE '<unparsed-filename>' END AS bucket,
  sum(x)::BIGINT AS n_v1, sum(y)::BIGINT AS n_v2 FROM b GROUP BY 1""",
}
