"""Classes by split and date, ratios and deviations of groups, transitions between the copies, group moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import coverage as C
from ..operators import frames
from ..operators import results as R
from ..operators import splits as P
from ..session import Workspace
from ..sources import sinks
from ..sources.tables import table
from . import sqltext as S
from .timeline import IMG, STATES

THRESHOLDS = [1, 5, 10, 20, 30, 50, 100]


def _images(spark: SparkSession, d: str) -> DataFrame:
    return frames.image_frame(table(spark, d, "images"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Valid boxes with their image's id, split and date bucket."""
    held = frames.box_frame(table(spark, d, "boxes"), table(spark, d, "classes"))
    listed = _images(spark, d).select("filename", "image_id", "split", "bucket", "family")
    return held.join(listed, held["image"] == listed["filename"])


def class_split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Images and boxes of each class in each split."""
    return P.class_split_counts(_boxes(spark, d), table(spark, d, "classes"))


def never_evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Classes with no box in valid or none in test, and which of them."""
    counts = class_split_counts(spark, d)
    verdict = (
        F.when((F.col("images_valid") == 0) & (F.col("images_test") == 0), "neither")
        .when(F.col("images_test") == 0, "not in test")
        .when(F.col("images_valid") == 0, "not in valid")
    )
    return counts.select("class_id", "class_name", verdict.alias("verdict")).where("verdict is not null")


def test_count_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """How many classes have fewer than each number of test images."""
    return P.threshold_histogram(class_split_counts(spark, d), "images_test", THRESHOLDS)


def date_split_summary(spark: SparkSession, d: str) -> DataFrame:
    """Images by date bucket and split, and whether the date is in train only."""
    counts = C.split_counts(_images(spark, d), "bucket", "split", N.SPLITS, total=False)
    return counts.withColumn("train_only", (F.col("train") > 0) & (F.col("valid") == 0) & (F.col("test") == 0))


def classes_by_date(spark: SparkSession, d: str) -> DataFrame:
    """For each class its dates, and whether they are all dates that are in train only."""
    only = date_split_summary(spark, d).where("train_only").select("bucket", F.lit(1).alias("only"))
    dates = _boxes(spark, d).select("class_id", "bucket").where("bucket is not null").distinct().join(only, "bucket", "left")
    return dates.groupBy("class_id").agg(F.count("*").alias("n_dates"), (F.count("only") == F.count("*")).alias("train_only_dates"))


def rejected_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that aren't valid, counted by what is wrong with them."""
    return P.rejected_boxes(table(spark, d, "boxes"), table(spark, d, "classes"))


def box_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Files with boxes that aren't listed, and listed files without a valid box."""
    held = frames.box_frame(table(spark, d, "boxes"), table(spark, d, "classes")).select(F.col("image").alias("filename")).distinct()
    files = _images(spark, d).select("filename")
    a = C.only_in(held, files, "filename").agg(F.count("*").alias("n")).select(F.lit("boxes without image").alias("finding"), "n")
    b = C.only_in(files, held, "filename").agg(F.count("*").alias("n")).select(F.lit("image without boxes").alias("finding"), "n")
    return a.unionByName(b)


def build_checks(spark: SparkSession, d: str) -> DataFrame:
    """What a built data set must keep: labels beside images, no orphans, ids and numbers in range, no label twice."""
    return sinks.build_checks(*[table(spark, d, t) for t in ("images", "boxes", "classes")])


def classes_by_area(spark: SparkSession, d: str) -> DataFrame:
    """Classes from the largest mean box to the smallest, then by name; those without a box come last."""
    mean = _boxes(spark, d).groupBy("class_id").agg(F.round(F.avg(F.round(F.col("w") * F.col("h"), 9).cast("decimal(12,9)")).cast("double"), 6).alias("mean_area"))
    classes = table(spark, d, "classes").join(mean, "class_id", "left")
    order = [F.col("mean_area").isNull(), -F.coalesce("mean_area", F.lit(0.0)), F.col("class_name")]
    return classes.join(R.global_ranks(classes, order, "class_id", Workspace(spark, "areas")), "class_id").select("rank", "class_id", "class_name", "mean_area")


def ratio_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Each capture group's shares against 70/20/10."""
    return P.ratio_by_group(_images(spark, d).withColumn("capture_group", C.or_label("capture_group", "<no group>")), "capture_group")


def deviation_by_shape(spark: SparkSession, d: str) -> DataFrame:
    """Groups by the shape of their deviation."""
    return P.deviation_by_shape(ratio_by_group(spark, d))


def ratios_dated(spark: SparkSession, d: str) -> DataFrame:
    """Groups with their dates spelled out, undated ones last."""
    ratios = ratio_by_group(spark, d).select("capture_group", N.pretty_date("capture_group").alias("label"), "total")
    return ratios.withColumn("undated", ~F.col("capture_group").rlike(r"\A\d{8}\z")).orderBy("undated", "capture_group")


def _copies(spark: SparkSession, d: str) -> DataFrame:
    one = frames.manifest_frame(table(spark, d, "manifest_v1"), "v1_split").select("stem", "capture_group", "device", F.col("claimed").alias("v1"))
    two = frames.manifest_frame(table(spark, d, "manifest_v2"), "v2_split").select("stem", F.col("claimed").alias("v2"))
    return one.join(two, "stem")


def split_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Stems by their split in the first and in the second copy."""
    return P.transitions(_copies(spark, d), "v1", "v2")


def changes_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Stems whose split changed between the copies, by capture group and device."""
    return P.changed_by(_copies(spark, d), "v1", "v2", ["capture_group", "device"])


def moved_images(spark: SparkSession, d: str) -> DataFrame:
    """Images by listed split and split after the groups' latest moves."""
    states = frames.current_splits(_images(spark, d), table(spark, d, "images"), table(spark, d, "groups_moved"))
    return P.transitions(states, "split", "moved_split")


def moves_by_date(spark: SparkSession, d: str) -> DataFrame:
    """Moved images by date bucket, and the share of the bucket they are."""
    states = frames.current_splits(_images(spark, d), table(spark, d, "images"), table(spark, d, "groups_moved"))
    moved = ~F.col("split").eqNullSafe(F.col("moved_split"))
    n = states.groupBy("bucket").agg(F.count("*").alias("n_images"), F.count_if(moved).alias("n_moved"))
    return n.withColumn("pct_moved", F.round(100 * F.col("n_moved") / F.col("n_images"), 4))


QUERIES = {
    f.__name__: f
    for f in (
        class_split_counts, never_evaluated, test_count_thresholds, date_split_summary, classes_by_date, rejected_boxes, box_coverage, ratio_by_group,
        deviation_by_shape, ratios_dated, split_transitions, changes_by_group, moved_images, moves_by_date, build_checks, classes_by_area,
    )
}

# NaN is told by its text: the column statistics of a file may not know of it, and comparisons are folded by them
_VALID = "cx::VARCHAR <> 'nan' AND cy::VARCHAR <> 'nan' AND w::VARCHAR <> 'nan' AND h::VARCHAR <> 'nan' AND cx > 0 AND cx <= 1 AND cy > 0 AND cy <= 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1"
#: box: the SQL form of _boxes.
BOX = f"""box AS (SELECT DISTINCT b.*, img.image_id, img.split, img.bucket FROM boxes b JOIN classes USING (class_id) JOIN img ON img.filename = b.image WHERE {_VALID})"""
_CSC = f"WITH {IMG}, {BOX}, csc AS (SELECT c.class_id, class_name, " + ", ".join(
    f"count(DISTINCT image_id) FILTER (WHERE split = '{s}') AS images_{s}, count(box.image_id) FILTER (WHERE split = '{s}') AS instances_{s}" for s in N.SPLITS
) + " FROM classes c LEFT JOIN box USING (class_id) GROUP BY ALL)"
_RATIO = f"""WITH {IMG}, g AS (SELECT coalesce(CASE WHEN trim(capture_group) <> '' THEN capture_group END, '<no group>') AS capture_group, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'valid') AS n_valid,
  count(*) FILTER (WHERE split = 'test') AS n_test, count(*) AS total FROM img WHERE split IS NOT NULL GROUP BY 1),
  p AS (SELECT *, 100.0::DOUBLE * n_train / total AS a, 100.0::DOUBLE * n_valid / total AS b, 100.0::DOUBLE * n_test / total AS c FROM g),
  r AS (SELECT capture_group, n_train, n_valid, n_test, total, round(a, 4) AS pct_train, round(b, 4) AS pct_valid, round(c, 4) AS pct_test, round(a - 70, 4) AS dev_train, round(b - 20, 4) AS dev_valid, round(c - 10, 4) AS dev_test,
    round(greatest(abs(a - 70), abs(b - 20), abs(c - 10)), 4) AS max_abs_dev_pp FROM p),
  s AS (SELECT *, CASE WHEN greatest(n_train, n_valid, n_test) = total THEN 'single_split' WHEN max_abs_dev_pp < 5 THEN 'balanced' WHEN max_abs_dev_pp < 30 THEN 'skewed' ELSE 'lopsided' END AS shape FROM r)"""
_DATES = "d AS (SELECT bucket, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total FROM img GROUP BY bucket)"
_ONLY = "train > 0 AND valid = 0 AND test = 0"
_COPIES = f"""WITH {S.manifest('v1', 'manifest_v1', 'v1_split')}, {S.manifest('v2', 'manifest_v2', 'v2_split')},
  c AS (SELECT v1.capture_group, v1.device, v1.claimed AS v1, v2.claimed AS v2 FROM v1 JOIN v2 USING (stem))"""

ORACLES = {
    "build_checks": f"""WITH f AS (SELECT DISTINCT filename AS name FROM images WHERE filename IS NOT NULL), l AS (SELECT DISTINCT image AS name FROM boxes WHERE image IS NOT NULL), t AS (
  SELECT 'images have labels' AS "check", count(*) AS n, count(*) FILTER (WHERE name NOT IN (SELECT name FROM l)) AS violations FROM f
  UNION ALL SELECT 'labels have images', count(*), count(*) FILTER (WHERE name NOT IN (SELECT name FROM f)) FROM l
  UNION ALL SELECT 'class ids are known', count(*), count(*) FILTER (WHERE class_id IS NULL OR class_id NOT IN (SELECT class_id FROM classes)) FROM boxes
  UNION ALL SELECT 'numbers are in range', count(*), count(*) FILTER (WHERE NOT coalesce({_VALID}, false)) FROM boxes
  UNION ALL SELECT 'no label is repeated', coalesce(sum(k), 0)::BIGINT, coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(*) AS k FROM boxes GROUP BY image, class_id, cx, cy, w, h))
SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t""",
    "classes_by_area": f"""WITH {IMG}, {BOX}, m AS (SELECT class_id, round(avg(round(w * h, 9)::DECIMAL(12, 9)), 6) AS mean_area FROM box GROUP BY 1)
SELECT row_number() OVER (ORDER BY mean_area DESC NULLS LAST, class_name) AS rank, class_id, class_name, mean_area FROM classes LEFT JOIN m USING (class_id)""",
    "class_split_counts": _CSC + " SELECT * FROM csc",
    "never_evaluated": _CSC
    + """ SELECT class_id, class_name, CASE WHEN images_valid = 0 AND images_test = 0 THEN 'neither' WHEN images_test = 0 THEN 'not in test' ELSE 'not in valid' END AS verdict FROM csc WHERE images_valid = 0 OR images_test = 0""",
    "test_count_thresholds": _CSC + f" SELECT threshold, count(*) FILTER (WHERE images_test < threshold) AS n FROM csc, (SELECT unnest({THRESHOLDS}) AS threshold) GROUP BY threshold",
    "date_split_summary": f"WITH {IMG}, {_DATES} SELECT *, {_ONLY} AS train_only FROM d",
    "classes_by_date": f"""WITH {IMG}, {BOX}, {_DATES} SELECT class_id, count(*) AS n_dates, bool_and({_ONLY}) AS train_only_dates FROM (SELECT DISTINCT class_id, bucket FROM box) x JOIN d USING (bucket) GROUP BY class_id""",
    "rejected_boxes": f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN class_id IS NULL OR class_id NOT IN (SELECT class_id FROM classes) THEN 'class'
  WHEN cx IS NULL OR cy IS NULL OR w IS NULL OR h IS NULL OR 'nan' IN (cx::VARCHAR, cy::VARCHAR, w::VARCHAR, h::VARCHAR) THEN 'void' WHEN NOT ({_VALID}) THEN 'range' END AS reason FROM boxes) WHERE reason IS NOT NULL GROUP BY reason""",
    "box_coverage": f"""WITH {IMG}, h AS (SELECT DISTINCT image FROM boxes JOIN classes USING (class_id) WHERE {_VALID})
SELECT 'boxes without image' AS finding, count(*) AS n FROM h WHERE image NOT IN (SELECT filename FROM img WHERE filename IS NOT NULL)
UNION ALL SELECT 'image without boxes', count(*) FROM img WHERE filename NOT IN (SELECT image FROM h)""",
    "ratio_by_group": _RATIO + " SELECT * FROM s",
    "deviation_by_shape": _RATIO + " SELECT shape, count(*) AS n_groups, sum(total)::BIGINT AS images, max(max_abs_dev_pp) AS worst_pp FROM s GROUP BY shape",
    "ratios_dated": _RATIO
    + r""" SELECT capture_group, CASE WHEN regexp_full_match(capture_group, '\d{8}') AND try_strptime(capture_group, '%Y%m%d') IS NOT NULL THEN strftime(try_strptime(capture_group, '%Y%m%d'), '%-d %b %Y') ELSE capture_group END AS label, total, NOT regexp_full_match(capture_group, '\d{8}') AS undated FROM s""",
    "split_transitions": _COPIES + " SELECT v1, v2, count(*) AS n FROM c GROUP BY ALL",
    "changes_by_group": _COPIES
    + """ SELECT capture_group, device, count(*) AS total, count(*) FILTER (WHERE v1 IS DISTINCT FROM v2) AS changed, count(*) FILTER (WHERE v1 IS NOT DISTINCT FROM v2) AS unchanged,
  round(100.0::DOUBLE * count(*) FILTER (WHERE v1 IS DISTINCT FROM v2) / count(*), 4) AS pct_changed FROM c GROUP BY ALL""",
    "moved_images": f"WITH {STATES} SELECT split, moved_split, count(*) AS n FROM st GROUP BY ALL",
    "moves_by_date": f"""WITH {STATES} SELECT bucket, count(*) AS n_images, count(*) FILTER (WHERE split IS DISTINCT FROM moved_split) AS n_moved,
  round(100.0::DOUBLE * count(*) FILTER (WHERE split IS DISTINCT FROM moved_split) / count(*), 4) AS pct_moved FROM st GROUP BY bucket""",
}
