import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from splitwright.functions import text as X
from splitwright.operators import copies as C

V1 = "row_no long, image_name string, v1_split string, capture_group string, device_name string, background string, n_boxes int, mean_area double, exported_at timestamp_ntz, stem string"
V2 = "row_no long, image_name string, v2_split string, capture_group string, device_name string, background string, n_boxes string, mean_area double, exported_at string, _row int"
PUBLISHED = "capture_group string, device_name string, imgs_in_csv int, imgs_changed_split int, imgs_unchanged int, pct_changed double"
AT = datetime(2012, 4, 14, 12, 0, 0)


def v1(spark, *rows):
    return spark.createDataFrame([r + ("clash",) for r in rows], V1)


def v2(spark, *rows):
    return spark.createDataFrame([r + (7,) for r in rows], V2)


def test_equal_in_other_notation(spark, rows):
    a = v1(spark, (1, "IMG_0001.jpg", "train", "20120414", "Rill 7", "Küchentisch", 6, 0.5, AT), (2, "IMG_0002", None, "-", "NA", None, None, float("nan"), None))
    b = v2(
        spark,
        (1, "x/img_0001", " Training", "20120414 ", "rill-7", unicodedata.normalize("NFD", "KÜCHENTISCH"), "6.0", 0.50005, "2012-04-14T14:00:00+02:00"),
        (2, "img_0002.PNG", None, "n/a", "", " ", "", None, "NA"),
    )
    assert rows(C.manifest_differences(a, b)) == []


def test_each_field(spark, rows):
    a = v1(spark, (1, "A", "train", "1", "D", "x", 1, 0.1, AT))
    b = v2(spark, (1, "A", "test", "2", "E", None, "2", 0.2, "14.04.2012 12:00:01"))
    assert [r[2] for r in rows(C.manifest_differences(a, b))] == sorted(C.MANIFEST_FIELDS)


def test_latest_row_counts_and_missing_rows(spark, rows):
    a = v1(spark, (1, "A", "test", None, None, None, 1, None, AT), (5, "a.jpg", "train", None, None, None, 1, None, AT), (6, None, "train", None, None, None, 1, None, AT), (7, "B", "train", None, None, None, 1, None, AT))
    b = v2(spark, (1, "A", "train", None, None, None, "1", None, str(int(AT.timestamp()) if AT.tzinfo else 1334404800)), (2, "C", "train", None, None, None, "1", None, None))
    assert rows(C.manifest_differences(a, b)) == [("only_v1", "B", "row"), ("only_v2", "C", "row")]


def test_area_tolerance(spark, rows):
    a = v1(spark, (1, "A", None, None, None, None, None, 0.0101, None), (2, "B", None, None, None, None, None, 0.0102, None), (3, "C", None, None, None, None, None, None, None))
    b = v2(spark, (1, "A", None, None, None, None, None, 0.01, None), (2, "B", None, None, None, None, None, 0.01, None), (3, "C", None, None, None, None, None, 0.0, None))
    assert rows(C.manifest_differences(a, b)) == [("differs", "B", "mean_area"), ("differs", "C", "mean_area")]


def test_counts(spark, rows):
    a = v1(spark, (1, "A", "train", "1", "D", None, 1, None, None), (2, "B", "train", "1", "D", None, 1, None, None))
    b = v2(spark, (1, "A", "test", "1", "D", None, "1", None, None), (2, "B", "train", "1", "D", None, "1", None, None))
    told = spark.createDataFrame([("1", "d", 2, 1, 1, 50.0), ("1", "e", 1, 1, 0, 100.0), ("2", "d", 0, 0, 0, 0.0), ("3", None, 0, None, 0, 0.0)], PUBLISHED)
    assert rows(C.wrong_counts(a, b, told)) == [("count", "1/E", "imgs_changed_split"), ("count", "3/", "imgs_changed_split")]


def test_empty_copies(spark, rows):
    assert rows(C.manifest_differences(v1(spark), v2(spark))) == []
    assert rows(C.manifest_differences(v1(spark, (1, "A", None, None, None, None, None, None, None)), v2(spark))) == [("only_v1", "A", "row")]
    assert rows(C.compare_manifests(v1(spark), v2(spark), spark.createDataFrame([], PUBLISHED))) == []


def test_hot_key_is_reduced_before_the_merge(spark, rows):
    a = v1(spark, *[(k, "A", "train", None, None, None, k, None, None) for k in range(2000)])
    b = v2(spark, (1, "A", "train", None, None, None, "1999", None, None))
    assert rows(C.manifest_differences(a, b)) == []


def test_merge_is_one_range_exchange(spark):
    a = spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("x"))
    plan = C.merge_copies(a, a, "k", ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_instants(spark):
    texts = ["2012-04-14T12:00:00Z", "2012-04-14 12:00:00", "2012-04-14T07:00:00-05:00", "14.04.2012 12:00:00", "1334404800", "31.02.2012 00:00:00", "soon", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["s"] for r in df.select("i", X.instant_seconds("t").alias("s")).orderBy("i").collect()]
    assert got == [1334404800.0] * 5 + [None] * 4
