from pyspark.sql import functions as F

from splitwright.functions import names as N

HEX = "86ccf99f5ec931ec6783ddf155143993"


def read(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f("x").alias("y")).orderBy("i").collect()]


def test_stem(spark):
    got = read(spark, [f"IMG_5126_JPG.rf.{HEX}.jpg", " a/b/img_1.PNG\t", "IMG_1.tar.jpeg", "x.gif", f"a_jpg.rf.{HEX[:-1]}.jpg", "", "  ", None, ".jpg"], N.stem)
    assert got == ["IMG_5126", "IMG_1", "IMG_1.TAR", "X.GIF", f"A_JPG.RF.{HEX[:-1].upper()}", None, None, None, None]


def test_stem_keeps_inner_tail(spark):
    assert read(spark, [f"a_png.rf.{HEX}.png_jpg.rf.{HEX}.jpg"], N.stem) == [f"A_PNG.RF.{HEX.upper()}.PNG"]


def test_family_order(spark):
    names = ["IMG20240228131921_01", "IMG20240228131921", "IMG_20240219_113620", "IMG_5126", "IMG_512", "CLK_235959_7", "HOLIDAY", None]
    assert read(spark, names, N.family) == ["ts_compact_sub", "ts_compact", "ts_underscore", "counter", "unparsed", "clock", "unparsed", None]


def test_impossible_date_keeps_bucket_and_has_no_time(spark):
    assert read(spark, ["IMG_20240230_113620", "IMG_20240229_246000"], N.name_seconds) == [None, None]
    assert read(spark, ["IMG_20240230_113620", "IMG_0001", "X", None], N.date_bucket) == ["20240230", N.COUNTER_BUCKET, N.UNPARSED_BUCKET, None]


def test_time(spark):
    assert read(spark, ["IMG19700102000001", "IMG20240228131921_01"], N.name_seconds) == [86401, 1709126361]


def test_splits_devices(spark):
    assert read(spark, [" VAL\t", "validation", "Training", "test", "", "dev", None], N.split_label) == ["valid", "valid", "train", "test", None, None, None]
    assert read(spark, ["Rill-7 #00002", "  ", "é", None], N.device_key) == ["RILL700002", None, None, None]


def test_route_and_dates(spark):
    assert read(spark, [f"a_jpg.rf.{HEX}.jpg", "a.jpg", None], N.name_route) == ["export", "raw", None]
    assert read(spark, ["20240219", "20241599", "<x>", None], N.pretty_date) == ["19 Feb 2024", "20241599", "<x>", None]


def test_effective_score(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 0.1, 0.0, 0.0), (1, nan, 0.3, 0.2), (2, None, nan, 0.2), (3, None, None, nan)], "i int, s double, a double, b double")
    assert [r["e"] for r in df.select("i", N.effective_score("s", "a", "b").alias("e")).orderBy("i").collect()] == [0.1, 0.2, 0.2, None]


def test_low_info(spark):
    df = spark.createDataFrame([(0, True, 9), (1, None, 2), (2, None, None), (3, False, 1)], "i int, f boolean, n int")
    assert [r["e"] for r in df.select("i", N.low_info("f", "n").alias("e")).orderBy("i").collect()] == [True, True, False, False]


def test_relation(spark):
    df = spark.createDataFrame([("train", "test"), ("test", "train"), ("test", "test"), (None, "test")], "a string, b string")
    assert [r[0] for r in df.select(N.relation(F.col("a"), F.col("b"))).collect()] == ["test<->train", "test<->train", None, None]


def test_seconds_do_not_depend_on_the_session_zone(spark):
    from datetime import datetime

    df = spark.createDataFrame([(datetime(2012, 7, 1, 12, 0, 1), "IMG_20120701_120001"), (datetime(1969, 12, 31, 23, 59, 59), "IMG_19691231_235959")], "t timestamp_ntz, s string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [tuple(r) for r in df.select(N.seconds_of("t"), N.name_seconds("s")).collect()] == [(1341144001, 1341144001), (-1, -1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
