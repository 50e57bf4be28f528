import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitwright.operators import bursts as B

IMAGES = "image_id long, filename string, stem string, family string, ts timestamp_ntz, epoch double, capture_group string, device_name string, second long, n int"
PAIRS = "stem_a string, device_a string"


def brute(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return [(a, b, b - a, n) for a, b, n in out]


def run(spark, times, gap):
    df = spark.createDataFrame([("e", t) for t in times] + [(None, 5), ("e", None)], "k string, t long")
    return sorted(tuple(r)[1:] for r in B.sessions(df, "k", "t", gap).collect())


def test_gap_itself_does_not_cut(spark):
    assert run(spark, [0, 15, 31], 15) == [(0, 15, 15, 2), (31, 31, 0, 1)]


@pytest.mark.parametrize("gap", [1, 2, 15, 63, 64, 65, 1000, 100_000])
def test_against_brute_force(spark, gap):
    rng = random.Random(gap)
    times = [rng.randrange(-200_000, 400_000) for _ in range(400)] + [65535, 65536, 65536, 63, 64, 131071, 131072, 0, -1]
    assert run(spark, times, gap) == sorted(brute(times, gap))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-70_000, 140_000), max_size=60), st.integers(1, 200))
def test_any_times(spark, times, gap):
    assert run(spark, times, gap) == sorted(brute(times, gap))


def test_long_dense_session_spans_blocks(spark):
    times = list(range(0, 300_000, 10))
    assert run(spark, times, 10) == [(0, 299_990, 299_990, len(times))]


@pytest.mark.parametrize("gap", [50, 100, 200])
def test_a_run_goes_on_over_words_by_the_closing(spark, gap):
    # one second in each of the words 0, 1, 3 and 6: the closing must carry over none, one and two empty words
    times = [60, 64 + 40, 3 * 64 + 10, 6 * 64 + 5]
    assert run(spark, times, gap) == sorted(brute(times, gap))


def test_where_runs_begin_in_a_word(spark):
    def begins(bits, before, gap):
        df = spark.createDataFrame([(bits, 640, before)], "bits long, base long, before long")
        return df.select(B.run_begins(F.col("bits"), F.col("base"), F.col("before"), gap)).first()[0]

    assert begins(0b1001, None, 3) == 0b0001 and begins(0b1001, None, 2) == 0b1001
    assert begins(0b1001, 637, 3) == 0 and begins(0b1001, 636, 3) == 0b0001 and begins(-(2**63), 100, 603) == 0
    assert begins(-(2**63) | 1, 639, 1) == -(2**63) and begins(1, 0, 639) == 1 and begins(1, 0, 640) == 0


def test_bad_gap():
    with pytest.raises(ValueError):
        B.sessions(None, "k", "t", 0)


def test_captures(spark, rows):
    images = spark.createDataFrame(
        [
            (1, "IMG_0001.jpg", None, "counter", None, 100.9, None, None, 0, 0),
            (1, "IMG_0001.jpg", None, "counter", None, 100.9, None, None, 0, 0),
            (2, "IMG_20120101_000000.jpg", None, "ts_underscore", None, None, None, "Rill 7", 0, 0),
            (3, "IMG_20121501_000000.jpg", None, "ts_underscore", None, None, None, "Rill 7", 0, 0),
            (4, "CLK_000010_1.png", None, "clock", None, None, "20120101", " ", 0, 0),
            (5, "CLK_000010_2.png", None, "clock", None, None, "20120231", "Q", 0, 0),
            (6, None, None, None, None, None, None, None, 0, 0),
            (7, "x.jpg", None, "unparsed", datetime(2012, 1, 1), float("nan"), None, "Q", 0, 0),
        ],
        IMAGES,
    )
    pairs = spark.createDataFrame([("img_0001.png", "Q 9"), ("IMG20120101000005", "Q"), ("IMG20120101000009", "-"), (None, "Q")], PAIRS)
    day = 1325376000
    assert rows(B.captures(images, pairs)) == sorted(
        [
            ("IMG_0001", "Q9", 100),
            ("IMG_20120101_000000", "RILL7", day),
            ("IMG_20121501_000000", "RILL7", None),
            ("CLK_000010_1", "FAMILY:clock", day + 10),
            ("CLK_000010_2", "Q", None),
            ("X", "Q", day),
            ("IMG20120101000005", "Q", day + 5),
        ],
        key=repr,
    )
    assert rows(B.capture_bursts(images, pairs)) == sorted([("Q9", 100, 100, 0, 1), ("RILL7", day, day, 0, 1), ("FAMILY:clock", day + 10, day + 10, 0, 1), ("Q", day, day + 5, 5, 2)], key=repr)


def test_empty(spark, rows):
    assert rows(B.capture_bursts(spark.createDataFrame([], IMAGES), spark.createDataFrame([], PAIRS))) == []
