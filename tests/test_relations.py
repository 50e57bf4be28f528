"""Coverage, split algebra, results and expectations on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from splitwright.operators import coverage as C
from splitwright.operators import expectations as X
from splitwright.operators import results as R
from splitwright.operators import splits as P


def test_split_counts_total_and_zero(spark, rows):
    df = spark.createDataFrame([("a", "train"), ("a", None), ("b", "test")], "k string, s string")
    assert rows(C.split_counts(df, "k", "s", ["train", "valid", "test"])) == [("TOTAL", 1, 0, 1, 3), ("a", 1, 0, 0, 2), ("b", 0, 0, 1, 1)]


def test_percent_without_a_whole(spark):
    assert spark.range(1).select(C.percent(F.lit(0), F.lit(0)), C.percent(F.lit(1), F.lit(3))).first()[:] == (0.0, 33.3)


def test_composition_reads_rows_once(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", None)], "p string, q string")
    assert rows(C.composition(df, {"p": "p", "q": "q"})) == sorted([("p", "a", 2), ("q", "x", 1), ("q", None, 1)], key=repr)


def test_only_in_ignores_null_keys_of_the_other_side(spark, rows):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    assert rows(C.only_in(a, a.where("k = 'x' or k is null"), "k")) == sorted([("y",), (None,)], key=repr)


@pytest.mark.parametrize("left, right, verdict", [("ab", "ab", "identical"), ("a", "b", "disjoint"), ("a", "ab", "left_within_right"), ("ab", "a", "right_within_left"), ("ab", "bc", "partial")])
def test_verdicts(spark, left, right, verdict):
    a, b = (spark.createDataFrame([(c,) for c in s], "k string") for s in (left, right))
    assert C.overlap_verdict(a, b, "k").first()["verdict"] == verdict


def test_ambiguity_and_single_split(spark, rows):
    df = spark.createDataFrame([("f", "d1", "train"), ("f", "d2", "train"), ("g", "d1", "test"), ("g", None, "train"), ("h", "-", None)], "f string, d string, s string")
    assert rows(C.ambiguous_keys(df, "f", "d", "-")) == [("f", 2, "d1|d2")]
    assert rows(C.single_split_keys(df, "f", "s")) == [("f", "train", 2)]


def test_full_counts(spark, rows):
    a, b = spark.createDataFrame([("x",), ("x",)], "k string"), spark.createDataFrame([("y",)], "k string")
    assert rows(C.full_counts(a, b, "k", ("n_a", "n_b"))) == [("x", 2, 0), ("y", 0, 1)]


def test_class_counts_include_absent_classes(spark):
    boxes = spark.createDataFrame([(1, 10, "train"), (1, 10, "train"), (1, 11, "valid")], "class_id int, image_id long, split string")
    classes = spark.createDataFrame([(1, "a"), (2, "b")], "class_id int, class_name string")
    got = {r["class_id"]: r.asDict() for r in P.class_split_counts(boxes, classes).collect()}
    assert (got[1]["images_train"], got[1]["instances_train"], got[1]["images_valid"]) == (1, 2, 1)
    assert all(got[2][c] == 0 for c in got[2] if c.startswith(("images", "instances")))


def test_thresholds_are_strict(spark, rows):
    df = spark.createDataFrame([(0,), (5,), (6,)], "v int")
    assert rows(P.threshold_histogram(df, "v", [1, 5, 6])) == [(1, 1), (5, 1), (6, 2)]


def test_ratio_shapes(spark):
    rows_ = [("a", s) for s, n in (("train", 70), ("valid", 20), ("test", 10)) for _ in range(n)] + [("b", "test")] + [("c", "train")] * 3 + [("c", "test")] * 3
    got = {r["k"]: r for r in P.ratio_by_group(spark.createDataFrame(rows_, "k string, split string"), "k").collect()}
    assert (got["a"]["shape"], got["a"]["max_abs_dev_pp"]) == ("balanced", 0.0)
    assert (got["b"]["shape"], got["c"]["shape"]) == ("single_split", "lopsided")


def test_changed_counts_null_against_a_label(spark):
    df = spark.createDataFrame([("g", "a", "a"), ("g", None, "a"), ("g", None, None)], "g string, x string, y string")
    r = P.changed_by(df, "x", "y", ["g"]).first()
    assert (r["total"], r["changed"], r["unchanged"]) == (3, 1, 2)


def test_pair_of_three_is_a_warning(spark):
    nan = float("nan")
    df = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", nan), ("t", 1.0), ("t", 2.0), ("t", 3.0), ("z", 0.0), ("z", 0.0)], "k string, v double")
    got = {r["k"]: r for r in R.pair_gaps(df, ["k"], "v").collect()}
    assert (got["m"]["mean"], got["m"]["gap"], got["m"]["pct_of_mean"], got["m"]["pct_of_max"], got["m"]["pct_of_min"]) == (2.0, 2.0, 100.0, 66.6667, 200.0)
    assert (got["t"]["verdict"], got["t"]["mean"]) == ("warning", None)
    assert got["z"]["pct_of_mean"] is None


def test_front_against_brute_force(spark, ws):
    import random

    rng = random.Random(2)
    pts = [(i, rng.randrange(60), rng.randrange(60)) for i in range(200)]
    df = spark.createDataFrame(pts + [(999, None, 100)], "id int, lo int, hi int")
    want = sorted(p[0] for p in pts if not any(q[1] <= p[1] and q[2] >= p[2] and (q[1] < p[1] or q[2] > p[2]) for q in pts))
    assert sorted(r["id"] for r in R.pareto_front(df, "id", "lo", "hi", ws).collect()) == want


def test_global_ranks(spark, ws):
    df = spark.createDataFrame([(i, (i * 37) % 50) for i in range(100)], "id long, v long")
    got = {r["id"]: r["rank"] for r in R.global_ranks(df, [-F.col("v")], "id", ws).collect()}
    want = sorted(range(100), key=lambda i: (-((i * 37) % 50), i))
    assert [i for i, _ in sorted(got.items(), key=lambda kv: kv[1])] == want and sorted(got.values()) == list(range(1, 101))


def test_nan_is_not_null(spark):
    nan = float("nan")
    df = spark.createDataFrame([("r", 1, 1.0, None), ("r", 2, nan, None), ("r", 3, None, 1.0), ("r", 4, 2.0, 1.0)], "run string, epoch int, a double, b double")
    got = {r["column"]: r for r in R.nan_onset(df, "run", "epoch", ["a", "b"]).collect()}
    assert (got["a"]["first_nan"], got["a"]["n_nan"], got["a"]["recovered"]) == (2, 1, "4")
    assert (got["b"]["first_nan"], got["b"]["recovered"]) == (None, "")


def test_best_step_takes_the_first_of_equal_ones(spark):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.5), ("r", 3, float("nan"))], "run string, epoch int, m double")
    assert R.best_step(df, "run", "epoch", {"m": 1.0}).first()["best_step"] == 1


def test_unanimity_skips_fields_that_are_null_throughout(spark, rows):
    df = spark.createDataFrame([("k", "a", None, "x"), ("k", "a", None, "y"), ("k", None, None, "x")], "k string, p string, q string, r string")
    assert rows(R.unanimity(df, "k", ["p", "q", "r"])) == [("k", "p", 1, "a"), ("k", "r", 2, None)]


def test_key_sets(spark):
    a, b = spark.range(3), spark.range(1, 3)
    assert R.key_sets_equal(a, b, "id").first()[:] == (1, 0, False)


def test_expectation_states(spark):
    known = spark.createDataFrame([("m", "x", "1.25"), ("m", "x", "1.25"), ("m", "y", "1"), ("m", "y", "2"), ("m", "z", ""), ("m", "t", "ab")], "item string, column string, value string")
    rows_ = [
        ("ok", "m", "x", "1.2", 0.05), ("off", "m", "x", "1.2", 0.01), ("dis", "m", "y", "1", None), ("empty", "m", "z", "1", None), ("text", "m", "t", "ab", None),
        ("row", "q", "x", "1", None), ("col", "m", "w", "1", None),
    ]
    got = {r["label"]: r["verdict"] for r in X.verify(X.expectation_rows(spark, rows_), known).collect()}
    assert got == {"ok": "PASS", "off": "FAIL", "dis": "DISAGREES", "empty": "EMPTY", "text": "PASS", "row": "NO ROW", "col": "NO COLUMN"}


def test_require_raises_with_the_failing_rows(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (None, 2, 3)], "a int, b int, t int")
    report = X.report([X.checks(df, {"adds up": F.col("a") + F.col("b") == F.col("t")}), X.row_count(df, 3, "three rows"), X.unique(df, ["a"], "a is unique")])
    assert {r["check"]: r["violations"] for r in report.collect()} == {"adds up": 2, "three rows": 0, "a is unique": 1}
    with pytest.raises(X.CheckFailed, match="adds up"):
        X.require(report)
    X.require(X.row_count(df, 3, "three rows"))
