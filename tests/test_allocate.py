from pathlib import Path

import pytest

from pyspark.sql import functions as F

from splitwright.operators import allocate as A
from splitwright.plans import allocation as P
from tests.oracle import DATA


def case(spark):
    """Class 1 is short in test and valid; two train units could give it, a mixed one must not move."""
    units = {"u1": ("train", 2, {1: 5}), "u2": ("train", 4, {1: 5}), "u3": ("train", 1, {2: 9}), "m": (None, 3, {1: 9}), "t1": ("test", 1, {2: 1}), "t2": ("test", 1, {2: 1}), "t3": ("test", 2, {2: 30}), "v1": ("valid", 4, {2: 1}), "v2": ("valid", 3, {2: 30})}
    images, member, boxes, k = [], [], [], 0
    for u, (split, n, has) in units.items():
        for i in range(n):
            k += 1
            images.append((k, split if split else ("train" if i else "test"), "20240101"))
            member.append((k, u))
            if i == 0:
                boxes += [(k, c) for c, m in has.items() for _ in range(m)]
    return (
        spark.createDataFrame(images, "image_id long, split string, bucket string"),
        spark.createDataFrame(member, "image_id long, unit string"),
        spark.createDataFrame(boxes, "image_id long, class_id int"),
        spark.createDataFrame([(1, "a"), (2, "b")], "class_id int, class_name string"),
    )


def test_admits_whole_train_units_and_returns_as_many_images(spark, ws, rows):
    images, member, boxes, classes = case(spark)
    # the mixed unit's boxes stand in test already: only valid is short of class 1
    per, cls = A.describe_units(member, images, boxes)
    got = A.allocate(per, cls, boxes, images, classes, ws, least=5)
    moves = rows(got.moves)
    assert got.unmet == {} and ("u1", "train", "valid", 2) in moves
    assert got.size_failures == {"valid": 2}  # no valid units of two images together that are safe to return
    assert not any(u == "m" for u, *_ in moves)


def test_units_are_total_and_disjoint(spark):
    images = spark.createDataFrame([(1, "k", 0, "A"), (2, "k", 5, "B"), (3, "k", None, "C"), (4, None, 9, "D"), (5, "k", None, None)], "image_id long, key string, second long, stem string")
    comps = spark.createDataFrame([("C", "C"), ("D", "C")], "id string, component string")
    got = {r["image_id"]: r["unit"] for r in A.build_units(images, comps, 15).collect()}
    assert got == {1: "burst:k:0", 2: "burst:k:0", 3: "scene:C", 4: "scene:C", 5: "image:5"}


def test_subset_sums():
    assert A.sizes_summing_to({3: 2, 5: 1}, 7) is None
    assert A.sizes_summing_to({3: 2, 5: 1}, 11) == {5: 1, 3: 2}
    assert A.sizes_summing_to({}, 0) == {}
    got = A.sizes_summing_to({1: 3, 4: 2, 7: 5}, 24)
    assert sum(s * k for s, k in got.items()) == 24


def test_feasibility_verdicts(spark):
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "unit string")
    cls = spark.createDataFrame([("a", 1, 6), ("b", 1, 5), ("a", 2, 9), ("a", 3, 1), ("b", 3, 9)], "unit string, class_id int, n_boxes long")
    classes = spark.createDataFrame([(k, str(k)) for k in (1, 2, 3, 4)], "class_id int, class_name string")
    got = {r["class_id"]: r["verdict"] for r in A.feasibility(cls.withColumn("setting", F.lit("x")), classes, ["x"]).collect()}
    assert got == {1: "has_alternatives", 2: "single_unit", 3: "insufficient", 4: "absent"}


def test_nothing_short_moves_nothing(spark, ws, rows):
    images, member, boxes, classes = case(spark)
    per, cls = A.describe_units(member, images, boxes)
    assert rows(A.allocate(per, cls, boxes, images, classes, ws, least=0).moves) == []


def test_sweep_marks_the_smallest_gap_that_satisfies(spark):
    row = lambda tau, ok: dict(tau=tau, units=1, straddling=0, moved=0, unmet=0, held=True, cross=0, ok=ok)
    got = A.sweep_table([row(15, False), row(60, True), row(30, True)], spark)
    assert {r["tau"] for r in got.where("smallest").collect()} == {30}
    assert A.sweep_table([row(15, False)], spark).where("smallest").isEmpty()


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_all_gaps_of_the_reference(spark):
    assert [r["tau"] for r in P.tau_sweep(spark, DATA).orderBy("tau").collect()] == [15, 20, 25, 30, 35, 45, 60]
    tried = {r["setting"] for r in P.unit_feasibility_all_gaps(spark, DATA).select("setting").distinct().collect()}
    assert tried >= {f"tau={t}s" for t in (3, 5, 10, 30, 60)}
