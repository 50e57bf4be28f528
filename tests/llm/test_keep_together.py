import random
from datetime import datetime, timedelta

import numpy as np

from splitwright.llm import keep_together as K
from splitwright.llm import queries

IMAGES = "image_id long, filename string, split string, family string, group_id long, component long, bit int"
MOVES = "move_id long, direction string, split string, group_id long, n_images int, moved_at timestamp_ntz, moved boolean"
T0 = datetime(2024, 1, 1)


def plan(spark, ws, images, moves=(), **kw):
    return K.plan_splits(spark.createDataFrame([(*i, 0, 0) for i in images], IMAGES), spark.createDataFrame([(*m, True) for m in moves], MOVES), ws, **kw)


def test_groups_and_stems_stay_together_in_the_wanted_shares(spark, ws):
    rng = random.Random(0)
    images = [(i, f"IMG_{1000 + rng.randrange(900)}.jpg", "train", rng.choice(["a", "b"]), rng.choice([None, *range(200)])) for i in range(1000)]
    got = plan(spark, ws, images + images[:50], shard=150)
    at = {r["image_id"]: (r["component"], r["split"]) for r in got.assignment.collect()}
    assert len(at) == 1000 == got.assignment.count()
    for key in (1, 4):
        seen = {}
        for i in images:
            if i[key] is not None:
                assert seen.setdefault(i[key], at[i[0]]) == at[i[0]]
    by_component = {}
    for c, s in at.values():
        assert by_component.setdefault(c, s) == s
    groups = {r["group_id"]: r for r in got.groups.collect()}
    for g, r in groups.items():
        mine = {i[0] for i in images if i[4] == g}
        assert r["n_images"] == len(mine) and {at[i][1] for i in mine} == {r["split"]}


def test_shares_without_a_giant(spark, ws):
    images = [(i, f"IMG_{10000 + i}.jpg", None, "ab"[i % 2], i // 3) for i in range(3000)]
    got = plan(spark, ws, images, shard=400)
    n = {r["split"]: r["count"] for r in got.assignment.groupBy("split").count().collect()}
    assert abs(n["train"] - 2100) <= 15 and abs(n["valid"] - 600) <= 15 and abs(n["test"] - 300) <= 15


def test_a_third_in_one_component(spark, ws):
    images = [(i, f"IMG_{10000 + i}.jpg", None, "a", 7 if i < 300 else 1000 + i) for i in range(900)]
    n = {r["split"]: r["count"] for r in plan(spark, ws, images).assignment.groupBy("split").count().collect()}
    assert n == {"train": 630, "valid": 180, "test": 90}


def test_torn_groups(spark, ws):
    images = [
        (1, "A.jpg", "train", "f", 1), (2, "B.jpg", "test", "f", 1),  # two splits of its own
        (3, "C.jpg", "train", "f", 2), (4, "c.png", "test", "f", None),  # through a stem
        (5, "D.jpg", "train", "f", 3), (6, "E.jpg", None, "f", 3),  # unknown aside
        (7, "F.jpg", "train", "f", 4), (8, "G.jpg", "test", "f", 4),  # moved as one, in time order
        (9, "H.jpg", "train", "f", 5), (9, "H.jpg", "Train", "f", 5), (10, "I.jpg", "train", "f", 5),  # the move knew of one image
        (11, "J.jpg", "test", "f", 6),  # returned
        (12, "j.jpeg", "train", "f", 7),
        (13, None, "train", None, 8), (None, "A.jpg", "test", "f", 9),
    ]
    moves = [
        (1, "admitted", "valid", 4, 2, T0), (2, " Admitted", "TEST", 4, 2, T0 + timedelta(1)), (3, "returned", "test", 5, 1, T0), (4, "returned", "test", 6, None, T0),
        (5, "admitted", "test", 5, 2, T0 - timedelta(1)), (6, "admitted", "test", None, 1, T0), (7, "admitted", "test", 1, 9, None), (8, "admitted", "valid", 77, 1, T0),
    ]
    got = {r["group_id"]: r["torn"] for r in plan(spark, ws, images, moves).groups.collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: False}


def test_found_groups_come_out_of_the_plan_that_mends_them(spark, monkeypatch, tmp_path):
    # groups 0 to 39 of three images, every fourth torn; 100 is torn by a stem it shares with group 0
    images = [(i, f"IMG_{10000 + i}.jpg", "test" if i % 12 == 2 else "train", "f", i // 3) for i in range(120)]
    images += [(500, "img_10000.png", "train", "f", 100), (501, "IMG_10002.jpg", "train", "f", 100)]
    spark.createDataFrame([(*i, 0, 0) for i in images], IMAGES).write.parquet(f"{tmp_path}/images.parquet")
    spark.createDataFrame([], MOVES).write.parquet(f"{tmp_path}/groups_moved.parquet")
    plans, real = [], K.plan_splits
    monkeypatch.setattr(K, "plan_splits", lambda *args, **kw: plans.append(real(*args, **kw)) or plans[-1])
    found = sorted(r["group_id"] for r in queries.p4_found(spark, str(tmp_path)).collect())
    assert found == [*range(0, 40, 4), 100]
    at = {}
    for r in plans[0].groups.collect():
        at.setdefault(r["group_id"], []).append(r["split"])
    assert len(plans) == 1 and all(len(at[g]) == 1 for g in found) and at[0] == at[100]


def test_images_under_several_names_tie_them(spark, ws):
    images = [(1, "A.jpg", "train", "f", 1), (1, "B.jpg", "train", "f", None), (1, "C.jpg", "train", "f", 3), (2, "b.png", "train", "f", None), (3, "D.jpg", "train", "f", 3)]
    images += [(4, None, "train", "f", 5), (4, "E.jpg", "train", "f", None), (5, "E.jpg", "train", "f", None), (6, None, "train", "f", None), (7, "F.jpg", "train", "f", 5), (8, None, "train", "f", None)]
    at = {r["image_id"]: r["component"] for r in plan(spark, ws, images).assignment.collect()}
    assert len(at) == 8 and at[1] == at[2] == at[3] and at[4] == at[5] == at[7]
    assert len(set(at.values())) == 4


def test_annealing_never_ends_worse_than_it_started():
    rng = np.random.default_rng(1)
    sizes, target = rng.integers(1, 30, 200), np.array([0.7, 0.2, 0.1])
    rows = [[(0, float(n)), (1, float(n // 2)), (2, float(n - n // 2))] for n in sizes]
    totals = np.array([sizes.sum(), (sizes // 2).sum(), (sizes - sizes // 2).sum()])
    goal = target * sizes.sum()
    start = K.hashed_start(np.arange(200), goal)
    cost, at = K.anneal(rows, np.outer(target, totals), np.array([2.0, 1, 1]) / sizes.sum(), start, seed=1, steps=3000)
    held = np.array([sizes[at == s].sum() for s in range(3)])
    before = np.array([sizes[start == s].sum() for s in range(3)])
    assert np.abs(held - goal).sum() <= min(np.abs(before - goal).sum(), 12)


def test_large_components_are_searched_with_their_labels(spark, ws):
    # ten components of a tenth each, of two labels: only three of the splits' sizes can be met, with both labels in train
    images = [(i, f"IMG_{10000 + i}.jpg", None, "ab"[i // 50 % 2], i // 50) for i in range(500)]
    got = plan(spark, ws, images)
    n = {}
    for r in got.assignment.collect():
        n.setdefault(r["split"], {"a": 0, "b": 0})["ab"[r["image_id"] // 50 % 2]] += 1
    assert {s: sum(v.values()) for s, v in n.items()} == {"train": 350, "valid": 100, "test": 50}
    assert min(n["train"].values()) >= 150 and n["valid"] == {"a": 50, "b": 50}


def test_more_labels_than_a_few_are_all_balanced(spark, ws):
    images = [(i, f"IMG_{10000 + i}.jpg", None, f"label {i % 150}", None) for i in range(6000)]
    got = plan(spark, ws, images, shard=1500).assignment.collect()
    held = {}
    for r in got:
        held[r["split"], r["image_id"] % 150] = held.get((r["split"], r["image_id"] % 150), 0) + 1
    assert all(abs(held.get(("train", k), 0) - 28) <= 4 for k in range(150))
    assert abs(sum(v for (s, _), v in held.items() if s == "valid") - 1200) <= 1


def test_empty(spark, ws, rows):
    got = plan(spark, ws, [])
    assert rows(got.assignment) == [] and rows(got.groups) == []
