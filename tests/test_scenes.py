import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from splitwright.operators import graph as G
from splitwright.operators import scenes as S
from splitwright.plans import scenes as P
from splitwright.plans.allocation import _cross_pairs
from tests.oracle import DATA


def test_greedy_takes_the_nearest_first():
    i, j, d = S.greedy(np.array([1, 1]), np.array([0.0, 1.0]), np.zeros(2), np.array([1, 1]), np.array([0.9, 0.4]), np.zeros(2))
    assert [round(x, 9) for x in d] == [0.1, 0.4] and list(zip(i, j)) == [(1, 0), (0, 1)]


def test_nothing_to_match():
    none = np.zeros(0)
    one = np.ones(1)
    assert S.compare_boxes(none, none, none, none, none, none, none, none, none, none) == (1.0, 1.0, 1.0, 0.0)
    assert S.compare_boxes(one, one, one, one, one, 2 * one, one, one, one, one) == (1.0, 1.0, 1.0, 0.0)


def test_aligned_score_ignores_a_common_shift():
    c, x, y, w = np.array([1, 2]), np.array([0.2, 0.6]), np.array([0.2, 0.6]), np.full(2, 0.1)
    raw, mean, aligned, overlap = S.compare_boxes(c, x, y, w, w, c, x + 0.03, y + 0.04, w, w)
    assert round(raw, 9) == round(mean, 9) == 0.05 and aligned < 1e-12 and 0 < overlap < 1


def boxes(spark, images):
    rows = [(i, f"i{i}", c, x, y, 0.1, 0.1) for i, held in images.items() for c, x, y in held]
    return spark.createDataFrame(rows, "image_id long, image string, class_id int, cx double, cy double, w double, h double")


def signed(spark, images):
    df = boxes(spark, images)
    return S.signatures(df).join(df.select("image", "image_id").distinct(), "image").drop("image")


def test_signature_and_buckets(spark, rows):
    s = signed(spark, {1: [(2, 0.1, 0.1), (1, 0.2, 0.2), (2, 0.3, 0.3)], 2: [(1, 0.2, 0.2), (2, 0.1, 0.1), (2, 0.3, 0.3)], 3: [(1, 0.5, 0.5)]})
    assert rows(S.buckets(s)) == [("1:1", 1, 0, False), ("1:1,2:2", 2, 1, False)]


def test_pairs_within_a_bucket_only_and_threshold_on_unrounded(spark, rows):
    s = signed(spark, {1: [(1, 0.1, 0.1), (2, 0.5, 0.5), (3, 0.5, 0.1)], 2: [(1, 0.150004, 0.1), (2, 0.5, 0.5), (3, 0.5, 0.1)], 3: [(1, 0.1, 0.1)]})
    got = S.scored_pairs(s, 0.05).select("a_image_id", "b_image_id", "low_info")
    assert rows(got) == [(1, 2, False)]  # the aligned distance is under the threshold
    raw = S.scored_pairs(s, 1.0).first()["raw_max_dist"]
    assert raw == 0.05


def test_bucket_limit_skips_and_never_truncates(spark):
    s = signed(spark, {i: [(1, 0.1, 0.1)] for i in range(5)})
    assert S.blocked_pairs(s, "image_id", [], limit=4).count() == 0
    assert S.blocked_pairs(s, "image_id", [], limit=5).count() == 10
    assert S.blocked_pairs(s, "image_id", [], limit=None).count() == 10


def test_large_buckets_are_paired_as_small_ones(spark, rows, ws):
    rng = random.Random(7)
    near = lambda v: min(max(v + rng.uniform(-0.04, 0.04), 0.01), 1.0)
    images: dict[int, list] = {}
    for classes in ([1], [1, 1], [1, 2, 2]):
        at = [[(c, rng.random() * 0.9 + 0.05, rng.random() * 0.9 + 0.05) for c in classes] for _ in range(6)]
        for k in range(40):
            dx, dy = rng.choice([(0, 0), (0.2, 0.1)])
            held = [(c, near(x + dx), near(y + dy)) for c, x, y in at[k % 6]]
            # every fourth image is an exact copy of an earlier one with the same classes
            copy = rng.choice([h for h in images.values() if [c for c, *_ in h] == classes]) if k % 4 == 3 else held
            images[len(images) + 1] = copy
    s = signed(spark, images)
    whole = rows(S.scored_pairs(s, 0.05, limit=None))
    assert 0 < len(whole) < 3 * 780 and any(r[3] > 0.05 for r in whole) and any(r[3] == 0 for r in whole)
    assert rows(S.scored_pairs(s, 0.05, limit=10)) == rows(S.scored_pairs(s, 0.05, limit=10, ws=ws)) == rows(S.scored_pairs(s, 0.05, ws=ws)) == whole
    mine = []
    for a, b in itertools.combinations(sorted(images), 2):
        if [c for c, *_ in images[a]] == [c for c, *_ in images[b]]:
            x, y = ([np.array(v) for v in zip(*sorted(images[i]))] for i in (a, b))
            w = np.full(len(x[0]), 0.1)
            raw, _, aligned, _ = S.compare_boxes(*x, w, w, *y, w, w)
            if min(raw, aligned) <= 0.05:
                mine.append((a, b))
    assert sorted(r[:2] for r in whole) == mine


def test_contamination_grid_is_monotone(spark):
    rng = random.Random(1)
    pick = lambda: rng.choice(["train", "valid", "test", None])
    rows_ = [(rng.random() / 10, rng.random() / 10, rng.random() < 0.3, pick(), pick()) for _ in range(300)]
    df = spark.createDataFrame(rows_, "raw double, aligned double, low boolean, a_s string, b_s string")
    got = {(r["scoring"], r["epsilon"], r["excl_low"]): r for r in S.contamination(df, [0.02, 0.05], ["s"]).collect()}
    for scoring, eps, excl in itertools.product(["raw", "aligned"], [0.02, 0.05], [False, True]):
        k = 0 if scoring == "raw" else 1
        hit = [r for r in rows_ if r[k] <= eps and not (excl and r[2])]
        assert got[scoring, eps, excl]["pairs"] == len(hit)
        assert got[scoring, eps, excl]["test_train"] == sum({r[3], r[4]} == {"test", "train"} for r in hit)


def test_components_against_brute_force(spark, ws):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 3), (5, 5)] + [(200 + i, 201 + i) for i in range(40)]
    vertices = list(range(80)) + list(range(200, 241))
    parent = {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = G.connected_components(spark.createDataFrame([(v,) for v in vertices], "id long"), spark.createDataFrame(edges, "a long, b long"), ws)
    assert {r["id"]: r["component"] for r in df.collect()} == {v: find(v) for v in vertices}
    r = G.redundancy(df).first()
    assert r["components"] + r["redundant"] == r["n"] == len(vertices)


def test_singletons_survive_and_empty_graphs(spark, ws, rows):
    v = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "a")], "a string, b string")
    assert rows(G.connected_components(v, e, ws)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert rows(G.redundancy(G.connected_components(v, e, ws))) == [(4, 2, 1, 3, 2)]
    assert rows(G.connected_components(v.limit(0), e.limit(0), ws)) == []
    assert rows(G.redundancy(G.connected_components(v.limit(0), e.limit(0), ws))) == [(0, 0, 0, 0, 0)]


def test_twins(spark, rows):
    df = spark.createDataFrame([("x", "y", "test", "train", 0.01), ("x", "z", "test", "train", 0.04), ("v", "y", "valid", "train", 0.04), ("x", "v", "test", "valid", 0.0)], "a string, b string, sa string, sb string, d double")
    assert rows(S.twin_counts(df, [0.02, 0.05])) == [(0.02, 1, 0), (0.05, 1, 1)]


def leaky(spark, folder):
    """A is in test and train, B in train, C in test, D in valid and test; A-B, A-C, C-D are listed."""
    images = [(k, f"{n}_jpg.rf.{k:032x}.jpg", s) for k, (n, s) in enumerate([("A", "test"), ("A", "train"), ("B", "train"), ("C", "test"), ("D", "valid"), ("D", "test")])]
    schema = spark.read.parquet(f"{DATA}/images.parquet").schema
    known = [dict(zip(("image_id", "filename", "split"), r)) for r in images]
    spark.createDataFrame([tuple(k.get(f.name) for f in schema) for k in known], StructType([StructField(f.name, f.dataType) for f in schema])).write.parquet(f"{folder}/images.parquet")
    pairs = [dict(stem_a=a, stem_b=b, raw_max_dist=0.01, aligned_max_dist=0.01, low_info=False, n_boxes=5) for a, b in ("AB", "AC", "CD")]
    schema = spark.read.parquet(f"{DATA}/scene_pairs.parquet").schema
    spark.createDataFrame([tuple(p.get(f.name) for f in schema) for p in pairs], StructType([StructField(f.name, f.dataType) for f in schema])).write.parquet(f"{folder}/scene_pairs.parquet")
    spark.read.parquet(f"{DATA}/groups_moved.parquet").limit(0).write.parquet(f"{folder}/groups_moved.parquet")
    return str(folder)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_every_split_of_a_stem_counts(spark, rows, tmp_path):
    d = leaky(spark, tmp_path)
    assert rows(P.evaluation_twins_every_split(spark, d).where("epsilon = 0.05")) == [(0.05, 2, 0)]  # A in test by B, C in test by A in train
    listed = P.contamination_every_split(spark, d).where("state = 'listed' and scoring = 'raw' and epsilon = 0.05 and not excl_low")
    assert rows(listed.select("pairs", "cross", "test_train", "valid_train", "test_valid")) == [(3, 3, 2, 0, 1)]
    relations = {(r["a"], r["b"], r["relation"]) for r in P.closest_pairs_every_split(spark, d).collect()}
    assert relations == {("A", "B", "test<->train"), ("A", "C", "test<->train"), ("C", "D", "test<->valid")}


def test_cross_pairs_over_all_splits_of_a_stem(spark):
    images = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C"), (5, "D")], "image_id long, stem string")
    after = spark.createDataFrame([(1, "test", "test"), (2, "train", "train"), (3, "test", "test"), (4, "test", "test"), (5, None, None)], "image_id long, before string, after string")
    pairs = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "D")], "a string, b string")
    assert _cross_pairs(pairs, after, images) == 1  # A-B: by its export in train
