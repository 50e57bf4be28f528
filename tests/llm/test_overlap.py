import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitwright.llm import overlap as O

IMAGES = "image_id long, filename string, split string, stem string, family string, device_name string, n int, key long"
BOXES = "image string, class_id int, cx double, cy double, w double, h double, n int"
PAIRS = "stem_a string, stem_b string, n_boxes int, raw_max_dist double, aligned_max_dist double, score double, low_info boolean, a string"
CLASSES = [(k, str(k)) for k in range(6)]


def grid_best(ca, xa, ya, cb, xb, yb):
    i, j = np.nonzero(ca[:, None] == cb[None, :])
    dx, dy = xb[j] - xa[i], yb[j] - ya[i]
    best = 0
    for px in np.linspace(-0.06, 0.06, 41):
        for py in np.linspace(-0.06, 0.06, 41):
            on = np.hypot(dx - px, dy - py) <= 0.02
            if on.sum() > best:
                best = max(best, O._most_matched(list(zip(i[on].tolist(), j[on].tolist()))))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_best_match_is_at_least_what_a_fine_grid_finds(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(6, 13)
    c, x, y = rng.integers(0, 3, n), rng.random(n) * 0.3, rng.random(n) * 0.3
    s = rng.uniform(-0.06, 0.06, 2)
    keep = n - rng.integers(0, 2)
    args = c, x, y, c[:keep], x[:keep] + s[0] + rng.uniform(-0.014, 0.014, keep), y[:keep] + s[1] + rng.uniform(-0.014, 0.014, keep)
    got = O.best_match(*args, 1)
    assert got >= max(grid_best(*args), keep)


def test_best_match_limits():
    c, x = np.zeros(6, int), np.linspace(0.1, 0.9, 6)
    assert O.best_match(c, x, x, c, x + 0.06 + 0.02, x, 6) == 6  # shift and centre distance at their limits
    assert O.best_match(c, x, x, c, x + 0.0801, x, 6) == 0
    assert O.best_match(c, x, x, c + 1, x, x, 1) == 0


def test_corner_of_overlapping_discs():
    # the only common shift lies on the crossing of two circles, away from every disc's centre
    c = np.array([0, 1])
    assert O.best_match(c, np.array([0.2, 0.6]), np.array([0.5, 0.5]), c, np.array([0.2 - 0.02, 0.6 + 0.02]), np.array([0.5, 0.5]), 2) == 2


@pytest.mark.parametrize("total, most", [(12, 0), (14, 0), (15, 1), (16, 0), (28, 0), (29, 1), (30, 2), (43, 3), (44, 2), (57, 3), (58, 4)])
def test_unpaired_limit(spark, total, most):
    assert spark.range(1).select(O.unpaired_limit(F.lit(total))).first()[0] == most


def world(spark, seed=0, scenes=60):
    """Scenes photographed again with shift, jitter, a box more or less, or a class changed."""
    rng = random.Random(seed)
    images, boxes, k = [], [], 0
    for _ in range(scenes):
        n = rng.choice([6, 7, 8, 14, 15, 16, 21, 22, 23, 30])
        held = [(rng.choice([0, 0, 1, 2, 3, 4]), rng.uniform(0.1, 0.9), rng.uniform(0.1, 0.9)) for _ in range(n)]
        for shot in range(rng.choice([1, 2, 3])):
            k += 1
            s = rng.uniform(-0.06, 0.06), rng.uniform(-0.06, 0.06)
            jit = lambda: rng.uniform(-0.013, 0.013)
            now = [(c, round(x + s[0] * (shot > 0) + jit() * (shot > 0), 5), round(y + s[1] * (shot > 0) + jit() * (shot > 0), 5)) for c, x, y in held]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if rng.random() < 0.4:
                    now.append((rng.randrange(5), rng.uniform(0.1, 0.9), rng.uniform(0.1, 0.9)))
                elif rng.random() < 0.5:
                    now.pop(rng.randrange(len(now)))
                else:
                    i = rng.randrange(len(now))
                    now[i] = ((now[i][0] + 1) % 5, *now[i][1:])
            images.append((k, f"f{k}.jpg", rng.choice(["train", "valid", "TEST", None]), None, "unparsed", None, 0, 0))
            boxes += [(f"f{k}.jpg", c, x, y, 0.1, 0.1, 0) for c, x, y in now]
    boxes += boxes[:40] + [("f1.jpg", 99, 0.5, 0.5, 0.1, 0.1, 0), ("f1.jpg", 1, float("nan"), 0.5, 0.1, 0.1, 0), ("f1.jpg", 1, None, 0.5, 0.1, 0.1, 0), (None, 1, 0.5, 0.5, 0.1, 0.1, 0), ("gone", 1, 0.5, 0.5, 0.1, 0.1, 0)]
    return images, boxes


@pytest.mark.parametrize("seed", [0, 1])
def test_all_pairs_are_found(spark, ws, seed):
    images, boxes = world(spark, seed)
    idf, bdf = spark.createDataFrame(images, IMAGES), spark.createDataFrame(boxes, BOXES)
    cdf = spark.createDataFrame(CLASSES, "class_id int, class_name string")
    records = ws.keep(O.box_records(O.image_sides(idf), bdf, cdf))
    got = {(r["image_t"], r["image_e"]) for r in O.scene_overlaps(records).collect()}
    held = {}
    for f, c, x, y, *_ in {b for b in boxes if b[0] and b[1] < 6 and b[2] == b[2] and b[2] is not None and 0 < b[2] <= 1 and 0 < b[3] <= 1}:
        held.setdefault(f, []).append((c, x, y))
    arrays = {f: [np.array(v) for v in zip(*b)] for f, b in held.items() if len(b) >= 6}
    side = {f"f{i[0]}.jpg": (i[0], (i[2] or "").lower()) for i in images}
    want = set()
    for a in arrays:
        for b in arrays:
            if a in side and b in side and side[a][1] == "train" and side[b][1] in ("valid", "test"):
                m = O.best_match(*arrays[a], *arrays[b], 1)
                if 1 - 2 * m / (len(arrays[a][0]) + len(arrays[b][0])) <= 0.07:
                    want.add((side[a][0], side[b][0]))
    assert got == want and len(want) > 3


def test_copies_of_one_scene_are_all_reported(spark, ws):
    held = [(k % 3, 0.1 * k + 0.05, 0.5) for k in range(7)]
    images = [(k, f"f{k}.jpg", "train" if k % 3 else "test", None, None, None, 0, 0) for k in range(30)]
    boxes = [(f"f{k}.jpg", c, x, y, 0.1, 0.1, 0) for k in range(30) for c, x, y in held]
    records = ws.keep(O.box_records(O.image_sides(spark.createDataFrame(images, IMAGES)), spark.createDataFrame(boxes, BOXES), spark.createDataFrame(CLASSES, "class_id int, class_name string")))
    assert O.scene_overlaps(records).count() == 20 * 10


def found(spark, ws, images, pairs, rows, boxes=()):
    tables = spark.createDataFrame(images, IMAGES), spark.createDataFrame(list(boxes), BOXES), spark.createDataFrame(CLASSES, "class_id int, class_name string"), spark.createDataFrame(pairs, PAIRS)
    return tables, O.cross_split_overlaps(*tables, ws)


def test_stems_and_lists(spark, ws, rows):
    images = [
        (1, "A.jpg", "train", None, "counter", "D 1", 0, 0), (2, "a.png", "val", None, "counter", None, 0, 0), (2, "a.png", "val", None, "counter", None, 0, 0),
        (3, "B.jpg", "test", None, None, "D 1", 0, 0), (4, "C.jpg", None, None, None, None, 0, 0), (5, "B.png", "test", None, None, None, 0, 0), (None, "A.jpg", "test", None, None, None, 0, 0), (6, None, "test", None, None, None, 0, 0),
    ]
    pairs = [("b", "A", 9, None, None, 0.001, None, ""), ("A", "B", 9, None, None, 0.0005, None, ""), ("A", "C", 9, None, None, 0.0, None, ""), ("A", "B", 2, None, None, 0.0, None, ""), (None, "A", 9, None, None, 0.0, None, "")]
    tables, got = found(spark, ws, images, pairs, rows)
    assert rows(got) == [(1, 2, "stem", 0.0), (1, 3, "listed", 0.0005), (1, 5, "listed", 0.0005)]
    assert rows(O.overlap_report(got, tables[0])) == sorted([("valid", "FAMILY:counter", "stem", 1, 1, 0.0), ("test", "D1", "listed", 1, 1, 0.0005), ("test", None, "listed", 1, 1, 0.0005)], key=repr)


def test_empty_tables(spark, ws, rows):
    assert rows(found(spark, ws, [], [], rows)[1]) == []


@pytest.mark.parametrize("n, spread", [(60, 0.1), (300, 0.1), (100, 0.3)])
@pytest.mark.parametrize("kind", ["again", "other"])
def test_crowds_are_matched_in_little_memory(n, spread, kind):
    import tracemalloc

    rng = np.random.default_rng(n)
    x, y, c = rng.random(n) * spread, rng.random(n) * spread, np.zeros(n, int)
    if kind == "again":
        xb, yb = x + 0.04 + rng.uniform(-0.012, 0.012, n), y - 0.03 + rng.uniform(-0.012, 0.012, n)
    else:
        xb, yb = rng.random(n) * spread, rng.random(n) * spread
    need = n - int(0.07 * n)
    tracemalloc.start()
    got = O.best_match(c, x, y, c, xb, yb, need)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert got == n if kind == "again" else got == 0 or got >= need


@pytest.mark.parametrize("seed", range(12))
def test_dividing_the_shifts_finds_what_trying_all_corners_finds(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n = 14
    c, x, y = rng.integers(0, 2, n), rng.random(n) * 0.12, rng.random(n) * 0.12
    xb, yb = x + 0.02 + rng.uniform(-0.03, 0.03, n), y + rng.uniform(-0.03, 0.03, n)
    monkeypatch.setattr(O, "MOST_CIRCLES", 10_000)
    whole = O.best_match(c, x, y, c, xb, yb, 1)
    monkeypatch.setattr(O, "MOST_CIRCLES", 6)
    assert O.best_match(c, x, y, c, xb, yb, 1) == whole >= grid_best(c, x, y, c, xb, yb)


def test_a_lattice_of_equal_steps():
    x, y = (v.ravel() * 0.02 + 0.1 for v in np.meshgrid(np.arange(12), np.arange(12)))
    c = np.zeros(144, int)
    assert O.best_match(c, x, y, c, x + 0.05, y - 0.05, 140) == 144


def test_a_cut_is_where_the_content_says(spark):
    rng = random.Random(3)
    many = sorted(rng.getrandbits(62) for _ in range(400))
    df = spark.createDataFrame([(0, many), (1, many[:200] + many[201:]), (2, many[:2]), (3, many[:1])], "k int, t array<long>")
    got = {r["k"]: r["c"] for r in df.select("k", O.content_chunks(F.col("t")).alias("c")).collect()}
    assert [sum(c["length"] for c in got[k]) for k in range(4)] == [400, 399, 2, 1]
    assert len(got[0]) > 60 and len(set(got[0]) - set(got[1])) <= O.WINDOW + 1


def test_an_index_of_linear_size(spark):
    n = [8, 30, 100, 300, 1000]
    df = spark.createDataFrame([(k, "t", k, list(range(k))) for k in n], "image_id long, split string, n int, occ array<long>")
    keys = {r["image_id"]: r["count"] for r in O.index_keys(O.cut_records(df)).groupBy("image_id").count().collect()}
    assert all(keys.get(k, 0) <= k + 40 for k in n)


@pytest.mark.parametrize("n, taken", [(20, 1), (60, 4), (200, 13), (200, 14)])
def test_the_index_misses_no_record_that_lost_boxes(spark, n, taken):
    rng = random.Random(n)
    occ = [k // 7 * 1048576 + k % 7 for k in range(n)]
    less = [x for k, x in enumerate(occ) if k not in rng.sample(range(n), taken)] if taken == 1 else sorted(rng.sample(occ, n - taken))
    df = spark.createDataFrame([(1, "t", n, occ), (2, "e", len(less), less)], "image_id long, split string, n int, occ array<long>")
    assert O.index_candidates(O.cut_records(df)).distinct().count() == 1


def test_links_of_classes_count_all_pairs(spark, ws):
    images, boxes = world(spark, 2)
    images += [(500 + k, f"f{k}.jpg", "train" if k % 2 else "test", None, None, None, 0, 0) for k in range(1, 20)]
    tables = spark.createDataFrame(images, IMAGES), spark.createDataFrame(boxes, BOXES), spark.createDataFrame(CLASSES, "class_id int, class_name string")
    records = ws.keep(O.box_records(O.image_sides(tables[0]), *tables[1:]))
    pairs = O.scene_overlaps(records).select("image_t", "image_e").collect()
    links = O.class_links(records, ws).collect()
    assert sum(r["n_links"] for r in links if r["side"] == "train") == len(pairs) == sum(r["n_links"] for r in links if r["side"] == "evaluation")
    assert len(links) == records.count()
