import random

import numpy as np
import pytest

from splitwright.llm import components as G

PAIRS = "pair_id long, stem_a string, stem_b string, n_boxes int, raw_max_dist double, aligned_max_dist double, score double, low_info boolean, level int, root long"
LISTED = "epsilon double, component_id long, component_size int, stem string, name string"


def find_all(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", range(5))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    u, v = rng.integers(-50, 50, 60), rng.integers(-50, 50, 60)
    ids, roots = G.forest(u, v)
    assert dict(zip(ids.tolist(), roots.tolist())) == find_all(list(zip(u.tolist(), v.tolist())))


SHAPES = {
    "chain": [(i, i + 1) for i in range(400)],
    "shuffled chain": [(hash((i, 7)) % 10**9, hash((i + 1, 7)) % 10**9) for i in range(300)],
    "hub of a third of all edges": [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(0, 400, 2)],
    "loops, repeats, both directions": [(1, 1), (2, 3), (3, 2), (2, 3), (4, 4)],
    "random": [(random.Random(i).randrange(300), random.Random(-i).randrange(300)) for i in range(1, 250)],
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("cell", [20, 100_000])
def test_grid(spark, ws, name, cell):
    edges = SHAPES[name]
    df = spark.createDataFrame([*edges, (None, 5), (5, None)], "u long, v long")
    got = {r["v"]: r["root"] for r in G.grid_components(df, ws, cell).collect()}
    assert got == find_all(edges)


def test_folding_keeps_the_forest(monkeypatch, spark, ws):
    monkeypatch.setattr(G, "FOLD_AT", 10)
    import pyarrow as pa

    edges = SHAPES["chain"]
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges[k : k + 7]]), pa.array([b for _, b in edges[k : k + 7]])], names=["u", "v"]) for k in range(0, 400, 7)]
    out = [(v, r) for b in G._cells(iter(batches)) for v, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert dict(out) == {i: 0 for i in range(401)}


def test_no_edges(spark, ws):
    assert G.grid_components(spark.createDataFrame([], "u long, v long"), ws).count() == 0


def scene(spark, pairs, listed):
    df = spark.createDataFrame([(i, *p, 0, 0) for i, p in enumerate(pairs)], PAIRS)
    return df, spark.createDataFrame([(*x, "clash") for x in listed], LISTED)


def test_scene_rules(spark, ws, rows):
    nan = float("nan")
    pairs = [
        ("a.jpg", " x/B", 9, None, None, 0.01, None),  # exactly at epsilon
        ("b", "c", 9, 0.5, 0.015, None, None),  # the smaller distance
        ("c", "d", 9, 0.03, nan, nan, False),
        ("e", "f", 9, 0.0, 0.0, 0.0, True),  # low-info by flag
        ("e", "f", 2, 0.0, 0.0, 0.0, None),  # and by boxes
        ("g", "g", 9, 0.0, 0.0, 0.0, None),  # itself
        ("h", None, 9, 0.0, 0.0, 0.0, None),
        ("k", "l", 9, None, None, None, None),  # no score
    ]
    listed = [(0.02, 1, 9, "M"), (0.02, 1, 9, "n.png"), (0.05, 1, 9, "Z"), (0.05, 2, 9, "n"), (0.05, 2, 9, "d"), (None, 3, 1, "q"), (0.01, None, 1, "q"), (0.01, 4, 1, None), (0.9, 5, 1, "r"), (0.9, 5, 1, "s")]
    got = rows(G.scene_components(*scene(spark, pairs, listed), ws, edges_per_cell=3).select("epsilon", "component_id", "stem"))
    want = [("0.01", "A", x) for x in "AB"] + [("0.02", "A", x) for x in "ABC"] + [("0.02", "M", x) for x in "MN"] + [("0.05", "A", x) for x in "ABCDMN"]
    assert got == sorted(want, key=repr)


def test_component_id_is_first_in_code_point_order(spark, ws, rows):
    pairs = [("é", "Z", 9, None, None, 0.0, None), ("Z", "_", 9, None, None, 0.0, None)]
    assert {r[1] for r in rows(G.scene_components(*scene(spark, pairs, []), ws))} == {"Z"}


def test_empty_tables(spark, ws, rows):
    assert rows(G.scene_components(*scene(spark, [], []), ws)) == []
