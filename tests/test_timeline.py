import random

from pyspark.sql import functions as F

from splitwright.operators import timeline as T


def frame(spark, rows_):
    return spark.createDataFrame(rows_, "id long, key string, second long, split string")


def random_frame(spark, seed=0, n=300):
    rng = random.Random(seed)
    rows_ = [(i, rng.choice("ab"), rng.randrange(0, 400_000), rng.choice(["train", "valid", "test", None])) for i in range(n)]
    return rows_, frame(spark, rows_ + [(n, None, 1, "train"), (n + 1, "a", None, "train")])


def brute_sessions(rows_, tau):
    out, last = {}, {}
    for i, k, s, _ in sorted(rows_, key=lambda r: (r[1], r[2], r[0])):
        if k in last and s - last[k][0] <= tau:
            start = last[k][1]
        else:
            start = s
        last[k] = (s, start)
        out[i] = start
    return out


def test_sessions_across_blocks(spark):
    rows_, df = random_frame(spark)
    got = T.session_starts(df, "key", "second", ["id"], [100, 5000], block_s=1000).collect()
    for tau in (100, 5000):
        assert {r["id"]: r["start_s"] for r in got if r["tau"] == tau} == brute_sessions(rows_, tau)


def test_gap_equal_to_tau_joins(spark):
    df = frame(spark, [(1, "a", 0, None), (2, "a", 15, None), (3, "a", 31, None)])
    assert sorted((r["id"], r["start_s"]) for r in T.session_starts(df, "key", "second", ["id"], [15]).collect()) == [(1, 0), (2, 0), (3, 31)]


def test_numbering_follows_key_and_time(spark, ws, rows):
    df = frame(spark, [(1, "b", 0, None), (2, "a", 50, None), (3, "a", 0, None)])
    s = T.session_starts(df, "key", "second", ["id"], [10])
    assert rows(T.numbered_sessions(s, "key", ws).select("key", "start_s", "cluster_id")) == [("a", 0, 0), ("a", 50, 1), ("b", 0, 2)]


def test_leakage_invariants_and_upper_median(spark):
    df = frame(
        spark,
        [(1, "a", 0, "train"), (2, "a", 1, "test"), (3, "a", 100, "train"), (4, "a", 200, "valid"), (5, "a", 201, "train"), (6, "a", 202, "train"), (7, "a", 203, None)],
    )
    r = T.leakage(T.session_starts(df, "key", "second", ["id"], [10]), "key").first()
    assert (r["clusters"], r["pure"], r["crossing"], r["test_with_train"], r["valid_with_train"], r["test_with_valid"]) == (3, 1, 2, 1, 1, 0)
    assert r["median_crossing_size"] == 4


def test_more_gap_never_means_more_clusters(spark):
    _, df = random_frame(spark, 3)
    n = [r["clusters"] for r in T.leakage(T.session_starts(df, "key", "second", ["id"], [1, 10, 100, 1000, 10_000]), "key").orderBy("tau").collect()]
    assert n == sorted(n, reverse=True)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", 7), ("b", 9), ("b", 9), ("c", None)], "k string, v int")
    assert {r["k"]: r["median"] for r in T.upper_median_of_counts(df, ["k"], "v").collect()} == {"a": 3, "b": 9}
    assert df.groupBy("k").agg(T.upper_median(F.collect_list("v")).alias("m")).where("k = 'a'").first()["m"] == 3


def test_histogram_bins(spark):
    df = frame(spark, [(1, "a", 0, None), (2, "a", 0, None), (3, "a", 1, None), (4, "a", 3601, None), (5, "a", 7202, None)])
    got = {r["bin"]: r["n"] for r in T.gap_histogram(df, "key", "second", ["id"], [0, 1, 1800, 3600]).collect()}
    assert got == {0: 1, 1: 1, 1800: 0, 3600: 1, None: 1}


def test_band_pairs_are_all_pairs_once(spark):
    rows_, df = random_frame(spark, 5)
    tau = 2000
    want = {
        (min(a, b, key=lambda r: (r[2], r[0]))[0], max(a, b, key=lambda r: (r[2], r[0]))[0])
        for a in rows_ for b in rows_ if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= tau
    }
    got = [(r["a_id"], r["b_id"]) for r in T.band_pairs(df, "key", "second", "id", tau).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_consecutive_pairs(spark, rows):
    df = frame(spark, [(1, "a", 0, "train"), (2, "a", 0, "test"), (3, "a", 90_000, "train"), (4, "b", 5, None)])
    got = T.consecutive_pairs(df, "key", "second", "id", carry=["split"]).select("a_id", "b_id", "gap_s", "a_split")
    assert rows(got) == [(1, 2, 0, "train"), (2, 3, 90_000, "test")]
    assert rows(T.consecutive_pairs(df, "key", "second", "id", 10).select("a_id")) == [(1,)]


def test_islands(spark, rows):
    df = spark.createDataFrame([("k", i, m) for i, m in enumerate([True, True, False, True, False, False, True])] + [("z", 1, False)], "k string, i int, m boolean")
    assert rows(T.islands(df, ["k"], ["i"], "m")) == [("k", 4, 3, 2)]


def test_islands_across_blocks(spark):
    rng = random.Random(8)
    rows_ = [(rng.choice("ab"), rng.randrange(5000), i, rng.random() < 0.7) for i in range(400)]
    want = {}
    for k in "ab":
        runs, before = [], False
        for *_, m in sorted(r for r in rows_ if r[0] == k):
            if m:
                runs = runs + [1] if not before else [*runs[:-1], runs[-1] + 1]
            before = m
        want[k] = (sum(runs), len(runs), max(runs))
    df = spark.createDataFrame(rows_, "k string, s long, i int, m boolean")
    assert {r["k"]: tuple(r)[1:] for r in T.islands(df, ["k"], ["s", "i"], "m", block_s=100).collect()} == want


def test_successors_last_of_a_number_wins(spark, rows):
    df = spark.createDataFrame([("d", 1, 10), ("d", 2, 20), ("d", 2, 21), ("e", 3, 30), ("d", None, 1)], "k string, n long, id long")
    assert rows(T.successor_pairs(df, "k", "n", ["id"]).select("k", "n", "a_id", "b_id")) == [("d", 1, 10, 21)]


def test_empty(spark, rows):
    df = frame(spark, [])
    assert rows(T.session_starts(df, "key", "second", ["id"], [1])) == []
    assert rows(T.leakage(T.session_starts(df, "key", "second", ["id"], [1]), "key")) == []
    assert rows(T.band_pairs(df, "key", "second", "id", 5)) == []
