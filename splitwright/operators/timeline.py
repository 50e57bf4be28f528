"""Ordered operators on a timeline: gaps, sessions with row-level ids, leakage, adjacency, islands.

Nothing here orders a whole key in one task. Rows are ordered inside (key, block of time) and what a block
must know of earlier ones, its predecessor's last time or the open session's start, comes from a summary with one row
for each block. A key with a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace

#: Seconds of one block of a key's timeline.
BLOCK_S = 86_400


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the higher one of two; null of none."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def upper_median_of_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median): upper median of ``value`` by key, from counted distinct values, so nothing is collected.

    Nulls are left out.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(Window.partitionBy(*keys))
    placed = counted.withColumn("_upto", F.sum("_n").over(along)).withColumn("_all", total)
    return placed.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def with_previous(df: DataFrame, key: str, second: str, order: Sequence[str], carry: Sequence[str] = (), block_s: int = BLOCK_S) -> DataFrame:
    """df with ``prev_s`` (time of the row before on the key's timeline) and prev_<c> for each carried column.

    Rows are ordered by (second, order); rows without a key or a time are dropped.
    """
    timed = df.where(F.col(key).isNotNull() & F.col(second).isNotNull()).withColumn("_block", F.floor(F.col(second) / block_s))
    along = Window.partitionBy(key, "_block").orderBy(second, *order)
    kept = [second, *carry]
    row = F.struct(*[F.col(c) for c in kept])
    inside = timed.withColumn("_p", F.lag(row).over(along))
    last = timed.groupBy(key, "_block").agg(F.max(F.struct(second, *order, row.alias("_row"))).alias("_m"))
    before = last.select(
        F.col(key).alias("_k"), F.col("_block").alias("_b"), F.lag("_m._row").over(Window.partitionBy(key).orderBy("_block")).alias("_before")
    )
    joined = inside.join(before, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b"))).withColumn("_p", F.coalesce("_p", "_before"))
    names = {second: "prev_s"} | {c: f"prev_{c}" for c in carry}
    return joined.select(*df.columns, *[F.col(f"_p.{c}").alias(n) for c, n in names.items()])


def session_starts(df: DataFrame, key: str, second: str, order: Sequence[str], taus: Sequence[float], block_s: int = BLOCK_S) -> DataFrame:
    """df once for each tau, with ``tau`` and ``start_s``, the first time of the row's session.

    A gap of at most tau joins (single linkage); tau and start_s identify a session of the key. All taus share one ordering of the rows: each
    has a running start of its own, and a row is repeated for the taus only when all is known.
    """
    known = with_previous(df, key, second, order, block_s=block_s).withColumn("_block", F.floor(F.col(second) / block_s))
    gap = F.col(second) - F.col("prev_s")
    every = range(len(taus))
    marked = known.withColumns({f"_open{k}": F.when(F.coalesce(gap > taus[k], F.lit(True)), F.col(second)) for k in every})
    # rows of one second are in one session, so the running start needs no tie-break
    along = Window.partitionBy(key, "_block").orderBy(second).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = marked.withColumns({f"_start{k}": F.max(f"_open{k}").over(along) for k in every})
    summary = marked.groupBy(key, "_block").agg(*[F.max(f"_open{k}").alias(f"_last{k}") for k in every])
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), *[F.max(f"_last{k}").over(earlier).alias(f"_carried{k}") for k in every])
    joined = inside.join(carried, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")))
    each = F.explode(F.array(*[F.struct(F.lit(taus[k]).alias("tau"), F.coalesce(f"_start{k}", f"_carried{k}").alias("start_s")) for k in every])).alias("_t")
    return joined.select(*df.columns, each).select(*df.columns, "_t.tau", "_t.start_s")


def numbered_sessions(sessions: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """(tau, key, start_s, cluster_id): sessions of each tau numbered from 0 in (key, time) order.

    Numbered inside each key, then offset by the sessions of the keys before: those of the same range of keys and, with one row a range, of all
    ranges before. So neither all sessions nor all keys are ever ordered in one task.
    """
    one = sessions.select("tau", key, "start_s").distinct()
    within = one.withColumn("_at", F.row_number().over(Window.partitionBy("tau", key).orderBy("start_s")))
    sizes = one.groupBy("tau", key).agg(F.count("*").alias("_n"))
    # a range exchange numbers its partitions in the order of the keys; written, so that the numbers stay what they are
    ranged = ws.keep(sizes.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("tau", "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("tau", "_range").agg(F.sum("_n").alias("_r"))
    earlier = Window.partitionBy("tau").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("tau", "_range", F.coalesce(F.sum("_r").over(earlier), F.lit(0)).alias("_before"))
    offsets = ranged.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(before), ["tau", "_range"])
    joined = within.join(offsets.select("tau", key, (F.col("_inside") + F.col("_before")).alias("_offset")), ["tau", key])
    return joined.select("tau", key, "start_s", (F.col("_offset") + F.col("_at") - 1).alias("cluster_id"))


def leakage(sessions: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(tau, clusters, pure, crossing, test_with_train, valid_with_train, test_with_valid, pct_crossing, median_crossing_size).

    A cluster is crossing if its rows have more than one split; rows of no split count for size only.
    """
    has = {s: F.max((F.col(split) == s).cast("int")) for s in ("train", "valid", "test")}
    per = sessions.groupBy("tau", key, "start_s").agg(F.count("*").alias("size"), *[F.coalesce(c, F.lit(0)).alias(s) for s, c in has.items()])
    per = per.withColumn("crossing", F.col("train") + F.col("valid") + F.col("test") > 1)
    both = {f"{a}_with_{b}": (F.col(a) == 1) & (F.col(b) == 1) for a, b in (("test", "train"), ("valid", "train"), ("test", "valid"))}
    totals = per.groupBy("tau").agg(
        F.count("*").alias("clusters"),
        F.count_if(~F.col("crossing")).alias("pure"),
        F.count_if("crossing").alias("crossing"),
        *[F.count_if(c).alias(n) for n, c in both.items()],
    )
    median = upper_median_of_counts(per.where("crossing"), ["tau"], "size").withColumnRenamed("median", "median_crossing_size")
    share = F.when(F.col("clusters") > 0, F.round(100 * F.col("crossing") / F.col("clusters"), 1)).otherwise(0.0)
    return totals.withColumn("pct_crossing", share).join(median, "tau", "left")


def gap_histogram(df: DataFrame, key: str, second: str, order: Sequence[str], edges: Sequence[int]) -> DataFrame:
    """(bin, n): gaps between neighbours in right-closed bins ending at the edges, and one over the last edge.

    bin is the right edge, null for the overflow; empty bins have n 0. A gap of 0 falls in the first bin.
    """
    gaps = with_previous(df, key, second, order).where("prev_s is not null").select((F.col(second) - F.col("prev_s")).alias("gap"))
    right = F.array_min(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col("gap") <= e))
    counted = gaps.groupBy(right.cast("int").alias("b")).agg(F.count("*").alias("k"))
    bins = df.sparkSession.createDataFrame([(e,) for e in [*edges, None]], "bin int")
    return bins.join(counted, bins["bin"].eqNullSafe(counted["b"]), "left").select("bin", F.coalesce("k", F.lit(0)).alias("n"))


def band_pairs(df: DataFrame, key: str, second: str, ident: str, tau: int, carry: Sequence[str] = ()) -> DataFrame:
    """All pairs of rows of a key at most tau seconds apart, each once: a_<c>, b_<c>, gap_s.

    The range condition is turned into an equi-join on a slot of tau seconds: a row is looked up in its own slot and in
    the next one. Pairs are ordered by (second, ident).
    """
    cols = [second, ident, *carry]
    rows = df.where(F.col(key).isNotNull() & F.col(second).isNotNull()).withColumn("_slot", F.floor(F.col(second) / tau))
    a = rows.select(F.col(key).alias("_ka"), F.explode(F.array("_slot", F.col("_slot") + 1)).alias("_sa"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = rows.select(F.col(key).alias("key"), F.col("_slot").alias("_sb"), *[F.col(c).alias(f"b_{c}") for c in cols])
    gap = F.col(f"b_{second}") - F.col(f"a_{second}")
    ordered = (gap > 0) | ((gap == 0) & (F.col(f"b_{ident}") > F.col(f"a_{ident}")))
    return (
        a.join(b, (F.col("_ka") == F.col("key")) & (F.col("_sa") == F.col("_sb")))
        .where(ordered & (gap <= tau))
        .select("key", *[f"a_{c}" for c in cols], *[f"b_{c}" for c in cols], gap.alias("gap_s"))
    )


def consecutive_pairs(df: DataFrame, key: str, second: str, ident: str, tau: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Neighbours on each key's timeline, at most tau apart where tau is given: as band_pairs."""
    known = with_previous(df, key, second, [ident], carry=[ident, *carry]).where("prev_s is not null")
    gap = F.col(second) - F.col("prev_s")
    out = known.select(
        F.col(key).alias("key"),
        F.col("prev_s").alias(f"a_{second}"),
        *[F.col(f"prev_{c}").alias(f"a_{c}") for c in (ident, *carry)],
        F.col(second).alias(f"b_{second}"),
        *[F.col(c).alias(f"b_{c}") for c in (ident, *carry)],
        gap.alias("gap_s"),
    )
    return out if tau is None else out.where(F.col("gap_s") <= tau)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], member: str, block_s: int = BLOCK_S) -> DataFrame:
    """(keys, members, runs, longest): contiguous runs of member rows among all rows of the key.

    A run ends where a row that is no member comes between. order begins with a time in seconds; rows without it are dropped.
    Keys without members are left out. A run is known by the place of its first row, carried from block to block.
    """
    keys = list(keys)
    second, *ties = order
    known = with_previous(df.withColumn("_key", F.struct(*keys)), "_key", second, ties, carry=[member], block_s=block_s)
    held = known.where(F.col(member)).withColumn("_block", F.floor(F.col(second) / block_s))
    opens = F.when(~F.coalesce(F.col(f"prev_{member}"), F.lit(False)), F.struct(*order))
    along = Window.partitionBy("_key", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = held.withColumn("_open", opens)
    inside = marked.withColumn("_run", F.max("_open").over(along))
    summary = marked.groupBy("_key", "_block").agg(F.max("_open").alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.max("_last").over(earlier).alias("_carried"))
    runs = inside.join(carried, (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b")))
    sizes = runs.groupBy(*keys, F.coalesce("_run", "_carried").alias("_run")).agg(F.count("*").alias("_n"))
    return sizes.groupBy(*keys).agg(F.sum("_n").alias("members"), F.count("*").alias("runs"), F.max("_n").alias("longest"))


def successor_pairs(df: DataFrame, key: str, number: str, carry: Sequence[str]) -> DataFrame:
    """Rows whose number is one more than another's of the same key: key, number, a_<c>, b_<c>.

    Of rows with the same number the one that is last by its carried values counts.
    """
    one = df.where(F.col(number).isNotNull()).groupBy(key, number).agg(F.max(F.struct(*carry)).alias("_r"))
    a = one.select(F.col(key).alias("_k"), (F.col(number) + 1).alias("_next"), F.col("_r").alias("_a"))
    joined = one.join(a, one[key].eqNullSafe(F.col("_k")) & (one[number] == F.col("_next")))
    return joined.select(key, (F.col(number) - 1).alias(number), *[F.col(f"_a.{c}").alias(f"a_{c}") for c in carry], *[F.col(f"_r.{c}").alias(f"b_{c}") for c in carry])

