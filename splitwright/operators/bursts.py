"""Grouping activity into sessions by occupancy bitmaps.

Time is a line of bits, one a second, kept as 64-bit words for each entity (only words with a bit set
exist, as in a compressed bitmap). A morphological closing sized to the gap fills every silence that doesn't cut: inside a word
by doubling shifts, and from word to word by a carry, the part of the neighbouring word's fill that reaches over, whether one word on or
many. An occupied second that no fill from below reaches begins a run. A run's words name their last beginning, so its pieces meet in one
aggregation, which trims the run to its first and last occupied second and sums the counts.

Words are built by an aggregation with map-side combine. What a word must know of others comes from its block of 2^16 seconds and, at the
block's edges, from one row for each block. So an entity that holds a third of all events is worked on block by block and never by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

WORD_BITS = 6
BLOCK_BITS = 16


def _dilate(bits: Column, reach: int) -> Column:
    """Every one also sets the ``reach`` bits above it: shifts of 1, 2, 4, ... and a rest."""
    done = 0
    while done < reach:
        step = min(done + 1, reach - done)
        bits = bits.bitwiseOR(F.shiftleft(bits, step))
        done += step
    return bits


def run_begins(bits: Column, base: Column, before: Column, gap: int) -> Column:
    """The word's ones that begin a run: none of the ``gap`` seconds below them is occupied, in this word or in an earlier one.

    base: second of the word's lowest bit; before: last occupied second of the words before, null if there is none. The fill of this word's
    ones is dilated by doubling shifts; that of earlier words reaches ``gap`` seconds over their last one, which fills the word's lower bits.
    """
    filled = _dilate(F.shiftleft(bits, 1), min(gap, 64) - 1)
    reach = before + gap - base  # the highest bit the carry fills
    full, none = F.lit(-1).cast("long"), F.lit(0).cast("long")
    low = F.call_function("shiftrightunsigned", full, (63 - F.least(F.greatest(reach, F.lit(0)), F.lit(63))).cast("int"))
    carry = F.when(reach >= 0, low).otherwise(none)
    return bits.bitwiseAND(F.bitwise_not(filled.bitwiseOR(carry)))


def sessions(events: DataFrame, entity: str, second: str, gap: int) -> DataFrame:
    """(entity, start_s, end_s, duration_s, n): the runs of events with at most ``gap`` seconds between neighbours.

    second: whole seconds since 1970 (long); a silence of exactly ``gap`` doesn't cut, for gap of at least 1. Events
    without an entity or a time are left out; events at the same second are counted each; no events, no rows.
    """
    if gap < 1:
        raise ValueError("gap must be at least one second")
    at = F.col(second).cast("long")
    seconds = (
        events.where(F.col(entity).isNotNull() & at.isNotNull())
        .groupBy(F.col(entity).alias("_entity"), at.alias("_t"))
        .agg(F.count("*").alias("n"))
    )
    pos = F.col("_t").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    words = seconds.groupBy("_entity", F.shiftright("_t", WORD_BITS).alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), pos)).alias("bits"),
        # at most 64 seconds in a word
        F.sort_array(F.collect_list(F.struct(pos.alias("pos"), F.col("n").alias("n")))).alias("secs"),
    )
    base = F.shiftleft("_word", WORD_BITS)
    placed = words.select(
        "_entity", "_word", F.shiftright("_word", BLOCK_BITS - WORD_BITS).alias("_block"), "bits", "secs", (base + F.element_at("secs", -1)["pos"]).alias("_last")
    )
    known = _from_before(placed, "_last", "_before")
    begun = known.withColumn("_begins", run_begins(F.col("bits"), base, F.col("_before"), gap)).withColumn(
        "_at", F.transform(F.filter("secs", lambda x: F.getbit("_begins", x["pos"]) == 1), lambda x: x["pos"])
    )
    begun = begun.withColumn("_latest", F.when(F.size("_at") > 0, base + F.array_max("_at"))).drop("bits", "_last", "_before", "_begins")
    # seconds before the word's first beginning go on with the run that began last
    carried = _from_before(begun, "_latest", "_open")
    first = F.element_at("secs", 1)["pos"]
    open_first = F.when(F.get("_at", F.lit(0)) == first, F.col("_at")).otherwise(F.concat(F.array(F.lit(-1)), F.col("_at")))
    parts = carried.withColumn("_from", open_first).select(
        "_entity", "_word", "secs", "_open", F.explode(F.transform("_from", lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get("_from", i + 1), F.lit(64)).alias("b")))).alias("part")
    )
    inside = F.filter("secs", lambda x: (x["pos"] >= F.col("part.a")) & (x["pos"] < F.col("part.b")))
    runs = parts.select(
        "_entity",
        F.when(F.col("part.a") >= 0, base + F.col("part.a")).otherwise(F.col("_open")).alias("start_s"),
        (base + F.array_max(F.transform(inside, lambda x: x["pos"]))).alias("end_s"),
        F.aggregate(inside, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"),
    )
    whole = runs.groupBy("_entity", "start_s").agg(F.max("end_s").alias("end_s"), F.sum("n").alias("n"))
    return whole.select(F.col("_entity").alias(entity), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "n")


def _from_before(words: DataFrame, value: str, name: str) -> DataFrame:
    """words with ``name``: the greatest value of the entity's earlier words, null if none has one. Values grow from word to word."""
    along = Window.partitionBy("_entity", "_block").orderBy("_word").rowsBetween(Window.unboundedPreceding, -1)
    blocks = words.groupBy("_entity", "_block").agg(F.max(value).alias("_m"))
    earlier = Window.partitionBy("_entity").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carried = blocks.select(F.col("_entity").alias("_e"), F.col("_block").alias("_b"), F.max("_m").over(earlier).alias("_carried"))
    inside = words.withColumn("_inside", F.max(value).over(along))
    joined = inside.join(carried, (F.col("_entity") == F.col("_e")) & (F.col("_block") == F.col("_b")))
    return joined.select(*words.columns, F.coalesce("_inside", "_carried").alias(name))


def captures(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """(stem, device_key, second) of every capture: a distinct stem of images or of a pair's first side with a device.

    The device is that of any of the stem's rows, for an image without one FAMILY: and its family. The time is that of any of
    its rows: ts, else epoch, else the name's own date and time, else for clock names the capture group as
    the date. Of several values the least counts; a stem without a time has a null second.
    """
    group = F.regexp_extract(N.strip("capture_group"), r"\A\d{8}\z", 0)
    listed = images.select(
        N.stem(F.coalesce("filename", "stem")).alias("stem"),
        N.device_key("device_name").alias("device"),
        F.concat(F.lit("FAMILY:"), F.col("family")).alias("fallback"),
        N.seconds_of("ts").alias("ts_s"),
        F.when(~F.isnan("epoch"), F.floor("epoch")).alias("epoch_s"),
        F.when(N.digits_seconds(F.concat(group, F.lit("000000"))).isNotNull(), group).alias("day"),
    )
    paired = pairs.select(
        N.stem("stem_a").alias("stem"),
        N.device_key("device_a").alias("device"),
        F.lit(None).cast("string").alias("fallback"),
        F.lit(None).cast("long").alias("ts_s"),
        F.lit(None).cast("long").alias("epoch_s"),
        F.lit(None).cast("string").alias("day"),
    ).where("device is not null")
    one = (
        listed.unionByName(paired)
        .where("stem is not null")
        .groupBy("stem")
        .agg(*[F.min(c).alias(c) for c in ("device", "fallback", "ts_s", "epoch_s", "day")])
    )
    named = F.coalesce(N.name_digits("stem"), F.concat(F.col("day"), N.clock_digits("stem")))
    return one.select(
        "stem",
        F.coalesce("device", "fallback").alias("device_key"),
        F.coalesce("ts_s", "epoch_s", N.digits_seconds(named)).alias("second"),
    )


def capture_bursts(images: DataFrame, pairs: DataFrame, gap: int = 15) -> DataFrame:
    """(device_key, start_s, end_s, duration_s, n_captures): the bursts of every device."""
    return sessions(captures(images, pairs), "device_key", "second", gap).withColumnRenamed("n", "n_captures")
