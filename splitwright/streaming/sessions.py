"""Sessions of a stream of events: the streaming form of gap sessionization, beyond what batch audits need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_sessions(events: DataFrame, key: str, ts: str, gap_s: int, late_s: int) -> DataFrame:
    """(key, start, end, n) of each session that the watermark has closed.

    A silence of exactly ``gap_s`` doesn't cut, as in batch. Events more than ``late_s`` behind the latest one
    may be dropped, so a result can differ from a batch run over the same events; rows without a key or a time are left out.
    """
    given = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, f"{late_s} seconds")
    # a window that ends gap + 1 microsecond after an event still takes in the next one at exactly the gap
    window = F.session_window(ts, f"{gap_s} seconds 1 microsecond")
    grouped = given.groupBy(window.alias("w"), key).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    return grouped.select(key, "start", "end", "n")
