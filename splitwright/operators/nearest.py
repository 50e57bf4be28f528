"""Closest vectors of a stated query set against all vectors, in blocks."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors and rows of the table that meet in one task.
BLOCK = 2_000
PART = 40_000
#: Rows of the table compared with a block at a time.
SLICE = 2_000


def nearest(df: DataFrame, ident: str, vector: str, every: int, k: int) -> DataFrame:
    """(ident, rank, near_id, cosine): the k closest rows of each row whose id is divisible by ``every``, itself aside.

    Queries are dealt by hash into blocks and all rows into parts; every block meets every part in a task of bounded size, which
    keeps the k best of each query, so what is shuffled after that is k rows for each query and part. No vector passes through the driver.
    Vectors that are null or of length zero are left out; ties go to the lower id.
    """
    given = df.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    queries = given.where(F.col("id") % every == 0)
    n, asked = given.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    blocks, parts = max(1, -(-asked // BLOCK)), max(1, -(-n // PART))

    def dealt(rows: DataFrame, own: str, count: int, other: str, copies: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(count))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    left = dealt(queries, "_block", blocks, "_part", parts).groupBy("_block", "_part")
    right = dealt(given, "_part", parts, "_block", blocks).groupBy("_block", "_part")
    found = left.cogroup(right).applyInPandas(_best(k), "q long, near_id long, cosine double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "near_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(ident), "rank", "near_id", "cosine")


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)


def _best(k: int):
    def run(key: tuple[Any, ...], asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "near_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        if asked.empty or rows.empty:
            return empty
        ids, units = asked["id"].to_numpy(), _unit(np.stack(asked["v"].to_numpy()).astype(float))
        kept = empty
        for at in range(0, len(rows), SLICE):
            pdf = rows.iloc[at : at + SLICE]
            own = pdf["id"].to_numpy()
            cosine = np.round(units @ _unit(np.stack(pdf["v"].to_numpy()).astype(float)).T, 6)
            cosine[ids[:, None] == own[None, :]] = np.nan
            order = np.lexsort((np.broadcast_to(own, cosine.shape), np.where(np.isnan(cosine), np.inf, -cosine)), axis=1)[:, :k]
            row = np.repeat(np.arange(len(ids)), order.shape[1])
            value = cosine[row, order.ravel()]
            good = ~np.isnan(value)
            more = pd.DataFrame({"q": ids[row][good], "near_id": own[order.ravel()][good], "cosine": value[good]})
            both = pd.concat([kept, more]) if len(kept) else more
            kept = both.sort_values(["q", "cosine", "near_id"], ascending=[True, False, True]).groupby("q", sort=False).head(k)
        return kept

    return run
