"""Declarative expectations: rows of (table, key, column, expected, tolerance) held against facts, and data checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "label string, item string, column string, expected string, tolerance double"


def facts(df: DataFrame, item: str, columns: Sequence[str]) -> DataFrame:
    """(item, column, value): the frame unpivoted to text, one row for each cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(F.col(item).cast("string").alias("item"), cells.alias("c")).select("item", "c.column", "c.value")


def verify(expected: DataFrame, known: DataFrame) -> DataFrame:
    """(label, item, column, expected, found, verdict) of each expectation.

    PASS; FAIL; NO ROW if the item has no facts; NO COLUMN if the item has, but not that column; EMPTY if its value is null or
    blank; DISAGREES if several rows give different values. Numbers compare as numbers, within the tolerance
    where one is given; everything else as text.
    """
    per = known.groupBy("item", "column").agg(F.max("value").alias("found"), F.min("value").alias("_low"))
    items = known.select(F.col("item").alias("_item")).distinct()
    # expectations are written by hand: the small side
    joined = expected.join(per, ["item", "column"], "left").join(items, F.col("item") == F.col("_item"), "left")
    a, b = F.col("found").try_cast("double"), F.col("expected").try_cast("double")
    close = F.abs(a - b) <= F.coalesce("tolerance", F.lit(0.0)) + 1e-9
    verdict = (
        F.when(F.col("_item").isNull(), "NO ROW")
        .when(F.col("found").isNull() & F.col("_low").isNull() & ~F.coalesce(F.col("_has"), F.lit(False)), "NO COLUMN")
        .when(F.coalesce(F.trim("found"), F.lit("")) == "", "EMPTY")
        .when(F.col("found") != F.col("_low"), "DISAGREES")
        .when(F.coalesce(close, F.col("found") == F.col("expected")), "PASS")
        .otherwise("FAIL")
    )
    cells = known.select("item", "column", F.lit(True).alias("_has")).distinct()
    return joined.join(cells, ["item", "column"], "left").select("label", "item", "column", "expected", "found", verdict.alias("verdict"))


def expectation_rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def checks(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(check, violations, verdict): how many rows break each condition; a null condition is broken. One pass for all."""
    counted = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{k}") for k, c in enumerate(named.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{k}").alias("violations")) for k, n in enumerate(named)]))
    return counted.select(rows.alias("r")).select("r.*").withColumn("verdict", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def row_count(df: DataFrame, expected: int, label: str) -> DataFrame:
    """(check, violations, verdict): violations is how far the number of rows is off."""
    off = F.abs(F.count("*") - F.lit(expected))
    return df.agg(off.alias("violations")).select(F.lit(label).alias("check"), "violations", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("verdict"))


def unique(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(check, violations, verdict): violations is the number of keys with several rows."""
    many = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations"))
    return many.select(F.lit(label).alias("check"), "violations", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("verdict"))


def report(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class CheckFailed(AssertionError):
    """An expectation that gates a step did not hold."""


def require(report_: DataFrame) -> None:
    """Raises with the failing rows; reports have one row for each check, so this collects no data."""
    failed = [r.asDict() for r in report_.where("verdict <> 'PASS'").collect()]
    if failed:
        raise CheckFailed(str(failed))
