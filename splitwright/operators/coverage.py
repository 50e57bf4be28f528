"""Coverage and agreement of two sources: joins, anti-joins, contingency, confusion, composition, set verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "TOTAL"


def or_label(c: Column | str, label: str) -> Column:
    """The text, or a sentinel label where it is null or blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(F.trim(c) != "", c), F.lit(label))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, 0.0 where there is no whole."""
    return F.when(whole > 0, F.round(100 * part / whole, digits)).otherwise(F.lit(0.0))


def split_counts(df: DataFrame, key: str, split: str, labels: Sequence[str], total: bool = True) -> DataFrame:
    """(key, a count for each label, total), zero-filled, with a TOTAL row; rows of another split count in total only.

    The labels are given, not collected, so the schema doesn't depend on the data.
    """
    counts = [F.count_if(F.col(split) == s).alias(s) for s in labels]
    plain = df.groupBy(key).agg(*counts, F.count("*").alias("total"))
    if not total:
        return plain
    grand = plain.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*labels, "total"]]).select(F.lit(TOTAL).alias(key), *labels, "total")
    return plain.unionByName(grand)


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) for every combination that occurs, long form; see ``widen`` for a table."""
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def widen(long: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """The long form as a table with the given columns, missing combinations 0."""
    return long.groupBy(row).pivot(column, list(columns)).agg(F.sum(value)).na.fill(0)


def confusion(df: DataFrame, claimed: str, actual: str, labels: Sequence[str], by: str | None = None) -> DataFrame:
    """claimed x actual with a total column and, without ``by``, a TOTAL row."""
    if by:
        keys = [by, claimed]
        return df.groupBy(*keys).agg(*[F.count_if(F.col(actual) == s).alias(s) for s in labels], F.count("*").alias("total"))
    return split_counts(df, claimed, actual, labels)


def composition(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    """(axis, value, n): the same rows counted along several axes, in one pass over the data."""
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("axis"), F.col(c).cast("string").alias("value")) for name, c in axes.items()]))
    return df.select(stacked.alias("s")).groupBy("s.axis", "s.value").agg(F.count("*").alias("n"))


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key is not in right."""
    return left.join(right.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def overlap_verdict(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(n_left, n_right, n_both, verdict): identical, disjoint, left_within_right, right_within_left or partial."""
    both = left.select(key, F.lit(1).alias("_l")).distinct().join(right.select(key, F.lit(1).alias("_r")).distinct(), key, "full_outer")
    n = both.agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"))
    verdict = (
        F.when((F.col("n_left") == F.col("n_both")) & (F.col("n_right") == F.col("n_both")), "identical")
        .when(F.col("n_both") == 0, "disjoint")
        .when(F.col("n_left") == F.col("n_both"), "left_within_right")
        .when(F.col("n_right") == F.col("n_both"), "right_within_left")
        .otherwise("partial")
    )
    return n.withColumn("verdict", verdict)


def ambiguous_keys(df: DataFrame, key: str, dependent: str, sentinel: str | None = None) -> DataFrame:
    """(key, n_values, values): keys with more than one value of the dependent; nulls and the sentinel don't count."""
    given = df.where(F.col(key).isNotNull() & F.col(dependent).isNotNull())
    if sentinel is not None:
        given = given.where((F.col(key) != sentinel) & (F.col(dependent) != sentinel))
    distinct = given.select(key, dependent).distinct()
    return distinct.groupBy(key).agg(F.count("*").alias("n_values"), F.array_join(F.sort_array(F.collect_list(dependent)), "|").alias("values")).where("n_values > 1")


def single_split_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, only_split, n): keys all of whose rows lie in one split; rows without a split don't count."""
    per = df.where(F.col(split).isNotNull()).groupBy(key).agg(F.min(split).alias("only_split"), F.max(split).alias("_m"), F.count("*").alias("n"))
    return per.where(F.col("only_split") == F.col("_m")).drop("_m")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def full_counts(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(key, n in each): counts by key of two frames side by side, a missing key counting 0."""
    a, b = names
    tagged = left.select(key, F.lit(1).alias(a), F.lit(0).alias(b)).unionByName(right.select(key, F.lit(0).alias(a), F.lit(1).alias(b)))
    return tagged.groupBy(key).agg(F.sum(a).alias(a), F.sum(b).alias(b))
