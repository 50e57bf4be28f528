"""All named queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import allocation, coverage, data_problems, results, scenes, splits, texts, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (timeline, coverage, splits, scenes, results, allocation, texts, data_problems):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
