"""Comparable text and text lint: Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import VOID_TEXTS, squeeze


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold()))


def comparable(c: Column | str, squeezed: bool = False) -> Column:
    """Text as compared: whitespace squeezed, case and Unicode composition ignored, void texts null.

    Plain ASCII stays in the JVM; only other texts go through Python for composition. squeezed says that
    the column has its whitespace dealt with already, which saves repeating that for each use.
    """
    t = (F.col(c) if isinstance(c, str) else c) if squeezed else squeeze(c)
    plain = F.octet_length(t) == F.char_length(t)
    folded = F.when(plain, F.lower(t)).otherwise(_composed(F.when(~plain, t)))
    return F.when(~folded.isin(*VOID_TEXTS), folded)


def instant_seconds(c: Column | str, squeezed: bool = False) -> Column:
    """Seconds since 1970 (double) of a written instant; null where it can't be read.

    yyyy-mm-dd and a time, split by T or a space, UTC unless Z or an offset follows; dd.mm.yyyy and a
    time; bare digits are seconds since 1970.
    """
    t = (F.col(c) if isinstance(c, str) else c) if squeezed else squeeze(c)
    iso = F.regexp_replace(t, r"\A(\d{1,2})\.(\d{1,2})\.(\d{4})[T ]", "$3-$2-$1 ")
    zoned = F.when(iso.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})\z"), iso).otherwise(F.concat(iso, F.lit("Z")))
    written = F.when(t.rlike(r"\A\d{1,4}[-.].*:"), zoned.try_cast("timestamp").cast("double"))
    return F.when(t.rlike(r"\A\d{1,12}\z"), t.try_cast("double")).otherwise(written)
