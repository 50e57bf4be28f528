"""Reading capture names, splits and devices: pure Column expressions, null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The split vocabulary, its spellings, the export tail and the name families.
SPLITS = ("train", "valid", "test")
SPLIT_SPELLINGS = {"train": "train", "training": "train", "valid": "valid", "val": "valid", "validation": "valid", "test": "test"}
EXTENSIONS = "jpg|jpeg|png"
TAIL = rf"(?i)(?:_(?:{EXTENSIONS})\.rf\.[0-9a-f]{{32}})?\.(?:{EXTENSIONS})\z"
EXPORT_NAME = rf"(?i)\A.+_(?:{EXTENSIONS})\.rf\.[0-9a-f]{{32}}\.(?:{EXTENSIONS})\z"
FAMILIES = {
    "ts_underscore": r"\AIMG_\d{8}_\d{6}\z",
    "ts_compact_sub": r"\AIMG\d{14}_\d{2}\z",
    "ts_compact": r"\AIMG\d{14}\z",
    "counter": r"\AIMG_\d{4,}\z",
    "clock": r"\ACLK_\d{6}_\d+\z",
}
COUNTER_BUCKET = "<untimestamped:counter>"
UNPARSED_BUCKET = "<unparsed-filename>"
VOID_TEXTS = ("", "-", "na", "n/a")
# All characters with the Unicode property White_Space.
WHITESPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Outer whitespace dropped, in the Unicode sense (tabs and no-break spaces included)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def squeeze(c: Column | str) -> Column:
    """Outer whitespace dropped and each inner run of it written as one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def blank_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.lower(strip(c)).isin(*VOID_TEXTS), F.lit(None).cast("string")).otherwise(c)


def split_label(c: Column | str) -> Column:
    """train, valid or test; any other text, and null, give null."""
    low = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for label in SPLITS:
        out = F.when(low.isin(*[k for k, v in SPLIT_SPELLINGS.items() if v == label]), F.lit(label)).otherwise(out)
    return out


def _basename(c: Column | str) -> Column:
    """What follows the last slash or backslash."""
    return F.substring_index(F.replace(strip(c), F.lit("\\"), F.lit("/")), "/", -1)


def stem(c: Column | str) -> Column:
    """Capture name of a file name: no folder, no export tail or extension, upper case; nothing left is null."""
    bare = _basename(c)
    out = F.upper(F.regexp_replace(bare, TAIL, ""))
    return F.when(F.length(out) > 0, out)


def name_route(c: Column | str) -> Column:
    """'export' where the name has the export tail, else 'raw'."""
    bare = _basename(c)
    return F.when(bare.rlike(EXPORT_NAME), F.lit("export")).when(bare.isNotNull(), F.lit("raw"))


def family(stem_: Column | str) -> Column:
    """Name family of a stem; the sub-indexed form is tried before the plain compact one."""
    s = _col(stem_)
    out = F.when(s.isNotNull(), F.lit("unparsed"))
    for name in reversed(FAMILIES):
        out = F.when(s.rlike(FAMILIES[name]), F.lit(name)).otherwise(out)
    return out


def name_digits(stem_: Column | str) -> Column:
    """The 14 date and time digits of a timestamped name, else null."""
    s, fam = _col(stem_), family(stem_)
    digits = F.substring(F.regexp_replace(s, r"[^0-9]", ""), 1, 14)
    return F.when(fam.isin("ts_underscore", "ts_compact", "ts_compact_sub"), digits)


def seconds_of(ts: Column | str) -> Column:
    """Seconds since 1970 of a zoneless timestamp that stands for UTC, whatever the session's time zone.

    Built from the date and the time of day as written; fractions of a second are dropped.
    """
    t = _col(ts).cast("timestamp_ntz")
    of_day = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.unix_date(t.cast("date")).cast("long") * 86400 + of_day


def digits_seconds(digits14: Column) -> Column:
    """Seconds since 1970 of yyyyMMddHHmmss; null unless the date and the time exist."""
    return seconds_of(F.try_to_timestamp(digits14, F.lit("yyyyMMddHHmmss")))


def name_seconds(stem_: Column | str) -> Column:
    return digits_seconds(name_digits(stem_))


def clock_digits(stem_: Column | str) -> Column:
    s = _col(stem_)
    return F.when(family(s) == "clock", F.substring(s, 5, 6))


def date_bucket(stem_: Column | str) -> Column:
    """Capture date as written (even an impossible one), or the sentinel of an undated family."""
    s = _col(stem_)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(name_digits(s).isNotNull(), F.substring(name_digits(s), 1, 8))
        .when(family(s) == "counter", F.lit(COUNTER_BUCKET))
        .otherwise(F.lit(UNPARSED_BUCKET))
    )


def pretty_date(bucket: Column | str) -> Column:
    """'19 Feb 2024' for a real eight-digit date, the bucket itself otherwise."""
    b = _col(bucket)
    day = F.try_to_timestamp(F.when(b.rlike(r"\A\d{8}\z"), b), F.lit("yyyyMMdd"))
    return F.coalesce(F.date_format(day, "d MMM yyyy"), b)


def device_key(c: Column | str) -> Column:
    """Upper case, only A-Z and 0-9 kept; nothing left is null."""
    out = F.regexp_replace(F.upper(_col(c)), r"[^A-Z0-9]", "")
    return F.when(F.length(out) > 0, out)


def device_or_family(device: Column | str, family_: Column | str) -> Column:
    """Device key, else FAMILY: and the name family as written."""
    return F.coalesce(device_key(device), F.concat(F.lit("FAMILY:"), _col(family_)))


def relation(split_a: Column, split_b: Column) -> Column:
    """Canonical name of a pair of splits, e.g. test<->train."""
    return F.when(split_a != split_b, F.concat(F.least(split_a, split_b), F.lit("<->"), F.greatest(split_a, split_b)))


def effective_score(score: Column | str, *distances: Column | str) -> Column:
    """The score; where it is null or NaN the least given distance; else null."""
    given = [F.when(~F.isnan(_col(c)), _col(c)) for c in (score, *distances)]
    return F.coalesce(given[0], F.least(*given[1:]) if len(given) > 2 else given[1])


def low_info(flag: Column | str, n_boxes: Column | str, most: int = 2) -> Column:
    """The flag; where it is null whether there are at most ``most`` boxes; unknown is false."""
    return F.coalesce(_col(flag), _col(n_boxes) <= most, F.lit(False))
