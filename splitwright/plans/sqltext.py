"""Pieces of the SQL statements that read names, splits and devices."""

from __future__ import annotations


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def stem(c: str) -> str:
    bare = rf"regexp_replace({strip(c)}, '^.*[/\\]', '')"
    return rf"nullif(upper(regexp_replace({bare}, '(?i)(_(jpg|jpeg|png)\.rf\.[0-9a-f]{{32}})?\.(jpg|jpeg|png)$', '')), '')"


def split(c: str) -> str:
    return (
        f"CASE lower({strip(c)}) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'valid' THEN 'valid' "
        "WHEN 'val' THEN 'valid' WHEN 'validation' THEN 'valid' WHEN 'test' THEN 'test' END"
    )


def device(c: str) -> str:
    return f"nullif(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g'), '')"


def family(s: str) -> str:
    return (
        rf"CASE WHEN {s} IS NULL THEN NULL WHEN regexp_full_match({s}, 'IMG_\d{{8}}_\d{{6}}') THEN 'ts_underscore' "
        rf"WHEN regexp_full_match({s}, 'IMG\d{{14}}_\d{{2}}') THEN 'ts_compact_sub' WHEN regexp_full_match({s}, 'IMG\d{{14}}') THEN 'ts_compact' "
        rf"WHEN regexp_full_match({s}, 'IMG_\d{{4,}}') THEN 'counter' WHEN regexp_full_match({s}, 'CLK_\d{{6}}_\d+') THEN 'clock' ELSE 'unparsed' END"
    )


def name_digits(s: str) -> str:
    return f"CASE WHEN {family(s)} IN ('ts_underscore','ts_compact','ts_compact_sub') THEN substr(regexp_replace({s}, '[^0-9]', '', 'g'), 1, 14) END"


def comparable(c: str) -> str:
    folded = rf"lower(nfc_normalize(regexp_replace({strip(c)}, '\s+', ' ', 'g')))"
    return f"CASE WHEN {folded} NOT IN ('', '-', 'na', 'n/a') THEN {folded} END"


def given(c: str) -> str:
    """The text, null where it is one of the void texts."""
    return f"CASE WHEN lower({strip(c)}) NOT IN ('', '-', 'na', 'n/a') THEN {strip(c)} END"


def manifest(name: str, source: str, split_column: str) -> str:
    """A CTE: the SQL form of frames.manifest_frame."""
    return rf"""{name} AS (SELECT stem, r.claimed AS claimed, r.device AS device, r.background AS background, r.capture_group AS capture_group FROM (
  SELECT {stem('image_name')} AS stem, arg_max(struct_pack(claimed := {split(split_column)}, device := {device(given('device_name'))},
    background := lower(regexp_replace({given('background')}, '\s+', ' ', 'g')), capture_group := {given('capture_group')}), row_no) AS r
  FROM {source} GROUP BY 1) WHERE stem IS NOT NULL)"""
