"""Comparison of two copies (p2) and sessions (p5) over the audit's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import bursts, copies
from ..sources.tables import table
from . import sqltext as S


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All differences between the two manifest copies, and wrong published counts."""
    return copies.compare_manifests(table(spark, d, "manifest_v1"), table(spark, d, "manifest_v2"), table(spark, d, "split_by_group"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """Differences counted by kind and field."""
    return p2_found(spark, d).groupBy("kind", "field").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of every device: more than 15 s of silence cut."""
    found = bursts.capture_bursts(table(spark, d, "images"), table(spark, d, "scene_pairs"))
    return found.select("device_key", "start_s", "end_s", "n_captures")


def p5_durations(spark: SparkSession, d: str) -> DataFrame:
    """Bursts, captures and seconds by device."""
    found = bursts.capture_bursts(table(spark, d, "images"), table(spark, d, "scene_pairs"))
    return found.groupBy("device_key").agg(
        F.count("*").alias("n_bursts"), F.sum("n_captures").alias("n_captures"), F.sum("duration_s").alias("seconds"), F.max("duration_s").alias("longest_s")
    )


def p5_user_sessions(spark: SparkSession, d: str, gap: int = 1800) -> DataFrame:
    """Sessions of every user of the event stream, cut by more than half an hour of silence."""
    events = table(spark, d, "events").select("user_id", N.seconds_of("ts").alias("second"))
    return bursts.sessions(events, "user_id", "second", gap).withColumnRenamed("n", "n_events")


QUERIES = {f.__name__: f for f in (p2_found, p2_summary, p5_found, p5_durations, p5_user_sessions)}

_SECONDS = rf"""CASE WHEN regexp_full_match(x, '\d{{1,12}}') THEN x::DOUBLE
  WHEN regexp_matches(x, '^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}') THEN epoch(try_strptime(x, '%d.%m.%Y %H:%M:%S'))
  WHEN regexp_matches(x, '([Zz]|[+-]\d{{2}}:?\d{{2}})$') THEN epoch(try_cast(x AS TIMESTAMPTZ))
  ELSE epoch(try_cast(x AS TIMESTAMP)) END"""


def _side(name: str, split: str, instant: str) -> str:
    return f"""(SELECT stem, max_by(r, row_no) AS r FROM (
  SELECT row_no, {S.stem('image_name')} AS stem, struct_pack(
    split := coalesce({S.split(split)}, {S.comparable(split)}), capture_group := {S.comparable('capture_group')},
    device := CASE WHEN {S.comparable('device_name')} IS NOT NULL THEN {S.device('device_name')} END, background := {S.comparable('background')},
    n_boxes := try_cast(n_boxes AS DOUBLE), mean_area := CASE WHEN NOT isnan(mean_area) THEN mean_area END, exported_at := {instant}) AS r
  FROM (SELECT *, {S.strip('exported_at::VARCHAR')} AS x FROM {name})) WHERE stem IS NOT NULL GROUP BY stem)"""


_MERGED = f"""WITH m AS (SELECT coalesce(a.stem, b.stem) AS stem, a.stem IS NOT NULL AS in1, b.stem IS NOT NULL AS in2, a.r AS l, b.r AS r
  FROM {_side('manifest_v1', 'v1_split', 'epoch(exported_at)')} a FULL JOIN {_side('manifest_v2', 'v2_split', _SECONDS)} b ON a.stem = b.stem),
  found AS (
  SELECT 'only_v1' AS kind, stem AS item, 'row' AS field FROM m WHERE NOT in2 UNION ALL SELECT 'only_v2', stem, 'row' FROM m WHERE NOT in1
  """ + "".join(
    f"UNION ALL SELECT 'differs', stem, '{f}' FROM m WHERE in1 AND in2 AND l.{f} IS DISTINCT FROM r.{f}\n  "
    for f in copies.MANIFEST_FIELDS
    if f != "mean_area"
) + f"""UNION ALL SELECT 'differs', stem, 'mean_area' FROM m WHERE in1 AND in2
    AND (round(abs(l.mean_area - r.mean_area), 10) > 0.0001 OR (l.mean_area IS NULL) <> (r.mean_area IS NULL))
  UNION ALL SELECT 'count', {S.strip('g.capture_group')} || '/' || coalesce({S.device('g.device_name')}, ''), 'imgs_changed_split' FROM split_by_group g
    LEFT JOIN (SELECT l.capture_group AS cg, l.device AS dev, count(*) FILTER (WHERE l.split IS DISTINCT FROM r.split) AS n FROM m WHERE in1 AND in2 GROUP BY 1, 2) c
    ON c.cg IS NOT DISTINCT FROM {S.comparable('g.capture_group')} AND c.dev IS NOT DISTINCT FROM {S.device('g.device_name')}
    WHERE g.imgs_changed_split IS DISTINCT FROM coalesce(c.n, 0))
"""

_CAPTURES = f"""WITH l AS (
  SELECT {S.stem('filename')} AS stem, {S.device('device_name')} AS device, 'FAMILY:' || family AS fallback, epoch(ts)::BIGINT AS ts_s,
    floor(epoch)::BIGINT AS epoch_s, CASE WHEN try_strptime(nullif(regexp_extract(capture_group, '^\\d{{8}}$'), ''), '%Y%m%d') IS NOT NULL THEN regexp_extract(capture_group, '^\\d{{8}}$') END AS day FROM images
  UNION ALL SELECT {S.stem('stem_a')}, {S.device('device_a')}, NULL, NULL, NULL, NULL FROM scene_pairs WHERE {S.device('device_a')} IS NOT NULL),
  one AS (SELECT stem, coalesce(min(device), min(fallback)) AS device_key, min(ts_s) AS t, min(epoch_s) AS e, min(day) AS day FROM l WHERE stem IS NOT NULL GROUP BY stem),
  timed AS (SELECT device_key, stem, coalesce(t, e, epoch(try_strptime(coalesce({S.name_digits('stem')},
    day || CASE WHEN {S.family('stem')} = 'clock' THEN substr(stem, 5, 6) END), '%Y%m%d%H%M%S'))::BIGINT) AS s FROM one),
  cut AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 15 THEN 0 ELSE 1 END AS c FROM timed WHERE s IS NOT NULL AND device_key IS NOT NULL WINDOW w AS (PARTITION BY device_key ORDER BY s, stem)),
  runs AS (SELECT *, sum(c) OVER (PARTITION BY device_key ORDER BY s, stem) AS run FROM cut),
  bursts AS (SELECT device_key, min(s) AS start_s, max(s) AS end_s, count(*) AS n_captures FROM runs GROUP BY device_key, run)
"""

ORACLES = {
    "p2_found": _MERGED + "SELECT kind, item, field FROM found",
    "p2_summary": _MERGED + "SELECT kind, field, count(*) AS n FROM found GROUP BY ALL",
    "p5_found": _CAPTURES + "SELECT device_key, start_s, end_s, n_captures FROM bursts",
    "p5_durations": _CAPTURES
    + """SELECT device_key, count(*) AS n_bursts, sum(n_captures)::BIGINT AS n_captures, sum(end_s - start_s)::BIGINT AS seconds,
    max(end_s - start_s) AS longest_s FROM bursts GROUP BY device_key""",
    "p5_user_sessions": """WITH e AS (SELECT user_id, floor(epoch_us(ts) / 1000000)::BIGINT AS s, event_id FROM events),
  cut AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 1800 THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
  runs AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s, event_id) AS run FROM cut)
  SELECT user_id, min(s) AS start_s, max(s) AS end_s, max(s) - min(s) AS duration_s, count(*) AS n_events FROM runs GROUP BY user_id, run""",
}
