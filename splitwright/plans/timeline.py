"""Bursts, leakage, gaps, adjacency and islands over the images' timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import frames
from ..operators import timeline as T
from ..session import Workspace
from ..sources.tables import table
from . import sqltext as S

TAUS = [3, 5, 10, 30, 60]
EDGES = [0, 1, 2, 3, 5, 10, 15, 30, 60, 120, 300, 600, 1800, 3600]


def _images(spark: SparkSession, d: str) -> DataFrame:
    """The image frame, written once: every ordered operator reads it twice or more, and it is far narrower than the table."""
    return Workspace(spark, "images").keep(frames.image_frame(table(spark, d, "images")).select("image_id", "stem", "split", "family", "key", "second", "bucket", "counter"))


def _family_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.concat(F.lit("FAMILY:"), F.col("family")))


def burst_metrics_by_tau(spark: SparkSession, d: str) -> DataFrame:
    """Leakage of bursts at swept gaps, with images keyed by device and, beside it, by name family only."""
    images = _images(spark, d)
    out = None
    for keying, df in (("device", images), ("family_only", _family_key(images))):
        one = T.leakage(T.session_starts(df, "key", "second", ["image_id"], TAUS), "key").withColumn("keying", F.lit(keying))
        out = one if out is None else out.unionByName(one)
    return out


def burst_membership(spark: SparkSession, d: str) -> DataFrame:
    """Each timed image's burst at 15 s, numbered over all devices, with the burst's splits."""
    ws = Workspace(spark, "sessions")
    sessions = ws.keep(T.session_starts(_images(spark, d), "key", "second", ["image_id"], [15]))
    numbered = T.numbered_sessions(sessions, "key", ws)
    splits = sessions.groupBy("key", "start_s").agg(F.array_join(F.sort_array(F.collect_set("split")), "|").alias("splits_present"), F.count("*").alias("cluster_size"))
    return sessions.join(numbered, ["tau", "key", "start_s"]).join(splits, ["key", "start_s"]).select("image_id", "key", "cluster_id", "cluster_size", "splits_present")


def excluded_from_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Images without a time, counted by family: excluded rows are never dropped silently."""
    return _images(spark, d).groupBy("family").agg(F.count("*").alias("n_images"), F.count_if(F.col("second").isNull()).alias("n_excluded"))


def gap_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between neighbours of a device in right-closed bins, empty bins and overflow included."""
    return T.gap_histogram(_images(spark, d), "key", "second", ["image_id"], EDGES)


def min_cross_split_gap(spark: SparkSession, d: str) -> DataFrame:
    """Least gap between neighbours of different splits, by relation."""
    return _cross(spark, d).groupBy("relation").agg(F.min("gap_s").alias("min_gap_s"), F.count("*").alias("n_pairs"))


def _cross(spark: SparkSession, d: str) -> DataFrame:
    pairs = T.consecutive_pairs(_images(spark, d), "key", "second", "image_id", carry=["split"])
    return pairs.withColumn("relation", N.relation(F.col("a_split"), F.col("b_split"))).where("relation is not null")


def tightest_cross_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The ten tightest neighbour pairs of each relation between splits."""
    order = Window.partitionBy("relation").orderBy("gap_s", "a_image_id", "b_image_id")
    ranked = _cross(spark, d).withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return ranked.select("relation", "rank", "gap_s", "a_image_id", "b_image_id")


def _states(spark: SparkSession, d: str) -> DataFrame:
    states = frames.current_splits(_images(spark, d), table(spark, d, "images"), table(spark, d, "groups_moved"))
    return Workspace(spark, "states").keep(states.select("image_id", "split", "moved_split", "key", "second"))


def adjacency_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs at most 15 s apart, all and consecutive ones, by relation, before and after the groups' moves."""
    images = _states(spark, d)
    carry = ["split", "moved_split"]
    out = None
    for definition, pairs in (
        ("all", T.band_pairs(images, "key", "second", "image_id", 15, carry)),
        ("consecutive", T.consecutive_pairs(images, "key", "second", "image_id", 15, carry)),
    ):
        both = F.explode(
            F.array(
                F.struct(F.lit("listed").alias("state"), F.col("a_split").alias("a"), F.col("b_split").alias("b")),
                F.struct(F.lit("moved").alias("state"), F.col("a_moved_split").alias("a"), F.col("b_moved_split").alias("b")),
            )
        )
        one = pairs.select(both.alias("p")).select("p.state", F.coalesce(N.relation(F.col("p.a"), F.col("p.b")), F.lit("same or unknown")).alias("relation"))
        one = one.groupBy("state", "relation").agg(F.count("*").alias("n_pairs")).withColumn("definition", F.lit(definition))
        out = one if out is None else out.unionByName(one)
    return out


def sessions_opened(spark: SparkSession, d: str) -> DataFrame:
    """Bursts at 15 s that were whole in one split and that the groups' moves opened, with the share of their images that went elsewhere."""
    sessions = T.session_starts(_states(spark, d), "key", "second", ["image_id"], [15])
    distinct = {c: F.count_distinct(c) for c in ("split", "moved_split")}
    per = sessions.groupBy("key", "start_s").agg(
        F.count("*").alias("n_images"), F.count_if(F.col("split") != F.col("moved_split")).alias("n_moved"), *[n.alias(f"n_{c}") for c, n in distinct.items()]
    )
    opened = per.where("n_split = 1 and n_moved_split > 1")
    return opened.select("key", "start_s", "n_images", "n_moved", F.round(F.col("n_moved") / F.col("n_images"), 4).alias("share"))


def adjacency_created_removed(spark: SparkSession, d: str) -> DataFrame:
    """Cross-split neighbour pairs that the groups' moves created or removed."""
    pairs = T.consecutive_pairs(_states(spark, d), "key", "second", "image_id", 15, ["split", "moved_split"])
    before = N.relation(F.col("a_split"), F.col("b_split")).isNotNull()
    after = N.relation(F.col("a_moved_split"), F.col("b_moved_split")).isNotNull()
    # one pass in place of two set differences: a pair's membership in either set is known from its own row
    change = F.when(~before & after, "created").when(before & ~after, "removed")
    return pairs.select("a_image_id", "b_image_id", change.alias("change")).where("change is not null")


def contiguous_runs(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous runs, by family and date, of dated images that manifest_v1 doesn't have."""
    images = _images(spark, d).where(F.col("second").isNotNull() & F.col("bucket").rlike(r"\A\d{8}\z"))
    listed = frames.manifest_frame(table(spark, d, "manifest_v1"), "v1_split").select("stem", F.lit(True).alias("listed"))
    marked = images.join(listed, "stem", "left").withColumn("missing", F.col("listed").isNull())
    return T.islands(marked, ["family", "bucket"], ["second", "image_id"], "missing")


def consecutive_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counter-named images n and n + 1 of one device, by the relation of their splits."""
    counters = _images(spark, d).where("family = 'counter' and counter is not null")
    pairs = T.successor_pairs(counters, "key", "counter", ["image_id", "split"])
    relation = F.coalesce(N.relation(F.col("a_split"), F.col("b_split")), F.lit("same or unknown"))
    return pairs.groupBy(relation.alias("relation")).agg(F.count("*").alias("n_pairs"))


def repeated_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters that several images of one device share: reported, the last wins in consecutive_counters."""
    counters = _images(spark, d).where("family = 'counter' and counter is not null")
    return counters.groupBy("key", "counter").agg(F.count("*").alias("n")).where("n > 1")


QUERIES = {
    f.__name__: f
    for f in (
        burst_metrics_by_tau, burst_membership, excluded_from_timeline, gap_histogram, min_cross_split_gap, tightest_cross_pairs,
        adjacency_counts, adjacency_created_removed, sessions_opened, contiguous_runs, consecutive_counters, repeated_counters,
    )
}

#: img: the SQL form of frames.image_frame.
IMG = f"""img0 AS (SELECT image_id, filename, {S.stem('filename')} AS stem, {S.split('split')} AS split, {S.device('device_name')} AS device,
    {S.strip('capture_group')} AS capture_group, ts, epoch FROM images WHERE image_id IS NOT NULL),
  img1 AS (SELECT *, {S.family('stem')} AS family,
    coalesce(epoch(ts)::BIGINT, floor(epoch)::BIGINT, epoch(try_strptime({S.name_digits('stem')}, '%Y%m%d%H%M%S'))::BIGINT) AS second,
    CASE WHEN stem IS NULL THEN NULL WHEN {S.name_digits('stem')} IS NOT NULL THEN substr({S.name_digits('stem')}, 1, 8)
      WHEN {S.family('stem')} = 'counter' THEN '<untimestamped:counter>' ELSE '<unparsed-filename>' END AS bucket,
    CASE WHEN {S.family('stem')} = 'counter' THEN try_cast(substr(stem, 5) AS BIGINT) END AS counter FROM img0),
  img2 AS (SELECT image_id, min(filename) AS filename, min(stem) AS stem, min(split) AS split, min(family) AS family, min(device) AS device, min(second) AS second, min(bucket) AS bucket,
    min(capture_group) AS capture_group, min(counter) AS counter FROM img1 GROUP BY image_id),
  img AS (SELECT *, coalesce(device, 'FAMILY:' || family) AS key FROM img2)"""

#: st: img with moved_split, the split after the groups' latest moves.
STATES = IMG + f""", mv AS (SELECT group_id, arg_max(CASE lower(trim(direction)) WHEN 'admitted' THEN {S.split('split')} WHEN 'returned' THEN 'train' END,
    struct_pack(a := moved_at, b := move_id)) AS mto FROM groups_moved WHERE group_id IS NOT NULL AND moved_at IS NOT NULL GROUP BY group_id),
  gr AS (SELECT image_id, min(group_id) AS gid FROM images WHERE image_id IS NOT NULL GROUP BY image_id),
  st AS (SELECT img.*, coalesce(mv.mto, img.split) AS moved_split FROM img LEFT JOIN gr USING (image_id) LEFT JOIN mv ON mv.group_id = gr.gid)"""


def _relation(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> {b} THEN least({a}, {b}) || '<->' || greatest({a}, {b}) END"


def _metrics(keying: str, key: str) -> str:
    return f"""SELECT '{keying}' AS keying, tau, count(*) AS clusters, count(*) FILTER (WHERE s <= 1) AS pure, count(*) FILTER (WHERE s > 1) AS crossing,
  count(*) FILTER (WHERE te AND tr) AS test_with_train, count(*) FILTER (WHERE va AND tr) AS valid_with_train, count(*) FILTER (WHERE te AND va) AS test_with_valid,
  round(100.0 * count(*) FILTER (WHERE s > 1) / count(*), 1) AS pct_crossing,
  list_sort(list(n) FILTER (WHERE s > 1))[(count(*) FILTER (WHERE s > 1) // 2 + 1)::INT] AS median_crossing_size
FROM (SELECT tau, key, run, count(*) AS n, count(DISTINCT split) AS s, coalesce(bool_or(split = 'test'), false) AS te, coalesce(bool_or(split = 'train'), false) AS tr, coalesce(bool_or(split = 'valid'), false) AS va
  FROM (SELECT *, sum(c) OVER (PARTITION BY tau, key ORDER BY second, image_id) AS run
    FROM (SELECT tau, {key} AS key, second, image_id, split, CASE WHEN second - lag(second) OVER (PARTITION BY tau, {key} ORDER BY second, image_id) <= tau THEN 0 ELSE 1 END AS c
      FROM img, (SELECT unnest([3, 5, 10, 30, 60]) AS tau) WHERE second IS NOT NULL)) GROUP BY tau, key, run) GROUP BY tau"""


_NEIGHBOURS = """nb AS (SELECT key, second, image_id AS b_image_id, split AS b_split, moved_split AS b_moved, lag(image_id) OVER w AS a_image_id, lag(split) OVER w AS a_split,
  lag(moved_split) OVER w AS a_moved, second - lag(second) OVER w AS gap_s FROM st WHERE second IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY second, image_id))"""
_CROSS = f"WITH {STATES}, {_NEIGHBOURS}, x AS (SELECT *, {_relation('a_split', 'b_split')} AS relation FROM nb WHERE gap_s IS NOT NULL AND a_split <> b_split)"
_BAND = """band AS (SELECT a.split AS a_split, b.split AS b_split, a.moved_split AS a_moved, b.moved_split AS b_moved FROM st a JOIN st b ON a.key = b.key AND b.second BETWEEN a.second AND a.second + 15
  AND (b.second > a.second OR b.image_id > a.image_id))"""


def _adjacent(definition: str, state: str, source: str, a: str, b: str) -> str:
    return f"SELECT '{definition}' AS definition, '{state}' AS state, coalesce({_relation(a, b)}, 'same or unknown') AS relation, count(*) AS n_pairs FROM {source} GROUP BY 3"


_FAMILY_KEY = "'FAMILY:' || family"

ORACLES = {
    "burst_metrics_by_tau": f"WITH {IMG} {_metrics('device', 'key')} UNION ALL {_metrics('family_only', _FAMILY_KEY)}",
    "burst_membership": f"""WITH {IMG}, c AS (SELECT *, CASE WHEN second - lag(second) OVER (PARTITION BY key ORDER BY second, image_id) <= 15 THEN 0 ELSE 1 END AS c FROM img WHERE second IS NOT NULL),
  r AS (SELECT *, sum(c) OVER (ORDER BY key, second, image_id) - 1 AS cluster_id FROM c)
SELECT image_id, key, cluster_id::BIGINT AS cluster_id, count(*) OVER w AS cluster_size,
  coalesce(array_to_string(list_sort(list_distinct(list(split) FILTER (WHERE split IS NOT NULL) OVER w)), '|'), '') AS splits_present FROM r WINDOW w AS (PARTITION BY cluster_id)""",
    "excluded_from_timeline": f"WITH {IMG} SELECT family, count(*) AS n_images, count(*) FILTER (WHERE second IS NULL) AS n_excluded FROM img GROUP BY family",
    "gap_histogram": f"""WITH {STATES}, {_NEIGHBOURS}, bins AS (SELECT unnest({EDGES + ['NULL']}::INT[]) AS bin),
  g AS (SELECT (SELECT min(e) FROM unnest({EDGES}::INT[]) t(e) WHERE gap_s <= e) AS b, count(*) AS k FROM nb WHERE gap_s IS NOT NULL GROUP BY 1)
SELECT bin, coalesce(k, 0) AS n FROM bins LEFT JOIN g ON bin IS NOT DISTINCT FROM b""".replace("'NULL'", "NULL"),
    "min_cross_split_gap": _CROSS + " SELECT relation, min(gap_s) AS min_gap_s, count(*) AS n_pairs FROM x GROUP BY relation",
    "tightest_cross_pairs": _CROSS
    + """ SELECT relation, rank::INT AS rank, gap_s, a_image_id, b_image_id FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY gap_s, a_image_id, b_image_id) AS rank FROM x) WHERE rank <= 10""",
    "adjacency_counts": f"WITH {STATES}, {_NEIGHBOURS}, close AS (SELECT * FROM nb WHERE gap_s <= 15), {_BAND} "
    + " UNION ALL ".join(
        _adjacent(definition, state, source, a, b)
        for definition, source in (("all", "band"), ("consecutive", "close"))
        for state, a, b in (("listed", "a_split", "b_split"), ("moved", "a_moved", "b_moved"))
    ),
    "adjacency_created_removed": f"""WITH {STATES}, {_NEIGHBOURS}, close AS (SELECT *, coalesce(a_split <> b_split, false) AS p, coalesce(a_moved <> b_moved, false) AS q FROM nb WHERE gap_s <= 15)
SELECT a_image_id, b_image_id, CASE WHEN q THEN 'created' ELSE 'removed' END AS change FROM close WHERE p <> q""",
    "sessions_opened": f"""WITH {STATES}, c AS (SELECT *, CASE WHEN second - lag(second) OVER (PARTITION BY key ORDER BY second, image_id) <= 15 THEN 0 ELSE 1 END AS c FROM st WHERE second IS NOT NULL AND key IS NOT NULL),
  r AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY second, image_id) AS run FROM c),
  g AS (SELECT key, min(second) AS start_s, count(*) AS n_images, count(*) FILTER (WHERE split <> moved_split) AS n_moved, count(DISTINCT split) AS a, count(DISTINCT moved_split) AS b FROM r GROUP BY key, run)
SELECT key, start_s, n_images, n_moved, round(n_moved / n_images, 4) AS share FROM g WHERE a = 1 AND b > 1""",
    "contiguous_runs": f"""WITH {IMG}, l AS (SELECT DISTINCT {S.stem('image_name')} AS s FROM manifest_v1),
  p AS (SELECT family, bucket, l.s IS NULL AS missing, row_number() OVER (PARTITION BY family, bucket ORDER BY second, image_id) AS place FROM img LEFT JOIN l ON l.s = img.stem
    WHERE second IS NOT NULL AND regexp_full_match(bucket, '\\d{{8}}')),
  r AS (SELECT *, place - row_number() OVER (PARTITION BY family, bucket ORDER BY place) AS run FROM p WHERE missing)
SELECT family, bucket, sum(n)::BIGINT AS members, count(*) AS runs, max(n) AS longest FROM (SELECT family, bucket, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY family, bucket""",
    "consecutive_counters": f"""WITH {IMG}, c AS (SELECT key, counter, arg_max(struct_pack(s := split), image_id).s AS split FROM img WHERE family = 'counter' AND counter IS NOT NULL GROUP BY ALL)
SELECT coalesce({_relation('a.split', 'b.split')}, 'same or unknown') AS relation, count(*) AS n_pairs FROM c a JOIN c b ON a.key = b.key AND b.counter = a.counter + 1 GROUP BY 1""",
    "repeated_counters": f"WITH {IMG} SELECT key, counter, count(*) AS n FROM img WHERE family = 'counter' AND counter IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
}
