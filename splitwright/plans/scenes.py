"""Multiset buckets, scored scene pairs, contamination by state and threshold, components and redundancy, closest pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import frames, graph, scenes
from ..session import Workspace
from ..sources.tables import table
from . import sqltext as S
from .splits import BOX
from .timeline import IMG, STATES

EPSILONS = [0.01, 0.02, 0.05]


def _signed(spark: SparkSession, d: str) -> DataFrame:
    held = frames.box_frame(table(spark, d, "boxes"), table(spark, d, "classes"))
    listed = frames.image_frame(table(spark, d, "images")).select("filename", "image_id", "split", "family")
    signed = scenes.signatures(held)
    return signed.join(listed, signed["image"] == listed["filename"]).drop("filename", "image")


def multiset_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Images that share the multiset of their boxes' classes, and how many pairs that makes."""
    return scenes.buckets(_signed(spark, d)).where("n_images > 1")


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Work of the blocking: buckets, pairs kept and pairs in buckets over the limit, against all pairs."""
    b = scenes.buckets(_signed(spark, d))
    return b.agg(
        F.count("*").alias("n_buckets"),
        F.count_if(F.col("n_images") > 1).alias("shared_buckets"),
        F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("n_pairs"))), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.when(F.col("skipped"), F.col("n_pairs"))), F.lit(0)).alias("skipped_pairs"),
        (F.sum("n_images") * (F.sum("n_images") - 1) / 2).cast("long").alias("all_pairs"),
    )


def scene_pairs_scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one multiset with a raw or aligned distance of at most 0.05, greedily matched and scored."""
    return scenes.scored_pairs(_signed(spark, d), max(EPSILONS), ws=Workspace(spark, "signed"))


def scene_metrics_by_epsilon(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs by state, scoring, epsilon and low-info flag: cross-split pairs by relation."""
    images = frames.current_splits(frames.image_frame(table(spark, d, "images")), table(spark, d, "images"), table(spark, d, "groups_moved")).select("image_id", "split", "moved_split")
    pairs = Workspace(spark, "scenes").keep(scene_pairs_scored(spark, d))
    return scenes.contamination(_with_states(pairs, images), EPSILONS, ["listed", "moved"])


def _with_states(pairs: DataFrame, images: DataFrame) -> DataFrame:
    a = images.select(F.col("image_id").alias("a_image_id"), F.col("split").alias("a_listed"), F.col("moved_split").alias("a_moved"))
    b = images.select(F.col("image_id").alias("b_image_id"), F.col("split").alias("b_listed"), F.col("moved_split").alias("b_moved"))
    raw, aligned, low = F.col("raw_max_dist").alias("raw"), F.col("aligned_max_dist").alias("aligned"), F.col("low_info").alias("low")
    return pairs.join(a, "a_image_id").join(b, "b_image_id").select(raw, aligned, low, "a_listed", "b_listed", "a_moved", "b_moved")


def _listed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The scorer's list, one row for each unordered pair of stems: distances as given, low."""
    given = {c: F.when(~F.isnan(c), F.col(c)) for c in ("raw_max_dist", "aligned_max_dist")}
    p = table(spark, d, "scene_pairs").select(
        N.stem("stem_a").alias("x"), N.stem("stem_b").alias("y"), *[v.alias(k) for k, v in given.items()], N.low_info("low_info", "n_boxes").alias("low")
    )
    return (
        p.where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y")))
        .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .agg(F.min("raw_max_dist").alias("raw"), F.min("aligned_max_dist").alias("aligned"), F.min("low").alias("low"))
    )


def _stem_states(spark: SparkSession, d: str) -> DataFrame:
    states = frames.current_splits(frames.image_frame(table(spark, d, "images")), table(spark, d, "images"), table(spark, d, "groups_moved"))
    return states.where("stem is not null").groupBy("stem").agg(F.min("split").alias("listed"), F.min("moved_split").alias("moved"))


def _every_split(spark: SparkSession, d: str) -> DataFrame:
    """Each stem with all splits that its exports are in, as listed and after the moves."""
    states = frames.current_splits(frames.image_frame(table(spark, d, "images")), table(spark, d, "images"), table(spark, d, "groups_moved"))
    return states.where("stem is not null").groupBy("stem").agg(F.collect_set("split").alias("listed"), F.collect_set("moved_split").alias("moved"))  # at most three


def contamination_every_split(spark: SparkSession, d: str) -> DataFrame:
    """As contamination_three_way, with every split of a stem whose exports are in several."""
    states = _every_split(spark, d)
    a, b = (states.select(F.col("stem").alias(e), F.col("listed").alias(f"{e}_listed"), F.col("moved").alias(f"{e}_moved")) for e in "ab")
    return scenes.contamination(_listed_pairs(spark, d).join(a, "a").join(b, "b"), EPSILONS, ["listed", "moved"])


def evaluation_twins_every_split(spark: SparkSession, d: str) -> DataFrame:
    """As evaluation_twins, with every split of a stem: a twin in test and in valid counts in both."""
    states = _every_split(spark, d).select("stem", F.explode("listed").alias("s"))
    pairs = _listed_pairs(spark, d).where("not low").withColumn("d", F.least("raw", "aligned"))
    a, b = (states.select(F.col("stem").alias(e), F.col("s").alias(f"s{e}")) for e in "ab")
    return scenes.twin_counts(pairs.join(a, "a").join(b, "b"), EPSILONS)


def closest_pairs_every_split(spark: SparkSession, d: str) -> DataFrame:
    """As closest_pairs, with every split of a stem: a pair is listed in each relation that it has."""
    states = _every_split(spark, d).select("stem", F.explode("listed").alias("s"))
    a, b = (states.select(F.col("stem").alias(e), F.col("s").alias(f"s{e}")) for e in "ab")
    joined = _listed_pairs(spark, d).where("not low and raw is not null").join(a, "a").join(b, "b").withColumn("relation", N.relation(F.col("sa"), F.col("sb")))
    each = joined.where("relation is not null").select("relation", "raw", "a", "b").distinct()
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("relation").orderBy("raw", "a", "b"))).where("rank <= 5")
    return ranked.select("relation", "rank", "raw", "a", "b")


def contamination_three_way(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the scorer's list by state, scoring, epsilon and low-info flag, counted by the three relations of splits."""
    states = _stem_states(spark, d)
    a = states.select(F.col("stem").alias("a"), F.col("listed").alias("a_listed"), F.col("moved").alias("a_moved"))
    b = states.select(F.col("stem").alias("b"), F.col("listed").alias("b_listed"), F.col("moved").alias("b_moved"))
    return scenes.contamination(_listed_pairs(spark, d).join(a, "a").join(b, "b"), EPSILONS, ["listed", "moved"])


def evaluation_twins(spark: SparkSession, d: str) -> DataFrame:
    """Distinct test and valid stems with a train partner in the list, by epsilon."""
    states = _stem_states(spark, d).select("stem", "listed")
    pairs = _listed_pairs(spark, d).where("not low").withColumn("d", F.least("raw", "aligned"))
    a, b = states.select(F.col("stem").alias("a"), F.col("listed").alias("sa")), states.select(F.col("stem").alias("b"), F.col("listed").alias("sb"))
    return scenes.twin_counts(pairs.join(a, "a").join(b, "b"), EPSILONS)


def pairs_touching_moves(spark: SparkSession, d: str) -> DataFrame:
    """Listed pairs with at least one end among the stems of moved groups."""
    moved = table(spark, d, "groups_moved").select("group_id").where("group_id is not null").distinct()
    stems = table(spark, d, "images").join(moved, "group_id", "left_semi").select(N.stem("filename").alias("stem")).distinct()
    a, b = stems.select(F.col("stem").alias("a"), F.lit(1).alias("ma")), stems.select(F.col("stem").alias("b"), F.lit(1).alias("mb"))
    touched = _listed_pairs(spark, d).join(a, "a", "left").join(b, "b", "left").where("ma is not null or mb is not null")
    return touched.select("a", "b", (F.coalesce("ma", F.lit(0)) + F.coalesce("mb", F.lit(0))).alias("ends_moved"))


def stem_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of counter-named stems linked by a listed pair of at most 0.05; stems without a link stay on their own."""
    stems = frames.image_frame(table(spark, d, "images")).where("family = 'counter'").select(F.col("stem").alias("id")).distinct()
    links = _listed_pairs(spark, d).where((F.least("raw", "aligned") <= max(EPSILONS)) & ~F.col("low")).select("a", "b")
    inside = links.join(stems.select(F.col("id").alias("a")), "a", "left_semi").join(stems.select(F.col("id").alias("b")), "b", "left_semi")
    return graph.connected_components(stems, inside, Workspace(spark, "stems"))


def family_redundancy(spark: SparkSession, d: str) -> DataFrame:
    """How many counter-named stems are redundant if one of each component stayed."""
    return graph.redundancy(stem_components(spark, d))


def redundancy_by_epsilon(spark: SparkSession, d: str) -> DataFrame:
    """Components and redundancy of the counter-named stems by scoring and epsilon: all settings in one run, each its own copy of the graph."""
    ws = Workspace(spark, "redundancy")
    settings = F.array(*[F.struct(F.lit(k).alias("scoring"), F.lit(e).alias("epsilon")) for k in ("raw", "aligned") for e in EPSILONS])

    def at(stem: str) -> Column:
        return F.struct(F.col("s.scoring").alias("scoring"), F.col("s.epsilon").alias("epsilon"), F.col(stem).alias("stem"))

    stems = ws.keep(frames.image_frame(table(spark, d, "images")).where("family = 'counter' and stem is not null").select("stem").distinct())
    known = {e: stems.select(F.col("stem").alias(e)) for e in "ab"}
    pairs = _listed_pairs(spark, d).where("not low").join(known["a"], "a", "left_semi").join(known["b"], "b", "left_semi").withColumn("s", F.explode(settings))
    near = pairs.where(F.when(F.col("s.scoring") == "raw", F.col("raw")).otherwise(F.col("aligned")) <= F.col("s.epsilon")).select(at("a").alias("a"), at("b").alias("b"))
    found = graph.connected_components(stems.withColumn("s", F.explode(settings)).select(at("stem").alias("id")), near, ws)
    return graph.redundancy(found.select("id.scoring", "id.epsilon", "component"), ["scoring", "epsilon"])


def closest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The five closest listed pairs of each relation between splits."""
    states = _stem_states(spark, d).select("stem", "listed")
    a, b = states.select(F.col("stem").alias("a"), F.col("listed").alias("sa")), states.select(F.col("stem").alias("b"), F.col("listed").alias("sb"))
    joined = _listed_pairs(spark, d).where("not low and raw is not null").join(a, "a").join(b, "b").withColumn("relation", N.relation(F.col("sa"), F.col("sb")))
    order = Window.partitionBy("relation").orderBy("raw", "a", "b")
    ranked = joined.where("relation is not null").withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    return ranked.select("relation", "rank", "raw", "a", "b")


def box_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Shift in thousandths of the picture of every box between the exports of one photograph, classes that occur once."""
    held = frames.box_frame(table(spark, d, "boxes"), table(spark, d, "classes"))
    listed = frames.image_frame(table(spark, d, "images")).select("filename", "image_id", "stem")
    once = held.groupBy("image", "class_id").agg(F.count("*").alias("n"), F.min("cx").alias("cx"), F.min("cy").alias("cy")).where("n = 1")
    known = once.join(listed, once["image"] == listed["filename"]).select("image_id", "stem", "class_id", "cx", "cy")
    a = known.select("stem", "class_id", F.col("image_id").alias("a_image_id"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    b = known.select("stem", "class_id", F.col("image_id").alias("b_image_id"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    dx, dy = 1000 * (F.col("bx") - F.col("ax")), 1000 * (F.col("by") - F.col("ay"))
    pairs = a.join(b, ["stem", "class_id"]).where("a_image_id < b_image_id")
    return pairs.select("a_image_id", "b_image_id", "class_id", F.round(dx, 2).alias("dx"), F.round(dy, 2).alias("dy"), F.round(F.sqrt(dx * dx + dy * dy), 2).alias("shift"))


QUERIES = {
    f.__name__: f
    for f in (
        multiset_buckets, candidate_counts, scene_pairs_scored, scene_metrics_by_epsilon, contamination_three_way, evaluation_twins,
        pairs_touching_moves, stem_components, family_redundancy, redundancy_by_epsilon, closest_pairs, box_shifts, contamination_every_split, evaluation_twins_every_split,
        closest_pairs_every_split,
    )
}

_SIG = f"""WITH {IMG}, {BOX}, runs AS (SELECT image_id, class_id, count(*) AS n FROM box GROUP BY ALL),
  sig AS (SELECT image_id, string_agg(class_id || ':' || n, ',' ORDER BY class_id) AS signature, sum(n)::INT AS n_boxes, max(n) AS most FROM runs GROUP BY image_id),
  bk AS (SELECT signature, count(*) AS n_images, (count(*) * (count(*) - 1) // 2)::BIGINT AS n_pairs, count(*) > {scenes.BUCKET_LIMIT} AS skipped FROM sig GROUP BY signature)"""
_LP = f"""lp AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(CASE WHEN raw_max_dist::VARCHAR <> 'nan' THEN raw_max_dist END) AS raw, min(CASE WHEN aligned_max_dist::VARCHAR <> 'nan' THEN aligned_max_dist END) AS aligned,
    bool_and(coalesce(low_info, n_boxes <= 2, false)) AS low FROM (SELECT *, {S.stem('stem_a')} AS x, {S.stem('stem_b')} AS y FROM scene_pairs) WHERE x <> y GROUP BY 1, 2)"""
_SS = "ss AS (SELECT stem, min(split) AS listed, min(moved_split) AS moved FROM st WHERE stem IS NOT NULL GROUP BY stem)"
_BASE = f"WITH RECURSIVE {STATES}, {_SS}, {_LP}"
_EVERY = f"""WITH {STATES}, {_LP}, sl AS (SELECT stem, 'listed' AS state, split AS s FROM st WHERE stem IS NOT NULL UNION SELECT stem, 'moved', moved_split FROM st WHERE stem IS NOT NULL),
  jn AS (SELECT p.state, raw, aligned, low, a, b, p.s AS sa, q.s AS sb FROM lp JOIN sl p ON p.stem = a JOIN sl q ON q.stem = b AND q.state = p.state)"""
_COMP = _BASE + f""", v AS (SELECT DISTINCT stem AS id FROM img WHERE family = 'counter' AND stem IS NOT NULL),
  e AS (SELECT a, b FROM lp WHERE least(raw, aligned) <= 0.05 AND NOT low AND a IN (SELECT id FROM v) AND b IN (SELECT id FROM v)),
  w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(id, other) AS (SELECT id, id FROM v UNION SELECT r.id, w.b FROM r JOIN w ON w.a = r.other), comp AS (SELECT id, min(other) AS component FROM r GROUP BY id)"""

# the greedy matching: a fold over the pairs of boxes, nearest first, that takes a pair if neither box is taken
_FOLD = """list_reduce({0}, lambda t, e: CASE WHEN (t.ui >> e.i) & 1 = 0 AND (t.uj >> e.j) & 1 = 0 THEN {{'ui': t.ui | (1::BIGINT << e.i), 'uj': t.uj | (1::BIGINT << e.j), 'm': greatest(t.m, e.d), 't': t.t + e.d, 'o': t.o + e.o}} ELSE t END,
    {{'ui': 0::BIGINT, 'uj': 0::BIGINT, 'm': 0::DOUBLE, 't': 0::DOUBLE, 'o': 0::DOUBLE}})"""
_OVERLAP = "greatest(0, least(x.cx + x.w / 2, y.cx + y.w / 2) - greatest(x.cx - x.w / 2, y.cx - y.w / 2)) * greatest(0, least(x.cy + x.h / 2, y.cy + y.h / 2) - greatest(x.cy - x.h / 2, y.cy - y.h / 2))"
_SCORED = _SIG.replace("WITH ", "", 1).removeprefix(f"{IMG}, ") + f""", pb AS (SELECT image_id, class_id, cx, cy, w, h, (row_number() OVER (PARTITION BY image_id ORDER BY class_id, cx, cy, w, h) - 1)::INT AS i,
    cx - avg(cx) OVER (PARTITION BY image_id) AS sx, cy - avg(cy) OVER (PARTITION BY image_id) AS sy FROM box),
  ed AS (SELECT p.image_id AS a, q.image_id AS b, p.n_boxes, x.i, y.i AS j, sqrt((x.cx - y.cx) * (x.cx - y.cx) + (x.cy - y.cy) * (x.cy - y.cy)) AS d, sqrt((x.sx - y.sx) * (x.sx - y.sx) + (x.sy - y.sy) * (x.sy - y.sy)) AS s,
    {_OVERLAP} AS common, x.w * x.h + y.w * y.h AS area FROM sig p JOIN sig q ON p.signature = q.signature AND p.image_id < q.image_id JOIN pb x ON x.image_id = p.image_id JOIN pb y ON y.image_id = q.image_id AND y.class_id = x.class_id),
  li AS (SELECT a, b, n_boxes, list({{'d': d, 'i': i, 'j': j, 'o': common / (area - common)}} ORDER BY d, i, j) AS r, list({{'d': s, 'i': i, 'j': j, 'o': 0::DOUBLE}} ORDER BY s, i, j) AS l FROM ed GROUP BY ALL),
  rd AS (SELECT a, b, n_boxes, {_FOLD.format('r')} AS p, {_FOLD.format('l')} AS q FROM li),
  scored AS (SELECT a AS a_image_id, b AS b_image_id, n_boxes, round(p.m, 5) AS raw_max_dist, round(p.t / n_boxes, 5) AS raw_mean_dist, round(q.m, 5) AS aligned_max_dist, round(p.o / n_boxes, 5) AS mean_iou, n_boxes <= 2 AS low_info
    FROM rd WHERE least(p.m, q.m) <= 0.05)"""

ORACLES = {
    "multiset_buckets": _SIG + " SELECT * FROM bk WHERE n_images > 1",
    "candidate_counts": _SIG
    + """ SELECT count(*) AS n_buckets, count(*) FILTER (WHERE n_images > 1) AS shared_buckets, coalesce(sum(n_pairs) FILTER (WHERE NOT skipped), 0)::BIGINT AS pairs, coalesce(sum(n_pairs) FILTER (WHERE skipped), 0)::BIGINT AS skipped_pairs,
  (sum(n_images) * (sum(n_images) - 1) / 2)::BIGINT AS all_pairs FROM bk""",
    "scene_pairs_scored": f"WITH {IMG}, {_SCORED}" + " SELECT * FROM scored",
    "scene_metrics_by_epsilon": f"WITH {STATES}, {_SCORED}, g AS (SELECT s.state, k.scoring, e.epsilon, x.excl_low, CASE s.state WHEN 'listed' THEN p.split ELSE p.moved_split END AS sa, CASE s.state WHEN 'listed' THEN q.split ELSE q.moved_split END AS sb"
    + """
  FROM scored JOIN st p ON p.image_id = a_image_id JOIN st q ON q.image_id = b_image_id, (VALUES ('listed'), ('moved')) s(state), (VALUES ('raw'), ('aligned')) k(scoring), (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) e(epsilon), (VALUES (false), (true)) x(excl_low)
  WHERE CASE k.scoring WHEN 'raw' THEN raw_max_dist ELSE aligned_max_dist END <= e.epsilon AND NOT (x.excl_low AND low_info))
SELECT state, scoring, epsilon, excl_low, count(*) AS pairs, count(*) FILTER (WHERE sa <> sb) AS "cross", """
    + ", ".join(f"count(*) FILTER (WHERE least(sa, sb) = '{min(a, b)}' AND greatest(sa, sb) = '{max(a, b)}') AS {a}_{b}" for a, b in (("test", "train"), ("valid", "train"), ("test", "valid")))
    + " FROM g GROUP BY ALL",
    "contamination_three_way": _BASE
    + """, g AS (SELECT s.state, k.scoring, e.epsilon, x.excl_low, CASE s.state WHEN 'listed' THEN p.listed ELSE p.moved END AS sa, CASE s.state WHEN 'listed' THEN q.listed ELSE q.moved END AS sb
  FROM lp JOIN ss p ON p.stem = lp.a JOIN ss q ON q.stem = lp.b, (VALUES ('listed'), ('moved')) s(state), (VALUES ('raw'), ('aligned')) k(scoring), (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) e(epsilon), (VALUES (false), (true)) x(excl_low)
  WHERE CASE k.scoring WHEN 'raw' THEN raw ELSE aligned END <= e.epsilon AND NOT (x.excl_low AND low))
SELECT state, scoring, epsilon, excl_low, count(*) AS pairs, count(*) FILTER (WHERE sa <> sb) AS cross, """.replace("AS cross", 'AS "cross"')
    + ", ".join(f"count(*) FILTER (WHERE least(sa, sb) = '{min(a, b)}' AND greatest(sa, sb) = '{max(a, b)}') AS {a}_{b}" for a, b in (("test", "train"), ("valid", "train"), ("test", "valid")))
    + " FROM g GROUP BY ALL",
    "evaluation_twins": _BASE
    + """, t AS (SELECT a AS s, p.listed AS own, q.listed AS other, least(raw, aligned) AS d FROM lp JOIN ss p ON p.stem = a JOIN ss q ON q.stem = b WHERE NOT low
  UNION ALL SELECT b, q.listed, p.listed, least(raw, aligned) FROM lp JOIN ss p ON p.stem = a JOIN ss q ON q.stem = b WHERE NOT low)
SELECT epsilon, count(DISTINCT s) FILTER (WHERE own = 'test') AS test_twins, count(DISTINCT s) FILTER (WHERE own = 'valid') AS valid_twins FROM t, (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) e(epsilon)
WHERE other = 'train' AND own IN ('test', 'valid') AND d <= epsilon GROUP BY epsilon""",
    "contamination_every_split": _EVERY
    + """, rel AS (SELECT state, a, b, raw, aligned, low, coalesce(bool_or(sa <> sb), false) AS x, """
    + ", ".join(f"coalesce(bool_or((sa = '{a}' AND sb = '{b}') OR (sa = '{b}' AND sb = '{a}')), false) AS {a}_{b}" for a, b in (("test", "train"), ("valid", "train"), ("test", "valid")))
    + """ FROM jn GROUP BY ALL)
SELECT state, k.scoring, e.epsilon, f.excl_low, count(*) AS pairs, count(*) FILTER (WHERE x) AS "cross", count(*) FILTER (WHERE test_train) AS test_train, count(*) FILTER (WHERE valid_train) AS valid_train, count(*) FILTER (WHERE test_valid) AS test_valid
FROM rel, (VALUES ('raw'), ('aligned')) k(scoring), (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) e(epsilon), (VALUES (false), (true)) f(excl_low)
WHERE CASE k.scoring WHEN 'raw' THEN raw ELSE aligned END <= e.epsilon AND NOT (f.excl_low AND low) GROUP BY ALL""",
    "evaluation_twins_every_split": _EVERY
    + """, t AS (SELECT a AS s, sa AS own, sb AS other, least(raw, aligned) AS d FROM jn WHERE state = 'listed' AND NOT low UNION ALL SELECT b, sb, sa, least(raw, aligned) FROM jn WHERE state = 'listed' AND NOT low)
SELECT epsilon, count(DISTINCT s) FILTER (WHERE own = 'test') AS test_twins, count(DISTINCT s) FILTER (WHERE own = 'valid') AS valid_twins FROM t, (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) e(epsilon)
WHERE other = 'train' AND own IN ('test', 'valid') AND d <= epsilon GROUP BY epsilon""",
    "closest_pairs_every_split": _EVERY
    + """ SELECT relation, rank::INT AS rank, raw, a, b FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY raw, a, b) AS rank FROM (
  SELECT DISTINCT least(sa, sb) || '<->' || greatest(sa, sb) AS relation, raw, a, b FROM jn WHERE state = 'listed' AND NOT low AND raw IS NOT NULL AND sa <> sb)) WHERE rank <= 5""",
    "pairs_touching_moves": f"WITH {_LP}, m AS (SELECT DISTINCT {S.stem('filename')} AS s FROM images WHERE group_id IN (SELECT group_id FROM groups_moved))"
    + " SELECT a, b, (a IN (SELECT s FROM m))::INT + (b IN (SELECT s FROM m))::INT AS ends_moved FROM lp WHERE a IN (SELECT s FROM m) OR b IN (SELECT s FROM m)",
    "stem_components": _COMP + " SELECT * FROM comp",
    "family_redundancy": _COMP
    + """ SELECT coalesce(sum(s), 0)::BIGINT AS n, count(*) AS components, count(*) FILTER (WHERE s > 1) AS multi, coalesce(max(s), 0) AS largest, (coalesce(sum(s), 0) - count(*))::BIGINT AS redundant
FROM (SELECT count(*) AS s FROM comp GROUP BY component)""",
    "redundancy_by_epsilon": f"""WITH RECURSIVE {STATES}, {_LP}, g(scoring, epsilon) AS (SELECT * FROM (VALUES ('raw'), ('aligned')) k(scoring), (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) e(epsilon)),
  v AS (SELECT DISTINCT stem AS id FROM img WHERE family = 'counter' AND stem IS NOT NULL),
  e AS (SELECT scoring, epsilon, a, b FROM lp, g WHERE CASE scoring WHEN 'raw' THEN raw ELSE aligned END <= epsilon AND NOT low AND a IN (SELECT id FROM v) AND b IN (SELECT id FROM v)),
  w AS (SELECT * FROM e UNION SELECT scoring, epsilon, b, a FROM e),
  r(scoring, epsilon, id, other) AS (SELECT scoring, epsilon, id, id FROM v, g UNION SELECT r.scoring, r.epsilon, r.id, w.b FROM r JOIN w ON w.a = r.other AND w.scoring = r.scoring AND w.epsilon = r.epsilon),
  c AS (SELECT scoring, epsilon, id, min(other) AS component FROM r GROUP BY ALL)
SELECT scoring, epsilon, sum(s)::BIGINT AS n, count(*) AS components, count(*) FILTER (WHERE s > 1) AS multi, max(s) AS largest, (sum(s) - count(*))::BIGINT AS redundant
FROM (SELECT scoring, epsilon, component, count(*) AS s FROM c GROUP BY ALL) GROUP BY ALL""",
    "closest_pairs": _BASE
    + """ SELECT relation, rank::INT AS rank, raw, a, b FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY raw, a, b) AS rank FROM (
  SELECT least(p.listed, q.listed) || '<->' || greatest(p.listed, q.listed) AS relation, raw, a, b FROM lp JOIN ss p ON p.stem = a JOIN ss q ON q.stem = b WHERE NOT low AND raw IS NOT NULL AND p.listed <> q.listed)) WHERE rank <= 5""",
    "box_shifts": f"""WITH {IMG}, {BOX}, o AS (SELECT image_id, img.stem AS stem, class_id, min(cx) AS x, min(cy) AS y FROM box JOIN img USING (image_id) GROUP BY ALL HAVING count(*) = 1)
SELECT a.image_id AS a_image_id, b.image_id AS b_image_id, a.class_id, round(1000 * (b.x - a.x), 2) AS dx, round(1000 * (b.y - a.y), 2) AS dy,
  round(sqrt((1000 * (b.x - a.x)) * (1000 * (b.x - a.x)) + (1000 * (b.y - a.y)) * (1000 * (b.y - a.y))), 2) AS shift FROM o a JOIN o b ON a.stem = b.stem AND a.class_id = b.class_id AND a.image_id < b.image_id""",
}
