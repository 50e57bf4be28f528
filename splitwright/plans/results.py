"""Repeatability, fronts, ranks, curves and expectations over the driver's star schema and the published summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import copies, expectations as X, frames, results as R
from ..session import Workspace
from ..sources.tables import table
from . import sqltext as S
from .data_problems import _MERGED
from .splits import _VALID, BOX
from .timeline import IMG

def _curve(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a run and its lines as steps: two metrics, and two losses that are NaN on some lines and missing on others."""
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.max(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity", "l_extendedprice")]
    )
    return one.select(
        F.col("l_orderkey").alias("run"),
        F.col("l_linenumber").alias("epoch"),
        F.col("l_discount").alias("map50"),
        F.col("l_tax").alias("map95"),
        F.when(F.col("l_returnflag") == "R", nan).when(F.col("l_returnflag") == "A", none).otherwise(F.col("l_quantity").cast("double")).alias("train_loss"),
        F.when(F.col("l_linestatus") == "O", nan).otherwise(F.col("l_extendedprice").cast("double")).alias("val_loss"),
    )


def pair_gap_repeatability(spark: SparkSession, d: str) -> DataFrame:
    """Order lines listed exactly twice, as two runs of one measurement; other multiplicities are warnings."""
    return R.pair_gaps(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice")


def repeatability_floor(spark: SparkSession, d: str) -> DataFrame:
    """The largest gap of a pair by each of the three denominators."""
    g = pair_gap_repeatability(spark, d)
    return g.groupBy("verdict").agg(F.count("*").alias("n_groups"), F.max("gap").alias("max_gap"), *[F.max(f"pct_of_{x}").alias(f"max_pct_of_{x}") for x in ("mean", "max", "min")])


def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders that no other beats: earlier date and higher price."""
    orders = table(spark, d, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"), "o_totalprice")
    return R.pareto_front(orders, "o_orderkey", "day", "o_totalprice", Workspace(spark, "front"))


def rank_change(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose rank by revenue of returned lines differs from their rank by revenue of all lines."""
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("all_cents"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.round(F.col("l_extendedprice") * 100).cast("long")).otherwise(0)).alias("returned_cents"),
    )
    ws = Workspace(spark, "ranks")
    one = R.global_ranks(lines, [-F.col("all_cents")], "l_suppkey", ws, "rank_all")
    two = R.global_ranks(lines, [-F.col("returned_cents")], "l_suppkey", ws, "rank_returned")
    return one.join(two, "l_suppkey").where("rank_all <> rank_returned").select("l_suppkey", "rank_all", "rank_returned", (F.col("rank_all") - F.col("rank_returned")).alias("change"))


def nan_onset(spark: SparkSession, d: str) -> DataFrame:
    """The epoch at which each column of a curve turns NaN, and where it recovers."""
    return R.nan_onset(_curve(spark, d), "run", "epoch", ["train_loss", "val_loss"])


def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The epoch of the best fitness, 0.1 map50 + 0.9 map95."""
    return R.best_step(_curve(spark, d), "run", "epoch", {"map50": 0.1, "map95": 0.9})


def unanimous_fields(spark: SparkSession, d: str) -> DataFrame:
    """For each device of the first manifest whether its rows agree on background and split."""
    rows = frames.manifest_frame(table(spark, d, "manifest_v1"), "v1_split").where("device is not null")
    return R.unanimity(rows, "device", ["background", "claimed"])


def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Whether orders and order lines have the same keys, as a join that must lose nothing would need."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return R.key_sets_equal(orders, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


def unjoined_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders without a line by status; for status P that is allowed, for others it is reported."""
    orders = table(spark, d, "orders")
    lone = orders.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")
    return lone.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("verdict", F.when(F.col("o_orderstatus") == "P", "allowed").otherwise("missing"))


def box_count_interval(spark: SparkSession, d: str) -> DataFrame:
    """Whether an image's number of valid boxes lies between the numbers the two copies give."""
    held = frames.box_frame(table(spark, d, "boxes"), table(spark, d, "classes")).groupBy(F.col("image").alias("filename")).agg(F.count("*").alias("n"))
    counted = frames.image_frame(table(spark, d, "images")).select("stem", "filename").join(held, "filename").groupBy("stem").agg(F.max("n").alias("n"))
    both = copies.merged_manifests(table(spark, d, "manifest_v1"), table(spark, d, "manifest_v2")).where("in_left and in_right")
    inside = R.within_interval(F.col("n").cast("double"), F.col("l.n_boxes"), F.col("r.n_boxes"))
    return both.join(counted, "stem").groupBy(F.coalesce(inside.cast("string"), F.lit("unanswerable")).alias("inside")).agg(F.count("*").alias("n_stems"))


def area_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Stems by whether the two copies' mean areas agree within 0.0001."""
    both = copies.merged_manifests(table(spark, d, "manifest_v1"), table(spark, d, "manifest_v2")).where("in_left and in_right")
    verdict = F.when(F.col("l.mean_area").isNull() | F.col("r.mean_area").isNull(), "unanswerable").when(copies.differs(F.col("l.mean_area"), F.col("r.mean_area"), 0.0001), "FAIL").otherwise("PASS")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_stems"))


def published_summary_checks(spark: SparkSession, d: str) -> DataFrame:
    """The published summary against itself: parts add up to the whole, the percentage is the parts', keys are unique."""
    told = table(spark, d, "split_by_group").withColumn("device", N.device_key("device_name"))
    pct = F.abs(F.col("pct_changed") - 100 * F.col("imgs_changed_split") / F.col("imgs_in_csv")) <= 0.051
    return X.report(
        [
            X.checks(
                told,
                {
                    "parts add up": F.col("imgs_changed_split") + F.col("imgs_unchanged") == F.col("imgs_in_csv"),
                    "percentage fits": pct,
                    "group is a date": F.col("capture_group").rlike(r"\A\d{8}\z"),
                },
            ),
            X.unique(told, ["capture_group", "device"], "one row a group and device"),
        ]
    )


def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Published numbers of each group and device beside the counted ones, where they differ."""
    v1, v2 = table(spark, d, "manifest_v1"), table(spark, d, "manifest_v2")
    counted = copies.changed_by_group(v1, v2).select("capture_group", "device", "in_both", "changed")
    told = table(spark, d, "split_by_group").select(N.strip("capture_group").alias("capture_group"), N.device_key("device_name").alias("device"), "imgs_in_csv", "imgs_changed_split")
    joined = told.join(counted, ["capture_group", "device"], "left")
    n, c = F.coalesce("in_both", F.lit(0)), F.coalesce("changed", F.lit(0))
    return joined.where((n != F.col("imgs_in_csv")) | (c != F.col("imgs_changed_split"))).select("capture_group", "device", "imgs_in_csv", n.alias("counted"), "imgs_changed_split", c.alias("counted_changed"))


#: Expected facts, some wrong on purpose: each verdict occurs.
EXPECTED = [
    ("nations of Africa", "AFRICA", "n_nations", "5", None),
    ("near enough", "ASIA", "n_nations", "5.4", 0.5),
    ("too far off", "ASIA", "n_nations", "7", 1.0),
    ("text", "EUROPE", "first_nation", "NATION_13", None),
    ("unknown region", "ATLANTIS", "n_nations", "0", None),
    ("unknown column", "EUROPE", "n_rivers", "3", None),
]


def expectation_check(spark: SparkSession, d: str) -> DataFrame:
    """Expectations held against facts on the regions."""
    regions = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    per = regions.groupBy("r_name").agg(F.count("*").alias("n_nations"), F.min("n_name").alias("first_nation"))
    return X.verify(X.expectation_rows(spark, EXPECTED), X.facts(per, "r_name", ["n_nations", "first_nation"])).select("label", "found", "verdict")


def classes_only_in_test(spark: SparkSession, d: str) -> DataFrame:
    """For each device the classes its test images have and its valid images lack, and the other way round."""
    held = frames.box_frame(table(spark, d, "boxes"), table(spark, d, "classes")).select("image", "class_id").distinct()
    images = frames.image_frame(table(spark, d, "images")).where("device is not null").select("filename", "device", "split")
    per = held.join(images, held["image"] == images["filename"]).groupBy("device").agg(
        *[F.collect_set(F.when(F.col("split") == s, F.col("class_id"))).alias(s) for s in ("test", "valid")]  # at most one entry a class
    )
    return per.select("device", F.size(F.array_except("test", "valid")).alias("only_test"), F.size(F.array_except("valid", "test")).alias("only_valid"))


def closest_account_balances(spark: SparkSession, d: str) -> DataFrame:
    """The three pairs of customers whose balances lie closest to each other without being equal."""
    per = table(spark, d, "customer").groupBy("c_acctbal").agg(F.min("c_custkey").alias("c_custkey"))
    return R.closest_neighbours(per, "c_acctbal", "c_custkey", Workspace(spark, "closest"), 3)


def box_reduction(spark: SparkSession, d: str) -> DataFrame:
    """By how much cleaning reduces the boxes of each class: all rows against distinct valid ones."""
    raw = table(spark, d, "boxes").where("image is not null").groupBy("class_id").agg(F.count("*").alias("n_raw"))
    kept = frames.box_frame(table(spark, d, "boxes"), table(spark, d, "classes")).groupBy("class_id").agg(F.count("*").alias("n_valid"))
    both = raw.join(kept, "class_id")
    return both.select("class_id", "n_raw", "n_valid", R.reduction_percent(F.col("n_raw"), F.col("n_valid")).alias("reduction_pct"))


QUERIES = {
    f.__name__: f
    for f in (
        pair_gap_repeatability, repeatability_floor, pareto_front, rank_change, nan_onset, best_epoch, unanimous_fields, key_sets, unjoined_orders, box_count_interval,
        area_agreement, published_summary_checks, reconcile_summary, expectation_check, classes_only_in_test, closest_account_balances, box_reduction,
    )
}

_GAPS = """WITH g AS (SELECT l_orderkey, l_linenumber, count(l_extendedprice) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL),
  p AS (SELECT l_orderkey, l_linenumber, n, CASE WHEN n = 2 THEN round((hi + lo) / 2, 6) END AS mean, CASE WHEN n = 2 THEN round(hi - lo, 6) END AS gap, CASE WHEN n = 2 AND hi + lo > 0 THEN round(100 * (hi - lo) / ((hi + lo) / 2), 4) END AS pct_of_mean,
  CASE WHEN n = 2 AND hi > 0 THEN round(100 * (hi - lo) / hi, 4) END AS pct_of_max, CASE WHEN n = 2 AND lo > 0 THEN round(100 * (hi - lo) / lo, 4) END AS pct_of_min, CASE WHEN n = 2 THEN 'pair' ELSE 'warning' END AS verdict FROM g)"""
_CURVE = """WITH l AS (SELECT l_orderkey AS run, l_linenumber AS epoch, max(l_returnflag) AS f, max(l_linestatus) AS s, max(l_discount) AS map50, max(l_tax) AS map95, max(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
  c AS (SELECT run, epoch, map50, map95, CASE f WHEN 'R' THEN 'nan'::DOUBLE WHEN 'A' THEN NULL ELSE q END AS train_loss, CASE s WHEN 'O' THEN 'nan'::DOUBLE ELSE p END AS val_loss FROM l)"""
ORACLES = {
    "closest_account_balances": """WITH p AS (SELECT c_acctbal, min(c_custkey) AS k FROM customer GROUP BY 1), n AS (SELECT lag(k) OVER w AS a, k AS b, c_acctbal - lag(c_acctbal) OVER w AS gap, c_acctbal FROM p WINDOW w AS (ORDER BY c_acctbal, k))
SELECT a, b, round(gap, 6) AS gap FROM n WHERE a IS NOT NULL ORDER BY n.gap, c_acctbal, a, b LIMIT 3""",
    "box_reduction": f"""WITH {IMG}, r AS (SELECT class_id, count(*) AS n_raw FROM boxes WHERE image IS NOT NULL GROUP BY 1), v AS (SELECT class_id, count(*) AS n_valid FROM (SELECT DISTINCT b.* FROM boxes b JOIN classes USING (class_id) WHERE {_VALID}) GROUP BY 1)
SELECT class_id, n_raw, n_valid, round(100.0::DOUBLE * (n_raw - n_valid) / n_raw, 4) AS reduction_pct FROM r JOIN v USING (class_id)""",
    "pair_gap_repeatability": _GAPS + " SELECT * FROM p",
    "repeatability_floor": _GAPS + " SELECT verdict, count(*) AS n_groups, max(gap) AS max_gap, max(pct_of_mean) AS max_pct_of_mean, max(pct_of_max) AS max_pct_of_max, max(pct_of_min) AS max_pct_of_min FROM p GROUP BY verdict",
    "pareto_front": """WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS day, o_totalprice FROM orders),
  b AS (SELECT day, max(o_totalprice) AS best FROM o GROUP BY day), s AS (SELECT day, best, max(best) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM b)
SELECT o_orderkey, o.day, o_totalprice FROM o JOIN s ON s.day = o.day AND s.best = o.o_totalprice WHERE so_far IS NULL OR best > so_far""",
    "rank_change": """WITH l AS (SELECT l_suppkey, sum(round(l_extendedprice * 100)::BIGINT) AS a, sum(CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END) AS b FROM lineitem GROUP BY 1),
  r AS (SELECT l_suppkey, row_number() OVER (ORDER BY a DESC, l_suppkey) AS rank_all, row_number() OVER (ORDER BY b DESC, l_suppkey) AS rank_returned FROM l)
SELECT *, rank_all - rank_returned AS change FROM r WHERE rank_all <> rank_returned""",
    "nan_onset": _CURVE
    + """, u AS (SELECT run, epoch, 'train_loss' AS "column", train_loss AS v FROM c UNION ALL SELECT run, epoch, 'val_loss', val_loss FROM c),
  f AS (SELECT run, "column", min(epoch) FILTER (WHERE isnan(v)) AS first_nan, count(*) FILTER (WHERE isnan(v)) AS n_nan FROM u GROUP BY ALL)
SELECT f.run, f."column", first_nan, n_nan, coalesce(string_agg(epoch::VARCHAR, '|' ORDER BY epoch) FILTER (WHERE NOT isnan(v) AND epoch > first_nan), '') AS recovered
FROM f JOIN u ON u.run = f.run AND u."column" = f."column" GROUP BY ALL""",
    "best_epoch": _CURVE
    + """, s AS (SELECT run, epoch, 0.0::DOUBLE + map50 * 0.1::DOUBLE + map95 * 0.9::DOUBLE AS fit FROM c) SELECT run, epoch AS best_step, round(fit, 6) AS fitness FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY fit DESC, epoch) AS k FROM s) WHERE k = 1""",
    "unanimous_fields": f"""WITH {S.manifest('v1', 'manifest_v1', 'v1_split')}, m AS (SELECT * FROM v1 WHERE device IS NOT NULL), u AS (SELECT DISTINCT device, 'background' AS field, background AS v FROM m WHERE background IS NOT NULL UNION SELECT device, 'claimed', claimed FROM m WHERE claimed IS NOT NULL)
SELECT device, field, count(*) AS n_values, CASE WHEN count(*) = 1 THEN min(v) END AS only_value FROM u GROUP BY ALL""",
    "key_sets": """WITH n AS (SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS only_left, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS only_right)
SELECT *, only_left = 0 AND only_right = 0 AS equal FROM n""",
    "unjoined_orders": """SELECT o_orderstatus, count(*) AS n, CASE WHEN o_orderstatus = 'P' THEN 'allowed' ELSE 'missing' END AS verdict FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""",
    "box_count_interval": _MERGED.replace("WITH m AS", f"WITH {IMG}, {BOX}, cnt AS (SELECT stem, max(n)::DOUBLE AS n FROM (SELECT img.stem AS stem, image, count(*) AS n FROM box JOIN img USING (image_id) GROUP BY ALL) GROUP BY stem), m AS", 1)
    + "SELECT coalesce((n BETWEEN least(l.n_boxes, r.n_boxes) AND greatest(l.n_boxes, r.n_boxes))::VARCHAR, 'unanswerable') AS inside, count(*) AS n_stems FROM m JOIN cnt USING (stem) WHERE in1 AND in2 GROUP BY 1",
    "area_agreement": _MERGED
    + "SELECT CASE WHEN l.mean_area IS NULL OR r.mean_area IS NULL THEN 'unanswerable' WHEN round(abs(l.mean_area - r.mean_area), 10) > 0.0001 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS n_stems FROM m WHERE in1 AND in2 GROUP BY 1",
    "published_summary_checks": f"""WITH g AS (SELECT *, {S.device('device_name')} AS device FROM split_by_group), n AS (
  SELECT 'parts add up' AS "check", count(*) FILTER (WHERE NOT coalesce(imgs_changed_split + imgs_unchanged = imgs_in_csv, false)) AS violations FROM g
  UNION ALL SELECT 'percentage fits', count(*) FILTER (WHERE NOT coalesce(abs(pct_changed - 100 * imgs_changed_split::DOUBLE / imgs_in_csv) <= 0.051, false)) FROM g
  UNION ALL SELECT 'group is a date', count(*) FILTER (WHERE NOT coalesce(regexp_full_match(capture_group, '\\d{{8}}'), false)) FROM g
  UNION ALL SELECT 'one row a group and device', count(*) FROM (SELECT 1 FROM g GROUP BY capture_group, device HAVING count(*) > 1))
SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM n""",
    "reconcile_summary": _MERGED
    + f""", k AS (SELECT l.capture_group AS cg, l.device AS dev, count(*) AS n, count(*) FILTER (WHERE l.split IS DISTINCT FROM r.split) AS c FROM m WHERE in1 AND in2 GROUP BY 1, 2),
  t AS (SELECT {S.strip('capture_group')} AS capture_group, {S.device('device_name')} AS device, imgs_in_csv, imgs_changed_split FROM split_by_group)
SELECT capture_group, device, imgs_in_csv, coalesce(n, 0) AS counted, imgs_changed_split, coalesce(c, 0) AS counted_changed FROM t LEFT JOIN k ON cg = capture_group AND dev = device WHERE coalesce(n, 0) <> imgs_in_csv OR coalesce(c, 0) <> imgs_changed_split""",
    "expectation_check": """WITH p AS (SELECT r_name, count(*) AS n, min(n_name) AS f FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
SELECT 'nations of Africa' AS label, (SELECT n::VARCHAR FROM p WHERE r_name = 'AFRICA') AS found, CASE WHEN (SELECT n FROM p WHERE r_name = 'AFRICA') = 5 THEN 'PASS' ELSE 'FAIL' END AS verdict
UNION ALL SELECT 'near enough', (SELECT n::VARCHAR FROM p WHERE r_name = 'ASIA'), CASE WHEN abs((SELECT n FROM p WHERE r_name = 'ASIA') - 5.4) <= 0.5 THEN 'PASS' ELSE 'FAIL' END
UNION ALL SELECT 'too far off', (SELECT n::VARCHAR FROM p WHERE r_name = 'ASIA'), CASE WHEN abs((SELECT n FROM p WHERE r_name = 'ASIA') - 7) <= 1 THEN 'PASS' ELSE 'FAIL' END
UNION ALL SELECT 'text', (SELECT f FROM p WHERE r_name = 'EUROPE'), CASE WHEN (SELECT f FROM p WHERE r_name = 'EUROPE') = 'NATION_13' THEN 'PASS' ELSE 'FAIL' END
UNION ALL SELECT 'unknown region', NULL, 'NO ROW' UNION ALL SELECT 'unknown column', NULL, 'NO COLUMN'""",
    "classes_only_in_test": f"""WITH {IMG}, {BOX}, x AS (SELECT DISTINCT img.device AS device, box.split AS split, class_id FROM box JOIN img USING (image_id) WHERE img.device IS NOT NULL),
  p AS (SELECT device, coalesce(list(class_id) FILTER (WHERE split = 'test'), []) AS t, coalesce(list(class_id) FILTER (WHERE split = 'valid'), []) AS v FROM x GROUP BY device)
SELECT device, len(list_filter(t, lambda k: NOT list_contains(v, k)))::INT AS only_test, len(list_filter(v, lambda k: NOT list_contains(t, k)))::INT AS only_valid FROM p""",
}
