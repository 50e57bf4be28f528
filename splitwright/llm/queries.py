"""The subpackage's named queries: name -> (spark, folder) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import Workspace
from ..sources.tables import table
from . import encode, keep_together, language, overlap, pack
from .components import scene_components
from .oracles import ORACLES


def _components(spark: SparkSession, d: str) -> DataFrame:
    return scene_components(table(spark, d, "scene_pairs"), table(spark, d, "components"), Workspace(spark, "p1"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of every component of two or more stems at each epsilon."""
    return _components(spark, d).select("epsilon", "component_id", "stem")


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many components of each size there are at each epsilon."""
    per = _components(spark, d).groupBy("epsilon", "component_id").agg(F.count("*").alias("component_size"))
    return per.groupBy("epsilon", "component_size").agg(F.count("*").alias("n_components"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    tables = [table(spark, d, t) for t in ("images", "boxes", "classes", "scene_pairs")]
    return overlap.cross_split_overlaps(*tables, Workspace(spark, "p3"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train image and a valid or test image of the same or nearly the same scene."""
    return _overlaps(spark, d).select(F.least("image_t", "image_e").alias("image_a"), F.greatest("image_t", "image_e").alias("image_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation images counted by split, device and reason."""
    return overlap.overlap_report(_overlaps(spark, d), table(spark, d, "images"))


def _least_first(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("image_t", "image_e").alias("image_a"), F.greatest("image_t", "image_e").alias("image_b"), "score").distinct()


def p3_stems(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p3_found that share a stem."""
    return _least_first(overlap.same_stem(overlap.image_sides(table(spark, d, "images"))))


def p3_listed(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p3_found that the earlier scorer listed."""
    return _least_first(overlap.listed_overlaps(overlap.image_sides(table(spark, d, "images")), table(spark, d, "scene_pairs")))


def _records(spark: SparkSession, d: str, ws: Workspace) -> DataFrame:
    return ws.keep(overlap.box_records(overlap.image_sides(table(spark, d, "images")), table(spark, d, "boxes"), table(spark, d, "classes")))


def p3_scenes(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p3_found whose boxes are near-same, with their score and the share of their chunks they have in common."""
    ws = Workspace(spark, "p3")
    return overlap.scene_overlaps(_records(spark, d, ws), ws=ws).distinct()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row an image of six or more boxes: its class of copies, and with how many images of the other side it is near-same."""
    ws = Workspace(spark, "p3")
    return overlap.class_links(_records(spark, d, ws), ws)


def _plan(spark: SparkSession, d: str) -> keep_together.SplitPlan:
    return keep_together.plan_splits(table(spark, d, "images"), table(spark, d, "groups_moved"), Workspace(spark, "p4"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups that the present state of the splits tears apart, out of the plan that mends them."""
    return _plan(spark, d).groups.where("torn").select("group_id")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Where the plan puts each group, in the columns of groups_moved."""
    return _plan(spark, d).groups.select("group_id", "split", "n_images")


def p4_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The split the plan gives each image."""
    return _plan(spark, d).assignment.select("image_id", "split")


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    """Images of each name family in each split of the plan, and the family's share there."""
    families = table(spark, d, "images").where("image_id is not null").groupBy("image_id").agg(F.min("family").alias("family"))
    n = _plan(spark, d).assignment.join(families, "image_id").groupBy("family", "split").agg(F.count("*").alias("n_images"))
    # a few families by three splits
    total = F.sum("n_images").over(Window.partitionBy("family"))
    return n.select("family", "split", "n_images", F.round(F.col("n_images") / total, 4).alias("share"))


def p4_together(spark: SparkSession, d: str) -> DataFrame:
    """Of the groups and of the stems: how many there are, and how many the plan has in more than one split."""
    at = _plan(spark, d).assignment.select("image_id", "split")
    images = table(spark, d, "images").where("image_id is not null").select("image_id", F.col("group_id").cast("string").alias("group"), N.stem("filename").alias("stem"))
    out = None
    for kind in ("group", "stem"):
        per = images.where(F.col(kind).isNotNull()).join(at, "image_id").groupBy(kind).agg(F.count_distinct("split").alias("k"), F.count_distinct("image_id").alias("n"))
        one = per.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_if(F.col("k") != 1).alias("n_torn"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_images"))
        out = one if out is None else out.unionByName(one)
    return out


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Images the shares want in each split, and whether the plan has as many, give or take one."""
    at = _plan(spark, d).assignment
    n = at.groupBy("split").agg(F.count("*").alias("n"))
    total = at.count()
    wanted = spark.createDataFrame([(s, p * total) for s, p in keep_together.SHARES.items()], "split string, want double")
    both = wanted.join(n, "split", "left").select("split", "want", F.coalesce("n", F.lit(0)).alias("n"))
    return both.select("split", F.round("want", 1).alias("wanted"), (F.abs(F.col("n") - F.col("want")) <= 1).alias("met"))


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    """Images of each name family, and whether the plan's excess of it over the shares, in all splits together, is at most a hundredth or ten images."""
    families = table(spark, d, "images").where("image_id is not null").groupBy("image_id").agg(F.coalesce(F.min("family"), F.lit("")).alias("family"))
    n = _plan(spark, d).assignment.join(families, "image_id").groupBy("family").agg(F.count("*").alias("n_images"), *[F.count_if(F.col("split") == s).alias(s) for s in keep_together.SHARES])
    excess = sum(F.greatest(F.col(s) - F.col("n_images") * p, F.lit(0.0)) for s, p in keep_together.SHARES.items())
    return n.select("family", "n_images", (excess <= F.greatest(F.col("n_images") / 100, F.lit(10.0))).alias("balanced"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether decoding the ids gives each document's text back."""
    documents = table(spark, d, "documents")
    back = encode.decode(encode.encode(documents)).withColumnRenamed("text", "decoded")
    return documents.join(back, "doc_id").select("doc_id", F.col("text").eqNullSafe(F.col("decoded")).alias("same"))


def p6_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The bytes that the token ids of each document stand for."""
    return encode.count_bytes(encode.encode(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every piece of every document."""
    return pack.pack(pack.pieces(table(spark, d, "documents")), Workspace(spark, "p7"))


def _as_rows(one: DataFrame) -> DataFrame:
    """(promise, n): the columns of a frame of one row as rows."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("promise"), F.col(c).cast("long").alias("n")) for c in one.columns]))
    return one.select(each.alias("e")).select("e.promise", "e.n")


def _used(containers: DataFrame) -> DataFrame:
    return containers.groupBy("container_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, the least possible number, the tokens left unused, and how many each of the limits closed."""
    placed = Workspace(spark, "p7").keep(p7_containers(spark, d))
    limit = pack.loss_limit(placed)
    used = _used(placed)
    n = used.agg(
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.count_if(F.col("used") == pack.CAPACITY).alias("n_full"),
        F.count_if(F.col("segments") == pack.SEGMENTS).alias("n_at_segments"),
        F.count_if((F.col("segments") > 1) & (F.col("loss") == limit)).alias("n_at_loss"),
    )
    return n.select(
        "n_containers", F.ceil(F.col("n_tokens") / pack.CAPACITY).alias("least_possible"), "n_tokens", (F.col("n_containers") * pack.CAPACITY - F.col("n_tokens")).alias("unused"), "n_full", "n_at_segments", "n_at_loss"
    )


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were placed, and how often a promise was broken: a limit passed, a piece twice or missing, a text cut that needn't be."""
    placed = Workspace(spark, "p7").keep(p7_containers(spark, d))
    limit = pack.loss_limit(placed)
    used = _used(placed).agg(
        F.count_if(F.col("used") > pack.CAPACITY).alias("over_capacity"),
        F.count_if(F.col("segments") > pack.SEGMENTS).alias("over_segments"),
        F.count_if((F.col("segments") > 1) & (F.col("loss") > limit)).alias("over_loss"),
    )
    per = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("tokens").alias("tokens"))
    whole = per.agg(
        F.count("*").alias("n_documents"),
        F.count_if((F.col("n") != F.col("pieces")) | (F.col("n") != F.col("last") + 1)).alias("wrong_pieces"),
        F.count_if(F.col("n") != F.ceil(F.col("tokens") / pack.CAPACITY)).alias("needless_cuts"),
    )
    return _as_rows(used).unionByName(_as_rows(whole))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents that have no or a wrong label, and of mixed ones."""
    return language.label_errors(language.detect(table(spark, d, "documents")))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of every document in one language, with confidence."""
    return language.detect(table(spark, d, "documents")).where("lang is not null").select("doc_id", "segment", "start", "end", "lang", "confidence")


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages of every document with their sentences and confidence."""
    return language.document_languages(language.detect(table(spark, d, "documents"))).select("doc_id", "lang", "n_sentences", F.round("confidence", 4).alias("confidence"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and how often a promise of the segments was broken: out of the text, out of order, overlapping, or without a confidence."""
    documents = table(spark, d, "documents")
    found = language.detect(documents)
    along = Window.partitionBy("doc_id").orderBy("segment")  # the segments of one text
    placed = found.where("segment is not null").withColumns({"before": F.lag("end").over(along), "lang_before": F.lag("lang").over(along)})
    size = documents.select("doc_id", F.length("text").alias("size"))
    wrong = placed.join(size, "doc_id").agg(
        F.count_if((F.col("start") < 0) | (F.col("end") > F.col("size")) | (F.col("start") >= F.col("end"))).alias("out_of_text"),
        F.count_if((F.col("start") < F.col("before")) | (F.col("lang") == F.col("lang_before"))).alias("out_of_order"),
        F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("without_confidence"),
    )
    return _as_rows(found.agg(F.count_distinct("doc_id").alias("n_documents"))).unionByName(_as_rows(wrong))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_sizes, p3_found, p3_report, p3_stems, p3_listed, p3_scenes, p3_classes, p4_found, p4_groups, p4_assignment, p4_balance,
        p4_together, p4_shares, p4_labels, p6_ids, p6_roundtrip, p6_bytes,
        p7_containers, p7_fill, p7_checks, p8_found, p8_segments, p8_languages, p8_checks,
    )
}
__all__ = ["QUERIES", "ORACLES"]
