"""Near-duplicate scenes by blocked pairing: class multisets, greedy matching, scores, contamination grids."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import Workspace

#: A bucket with more images than this is reported as large; its images are not all compared, but those that lie near each other.
BUCKET_LIMIT = 600


def signatures(boxes: DataFrame, image: str = "image") -> DataFrame:
    """(image, signature, n_boxes, cls, xs, ys, ws, hs): the multiset of an image's classes and its boxes in a fixed order.

    signature is class:count, joined by commas, in class order; images without boxes have no row.
    """
    box = F.sort_array(F.collect_list(F.struct("class_id", "cx", "cy", "w", "h")))
    held = boxes.groupBy(image).agg(box.alias("b"))
    cls = F.transform("b", lambda x: x["class_id"])
    runs = F.transform(
        F.array_sort(F.array_distinct(cls)), lambda c: F.concat(c.cast("string"), F.lit(":"), F.size(F.filter("b", lambda x: x["class_id"] == c)).cast("string"))
    )
    return held.select(
        image,
        F.array_join(runs, ",").alias("signature"),
        F.size("b").alias("n_boxes"),
        cls.alias("cls"),
        *[_field("b", f).alias(n) for f, n in (("cx", "xs"), ("cy", "ys"), ("w", "ws"), ("h", "hs"))],
    )


def _field(array: str, name: str):
    return F.transform(array, lambda x: x[name])


def buckets(signed: DataFrame) -> DataFrame:
    """(signature, n_images, n_pairs, skipped): images of each multiset; over the limit not all its pairs are compared."""
    n = signed.groupBy("signature").agg(F.count("*").alias("n_images"))
    pairs = (F.col("n_images") * (F.col("n_images") - 1) / 2).cast("long")
    return n.select("signature", "n_images", pairs.alias("n_pairs"), (F.col("n_images") > BUCKET_LIMIT).alias("skipped"))


def blocked_pairs(signed: DataFrame, ident: str, carry: Sequence[str], limit: int | None = BUCKET_LIMIT) -> DataFrame:
    """Pairs of images with the same multiset, a before b; a_<c>, b_<c> for each carried column."""
    usable = signed
    if limit is not None:
        fit = signed.groupBy("signature").agg(F.count("*").alias("_n")).where(F.col("_n").between(2, limit)).select("signature")
        usable = signed.join(fit, "signature", "left_semi")
    cols = [ident, *carry]
    a = usable.select("signature", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = usable.select("signature", *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, "signature").where(F.col(f"a_{ident}") < F.col(f"b_{ident}"))


def greedy(ca, xa, ya, cb, xb, yb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs and distances of a greedy one-to-one matching of equal classes, nearest first, ties by position."""
    i, j = np.nonzero(ca[:, None] == cb[None, :])
    d = np.sqrt((xa[i] - xb[j]) ** 2 + (ya[i] - yb[j]) ** 2)
    used_a, used_b = np.zeros(len(ca), bool), np.zeros(len(cb), bool)
    out: list[tuple[int, int, float]] = []
    for k in np.lexsort((j, i, d)):
        if not used_a[i[k]] and not used_b[j[k]]:
            used_a[i[k]] = used_b[j[k]] = True
            out.append((i[k], j[k], d[k]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.array(x) for x in zip(*out))


def iou(xa, ya, wa, ha, xb, yb, wb, hb) -> np.ndarray:
    """Intersection over union of boxes given by centre and size."""
    w = np.maximum(0, np.minimum(xa + wa / 2, xb + wb / 2) - np.maximum(xa - wa / 2, xb - wb / 2))
    h = np.maximum(0, np.minimum(ya + ha / 2, yb + hb / 2) - np.maximum(ya - ha / 2, yb - hb / 2))
    union = wa * ha + wb * hb - w * h
    return np.divide(w * h, union, out=np.zeros_like(union), where=union > 0)


def compare_boxes(ca, xa, ya, wa, ha, cb, xb, yb, wb, hb) -> tuple[float, float, float, float]:
    """(raw_max, raw_mean, aligned_max, mean_iou); (1, 1, 1, 0) where nothing can be matched."""
    if not len(ca) or not len(cb):
        return 1.0, 1.0, 1.0, 0.0
    i, j, d = greedy(ca, xa, ya, cb, xb, yb)
    if not len(i):
        return 1.0, 1.0, 1.0, 0.0
    overlap = iou(xa[i], ya[i], wa[i], ha[i], xb[j], yb[j], wb[j], hb[j])
    shifted = greedy(ca, xa - xa.mean(), ya - ya.mean(), cb, xb - xb.mean(), yb - yb.mean())[2]
    return float(d.max()), float(d.mean()), float(shifted.max()), float(overlap.mean())


_BOX = ("cls", "xs", "ys", "ws", "hs")


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            compare_boxes(*[np.asarray(getattr(r, f"a_{c}")) for c in _BOX], *[np.asarray(getattr(r, f"b_{c}")) for c in _BOX])
            for r in pdf.itertuples(index=False)
        ]
        scores = pd.DataFrame(rows, columns=["raw_max_dist", "raw_mean_dist", "aligned_max_dist", "mean_iou"], dtype=float)
        yield pd.concat([pdf[["a_image_id", "b_image_id", "n_boxes"]].reset_index(drop=True), scores], axis=1)


_SCORES = "a_image_id long, b_image_id long, n_boxes int, raw_max_dist double, raw_mean_dist double, aligned_max_dist double, mean_iou double"
_SCORED = ["a_image_id", "b_image_id", "n_boxes", *[f"{s}_{c}" for s in "ab" for c in _BOX]]


def _near(classes: DataFrame, most: float) -> DataFrame:
    """(a, b): ids of copy classes of one multiset that may be at most ``most`` apart, raw or aligned; each direction an image of a comes first in.

    classes: signature, lo, hi (least and greatest image), xs, ys. All boxes of such a pair are matched one to one within
    ``most``, so mean, least and greatest x and y differ by no more, of centres as they are and of centres around their mean. The cells are a
    grid of the means (raw) and of the greatest centred x and y (aligned); a pair found by the first isn't looked for by the second.
    """
    reach = most * (1 + 1e-6) + 1e-9  # wider than any rounding of a mean
    mean = {c: F.aggregate(f"{c}s", F.lit(0.0), lambda t, x: t + x) / F.size(f"{c}s") for c in "xy"}
    held = classes.select("signature", "lo", "hi", F.size("xs").alias("n"), *[mean[c].alias(f"m{c}") for c in "xy"], *[f(f"{c}s").alias(f"{k}{c}") for c in "xy" for k, f in (("l", F.array_min), ("g", F.array_max))])
    keys = {"raw": ("mx", "my"), "aligned": ("gx - mx", "gy - my")}
    of = {"raw": ("mx", "my", "lx", "ly", "gx", "gy"), "aligned": ("lx - mx", "ly - my", "gx - mx", "gy - my")}
    cols = ["lo", "hi", "n", "mx", "my", "lx", "ly", "gx", "gy"]

    def within(expressions):
        a, b = ([F.expr(re.sub(r"\b([mlg][xy])\b", rf"{s}_\1", e)) for e in expressions] for s in "ab")
        close = [F.abs(p - q) <= reach for p, q in zip(a, b)]
        return reduce(lambda p, q: p & q, close)

    out = None
    for kind, (kx, ky) in keys.items():
        cell = [F.floor(F.expr(k) / (1.001 * reach)) for k in (kx, ky)]
        around = F.explode(F.array(*[F.struct((cell[0] + i).alias("x"), (cell[1] + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        a = held.select("signature", around.alias("cell"), *[F.col(c).alias(f"a_{c}") for c in cols])
        b = held.select("signature", F.struct(cell[0].alias("x"), cell[1].alias("y")).alias("cell"), *[F.col(c).alias(f"b_{c}") for c in cols])
        first = (F.col("a_lo") < F.col("b_hi")) & within(of[kind])
        found = a.join(b, ["signature", "cell"]).where(first if kind == "raw" else first & ~within(of["raw"]))
        one = found.select(F.col("a_lo").alias("a"), F.col("b_lo").alias("b"))
        out = one if out is None else out.unionByName(one)
    return out


def near_pairs(signed: DataFrame, most: float, limit: int, ws: Workspace | None = None) -> DataFrame:
    """Scores of all pairs of the buckets over the limit that are at most ``most`` apart, raw or aligned.

    Images with the same boxes are one class, scored once; classes meet by cells of their geometry, so a bucket is
    never paired as a whole unless it lies in one place. What is found is scored as any other pair.
    """
    keep = ws.keep if ws else lambda df: df
    large = keep(signed.groupBy("signature").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("signature"))
    if ws and large.isEmpty():
        return signed.sparkSession.createDataFrame([], _SCORES)
    held = keep(signed.join(large, "signature", "left_semi").select("signature", "image_id", "n_boxes", *_BOX))
    same = ["signature", *_BOX]
    classes = keep(held.groupBy(*same).agg(F.min("image_id").alias("lo"), F.max("image_id").alias("hi"), F.first("n_boxes").alias("n_boxes")))
    boxes = {s: classes.select(F.col("lo").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in _BOX]) for s in "ab"}
    sized = classes.select(F.col("lo").alias("a"), "n_boxes")
    pairs = _near(classes, most).join(boxes["a"].join(sized, "a"), "a").join(boxes["b"], "b")
    scored = pairs.withColumnsRenamed({"a": "a_image_id", "b": "b_image_id"}).select(*_SCORED).mapInPandas(_scored, _SCORES)
    kept = scored.where(F.least("raw_max_dist", "aligned_max_dist") <= most).withColumnsRenamed({"a_image_id": "a", "b_image_id": "b"})
    members = held.join(classes.drop("n_boxes"), same).select("image_id", "lo")
    a, b = (members.select(F.col("lo").alias(s), F.col("image_id").alias(f"{s}_image_id")) for s in "ab")
    return kept.join(a, "a").join(b, "b").where("a_image_id < b_image_id").drop("a", "b")


def scored_pairs(signed: DataFrame, most: float, limit: int | None = BUCKET_LIMIT, ws: Workspace | None = None) -> DataFrame:
    """Pairs of one multiset whose raw or aligned distance is at most ``most``, with their scores and low_info.

    Buckets up to the limit are compared pair by pair, larger ones by near_pairs, with the same result. signed needs image_id beside
    the signature columns. Distances are rounded to five digits after the filter, which sees them unrounded. With a workspace
    the signatures are made once.
    """
    signed = ws.keep(signed) if ws else signed
    pairs = blocked_pairs(signed, "image_id", _BOX, limit).withColumn("n_boxes", F.size("a_cls"))
    scored = pairs.select(*_SCORED).mapInPandas(_scored, _SCORES).where(F.least("raw_max_dist", "aligned_max_dist") <= most)
    if limit is not None:
        scored = scored.unionByName(near_pairs(signed, most, limit, ws))
    rounded = [F.round(c, 5).alias(c) for c in ("raw_max_dist", "raw_mean_dist", "aligned_max_dist", "mean_iou")]
    return scored.select("a_image_id", "b_image_id", "n_boxes", *rounded, (F.col("n_boxes") <= 2).alias("low_info"))


def apart(a: str, b: str) -> Column:
    """Whether a split of one end differs from one of the other's; not where an end has none. a, b: arrays of distinct splits."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_union(a, b)) > 1)


def contamination(pairs: DataFrame, epsilons: Sequence[float], states: Sequence[str]) -> DataFrame:
    """(state, scoring, epsilon, excl_low, pairs, cross, test_train, valid_train, test_valid).

    pairs: raw, aligned, low, and a_<state>, b_<state>: the two ends' splits in each state of the assignment, or arrays of all their
    splits; of those a pair has every relation that a split of one end has with one of the other, and counts once in each. Each
    pair is read once; a literal grid of states, scorings, epsilons and flags is exploded over it and counted with partial aggregation.
    """
    many = {c: isinstance(pairs.schema[c].dataType, ArrayType) for c in (f"{e}_{s}" for e in "ab" for s in states)}
    pairs = pairs.withColumns({c: F.array_compact(F.array(c)) for c, already in many.items() if not already})
    grid = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("state"), F.lit(k).alias("scoring"), F.lit(e).alias("epsilon"), F.lit(x).alias("excl_low"), F.col(f"a_{s}").alias("sa"), F.col(f"b_{s}").alias("sb"), F.col(k).alias("d"))
                for s in states
                for k in ("raw", "aligned")
                for e in epsilons
                for x in (False, True)
            ]
        )
    )
    hit = pairs.select(grid.alias("g"), "low").where((F.col("g.d") <= F.col("g.epsilon")) & ~(F.col("g.excl_low") & F.col("low")))

    def between(a: str, b: str):
        def held(x: str, y: str):
            return F.array_contains("g.sa", x) & F.array_contains("g.sb", y)

        return F.count_if(held(a, b) | held(b, a))

    return hit.groupBy("g.state", "g.scoring", "g.epsilon", "g.excl_low").agg(
        F.count("*").alias("pairs"),
        F.count_if(apart("g.sa", "g.sb")).alias("cross"),
        between("test", "train").alias("test_train"),
        between("valid", "train").alias("valid_train"),
        between("test", "valid").alias("test_valid"),
    )


def twin_counts(pairs: DataFrame, epsilons: Sequence[float]) -> DataFrame:
    """(epsilon, test_twins, valid_twins): distinct evaluation images with a train partner at most epsilon away.

    pairs: a, b (images), sa, sb (splits), d.
    """
    two = pairs.select("d", F.explode(F.array(F.struct(F.col("a").alias("image"), F.col("sa").alias("own"), F.col("sb").alias("other")), F.struct(F.col("b").alias("image"), F.col("sb").alias("own"), F.col("sa").alias("other")))).alias("e"))
    held = two.where((F.col("e.other") == "train") & F.col("e.own").isin("test", "valid")).groupBy("e.image", "e.own").agg(F.min("d").alias("d"))
    swept = held.select("image", "own", "d", F.explode(F.array(*[F.lit(e) for e in epsilons])).alias("epsilon")).where("d <= epsilon")
    return swept.groupBy("epsilon").agg(F.count_if(F.col("own") == "test").alias("test_twins"), F.count_if(F.col("own") == "valid").alias("valid_twins"))
