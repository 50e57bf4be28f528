"""Same or near-same images across splits, by content-defined chunks of their boxes.

A record is an image's set of valid boxes. It is normalised to what a small shift of the camera cannot change: one token for the
k-th box of each class, in the order of the tokens' hashes. A rolling hash over three tokens cuts that sequence wherever its value
says so, so a box more or less changes the cuts and chunks around its token and no others. Digests of the chunks are joined across
splits, and the lengths of the chunks two records share, summed, over the length of both are their overlap fraction. A record is looked
up by its longest chunks only, as many as cover half of it: two records that share half of their length share one of those.

Records with the same classes share all chunks and so always meet. Those that leave boxes unpaired may have had every chunk cut
through, the more likely the fewer boxes they have; for them there is an index of digests of "all parts but u", for every number u
of boxes that two records of a possible size may leave unpaired, over parts dealt by the tokens' hashes: one box changes one part, so
nothing is missed. All candidates are then checked exactly, by the best common shift and a maximum matching.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import Workspace

#: Largest 1 - 2m/(n_a + n_b), as a whole number of hundredths, that still counts as near-same.
MOST_UNPAIRED_PERCENT = 7
LEAST_BOXES = 6
CENTRE = 0.02
SHIFT = 0.06
SAME_SCORE = 0.001
#: Tokens the rolling hash sees, and one of how many of its values cuts: the mean length of a chunk, nearly.
WINDOW = 3
DIVISOR = 4
#: Least overlap fraction, in hundredths, at which two records are candidates by their chunks.
LEAST_SHARED_PERCENT = 50
#: Unpaired boxes up to which the index has a level for each number; beyond it levels grow by a quarter.
SINGLE_LEVELS = 6
#: Circles within which every crossing is tried; a part of the shifts with more of them is divided.
MOST_CIRCLES = 64


def unpaired_limit(total: Column, percent: int = MOST_UNPAIRED_PERCENT) -> Column:
    """Most boxes a pair with ``total`` boxes may leave unpaired: at most percent of them, of the total's parity."""
    most = F.floor(total * percent / 100 + F.lit(1e-9))
    return most - F.pmod(most + total, F.lit(2))


def valid_boxes(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct valid boxes; NaN and null fail every comparison of their own kind and are dropped."""
    ok = F.lit(True)
    for c in ("cx", "cy", "w", "h"):
        ok = ok & (F.col(c) > 0) & (F.col(c) <= 1)
    known = classes.select("class_id").where("class_id is not null").distinct()
    return boxes.where("image is not null").where(ok).join(known, "class_id", "left_semi").select("image", "class_id", "cx", "cy", "w", "h")


def image_sides(images: DataFrame) -> DataFrame:
    """(image_id, filename, stem, split) for the distinct listed images that have a split."""
    split = N.split_label("split")
    # a file listed twice is one image
    return (
        images.where(split.isNotNull() & F.col("image_id").isNotNull() & F.col("filename").isNotNull())
        .groupBy("image_id", "filename")
        .agg(F.min(split).alias("split"))
        .select("image_id", "filename", N.stem("filename").alias("stem"), "split")
    )


def box_records(sides: DataFrame, boxes: DataFrame, classes: DataFrame, least: int = LEAST_BOXES) -> DataFrame:
    """One row for each image with at least ``least`` valid boxes: n, boxes (class, cx, cy by class), occ.

    occ numbers the boxes of a class (class * 2^20 + k), so that intersecting two of them intersects multisets.
    """
    box = F.struct("class_id", "cx", "cy", "w", "h")
    sets = valid_boxes(boxes, classes).groupBy("image").agg(F.collect_set(box).alias("b")).where(F.size("b") >= least)
    listed = sides.select("image_id", "filename", "split")
    b = F.array_sort("b")
    packed = listed.join(sets, listed["filename"] == sets["image"]).select("image_id", "split", F.size("b").alias("n"), b.alias("b"))
    classes_of = F.transform("b", lambda x: x["class_id"])
    return packed.select(
        "image_id",
        "split",
        "n",
        classes_of.alias("cls"),
        F.transform("b", lambda x: x["cx"].cast("double")).alias("xs"),
        F.transform("b", lambda x: x["cy"].cast("double")).alias("ys"),
    ).withColumn("occ", F.expr("transform(cls, (c, i) -> c * 1048576L + i - (array_position(cls, c) - 1))"))


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def content_chunks(tokens: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Chunks (length, digest) of an array of 64-bit tokens, cut after each window whose rolling hash is a multiple of the divisor.

    The hash is cyclic: the window's tokens, each turned by one bit more the longer it is in, exclusively ored.
    """
    size = F.size(tokens)

    def rolled(i: Column) -> Column:
        out = F.element_at(tokens, i)
        for age in range(1, window):
            out = out.bitwiseXOR(_turned(F.element_at(tokens, (i - age).cast("int")), age))
        return out

    inner = F.when(size > window, F.sequence(F.lit(window), size - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.concat(F.filter(inner, lambda i: F.pmod(rolled(i), F.lit(divisor)) == 0), F.array(size))
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct((b - a).alias("length"), F.xxhash64(F.slice(tokens, a + 1, b - a)).alias("digest")))


def cut_records(records: DataFrame) -> DataFrame:
    """records with tokens (hashes of occ, in order) and chunks."""
    tokens = F.array_sort(F.transform("occ", lambda x: F.xxhash64(x)))
    return records.withColumn("tokens", tokens).withColumn("chunks", content_chunks(F.col("tokens")))


def _longest(chunks: Column, n: Column, percent: int) -> Column:
    """The chunks, longest first, that together cover ``percent`` of the record, and at least one."""
    ordered = F.sort_array(chunks, asc=False)

    def before(i: Column) -> Column:
        return F.aggregate(F.slice(ordered, 1, i), F.lit(0), lambda t, c: t + c["length"])

    return F.filter(ordered, lambda c, i: before(i) * 100 < n * percent)


def _extent_cells(near: float, probe: bool) -> Column:
    """Cells of a record's extents in x and y: that of the record, or all in which a record may lie whose extents differ by ``near``."""
    spans = [F.array_max(c) - F.array_min(c) for c in ("xs", "ys")]
    width = 2.5 * near
    if not probe:
        return F.array(F.struct(*[F.floor(v / width).alias(f"e{k}") for k, v in enumerate(spans)]))
    sides = [F.array_distinct(F.array(F.floor((v - near - 1e-9) / width), F.floor((v + near + 1e-9) / width))) for v in spans]
    return F.flatten(F.transform(sides[0], lambda a: F.transform(sides[1], lambda b: F.struct(a.alias("e0"), b.alias("e1")))))


def chunk_candidates(cut: DataFrame, percent: int = MOST_UNPAIRED_PERCENT) -> DataFrame:
    """(image_t, image_e): records of the two sides that share a long chunk, of sizes that can be near-same.

    Boxes that are all paired have extents that differ by two radii at most, so the cell of the extents goes into the key: a
    chunk that very many records have is spread over the cells.
    """
    least = 100 - LEAST_SHARED_PERCENT + 2
    sides = {}
    for side, probe in (("t", False), ("e", True)):
        own = cut.where(F.col("split") == side).select("image_id", "n", F.explode(_longest(F.col("chunks"), F.col("n"), least)).alias("c"), _extent_cells(2 * CENTRE, probe).alias("cells"))
        sides[side] = own.select(F.col("image_id").alias(f"image_{side}"), F.col("n").alias(f"n_{side}"), "c.length", "c.digest", F.explode("cells").alias("cell"))
    met = sides["t"].join(sides["e"], ["length", "digest", "cell"])
    return met.where(_sizes_fit("n_t", "n_e", percent)).select("image_t", "image_e")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= unpaired_limit(F.col(a) + F.col(b), percent)


def ladder(most: int) -> list[int]:
    """Levels of the index: each number up to SINGLE_LEVELS, then ever a quarter more, until ``most`` is reached."""
    out = [0]
    while out[-1] < max(most, 1):
        out.append(out[-1] + 1 if out[-1] < SINGLE_LEVELS else -(-out[-1] * 5 // 4))
    return out[1:]


def _levels(n: Column, levels: list[int], percent: int = MOST_UNPAIRED_PERCENT) -> Column:
    """The levels under which a record of n boxes is looked up: those of the unpaired boxes, one or more, it may leave with a partner."""
    low = F.floor(n * (100 - percent) / (100 + percent)).cast("int")
    high = F.ceil(n * (100 + percent) / (100 - percent)).cast("int")
    partners = F.filter(F.sequence(low, high), lambda k: F.abs(k - n) <= unpaired_limit(k + n, percent))
    unpaired = F.array_distinct(F.transform(partners, lambda k: unpaired_limit(k + n, percent).cast("int")))
    rungs = F.array(*[F.lit(k) for k in levels])
    up = F.transform(F.filter(unpaired, lambda u: u > 0), lambda u: F.array_min(F.filter(rungs, lambda k: k >= u)))
    return F.array_distinct(up)


def _parts(u: Column, k: Column) -> Column:
    """The digests of the k parts of ``tokens``, null for an empty part."""

    def part(j: Column) -> Column:
        held = F.filter("tokens", lambda t: F.pmod(F.xxhash64(t, k), k) == j)
        return F.when(F.size(held) > 0, F.xxhash64(u, j, held))

    return F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), part)


def _leave_out(parts: Column, u: int, k: int) -> Column:
    """Digests of all parts but u, for each choice of the u."""
    kept = F.array(*[F.array(*[F.lit(i) for i in chosen]) for chosen in combinations(range(k), k - u)])
    return F.transform(kept, lambda chosen: F.xxhash64(chosen, F.transform(chosen, lambda i: F.get(parts, i))))


def _every_two(parts: Column) -> Column:
    def with_later(x: Column, i: Column) -> Column:
        return F.transform(F.slice(parts, i + 2, F.size(parts)), lambda y: F.xxhash64(F.lit(2), F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))

    return F.flatten(F.transform(parts, with_later))


def _single(parts: Column, u: Column) -> Column:
    """Each part; the empty ones only where no more than u others are left, for then they are needed."""
    full = F.filter(parts, lambda p: p.isNotNull())
    empty = F.transform(F.filter(F.transform(parts, lambda p, j: F.when(p.isNull(), j)), lambda j: j.isNotNull()), lambda j: F.xxhash64(F.lit(1), u, j))
    return F.when(F.size(full) > u, full).otherwise(F.concat(full, empty))


def index_keys(cut: DataFrame, percent: int = MOST_UNPAIRED_PERCENT) -> DataFrame:
    """(image_id, split, n, level, parity, key): the digests under which a record is looked up where boxes may stay unpaired.

    One unpaired box changes one part, so of 4 parts 3, of 6 parts 4 are left whole by one or two of them, two of u + 2 by up to six, and
    one of u + 1 by more. The number of digests grows as the number of boxes. The total of a pair has the parity of what it leaves
    unpaired, so parity keeps pairs apart that no level of one number is for.
    """
    top = cut.agg(F.max("n")).first()[0] or 0
    levels = ladder(int(2 * top * percent / (100 - percent)) + 2)
    each = cut.select("image_id", "split", "n", "tokens", F.explode(_levels(F.col("n"), levels, percent)).alias("level"))
    u = F.col("level")
    k = F.when(u == 1, 4).when(u == 2, 6).when(u <= SINGLE_LEVELS, u + 2).otherwise(u + 1)
    parted = each.select("image_id", "split", "n", "level", _parts(u, k).alias("parts"))
    parts = F.col("parts")
    keys = F.when(u == 1, _leave_out(parts, 1, 4)).when(u == 2, _leave_out(parts, 2, 6)).when(u <= SINGLE_LEVELS, _every_two(parts)).otherwise(_single(parts, u))
    odd = F.when(u > SINGLE_LEVELS, 0).when(F.col("split") == "t", F.pmod(F.col("n") + u, F.lit(2))).otherwise(F.pmod(F.col("n"), F.lit(2)))
    return parted.select("image_id", "split", "n", "level", odd.alias("parity"), F.explode(keys).alias("key"))


def index_candidates(cut: DataFrame, percent: int = MOST_UNPAIRED_PERCENT) -> DataFrame:
    """(image_t, image_e): all records of the two sides that may be near-same though they leave boxes unpaired."""
    keys = index_keys(cut, percent)
    t, e = (keys.where(F.col("split") == s).select("level", "parity", "key", F.col("image_id").alias(f"image_{s}"), F.col("n").alias(f"n_{s}")) for s in "te")
    return t.join(e, ["level", "parity", "key"]).where(_sizes_fit("n_t", "n_e", percent)).select("image_t", "image_e")


def _most_matched(pairs: list[tuple[int, int]], goal: int = 0) -> int:
    """Size of a maximum one-to-one matching, by augmenting paths with a stack of their own; 0 as soon as ``goal`` is out of reach."""
    to: dict[int, list[int]] = {}
    for i, j in pairs:
        to.setdefault(i, []).append(j)
    owner: dict[int, int] = {}
    free = []
    for i in sorted(to, key=lambda k: len(to[k])):
        j = next((j for j in to[i] if j not in owner), None)
        if j is None:
            free.append(i)
        else:
            owner[j] = i
    spare = len(to) - goal
    for root in free:
        came: dict[int, int] = {}
        stack, end = [root], None
        while stack and end is None:
            i = stack.pop()
            for j in to[i]:
                if j not in came:
                    came[j] = i
                    if j not in owner:
                        end = j
                        break
                    stack.append(owner[j])
        if end is None:
            spare -= 1
            if spare < 0:
                return 0
            continue
        # turn the path round: every box on it hands its partner on
        mine = {i: j for j, i in owner.items()}
        while end is not None:
            i = came[end]
            owner[end], end = i, mine.get(i) if i != root else None
    return len(owner)


class _Shifts:
    """Pairs of boxes of one class that some allowed shift brings together, each a disc of shifts."""

    def __init__(self, ca, xa, ya, cb, xb, yb, centre: float, shift: float):
        self.centre, self.eps = centre, 1e-9
        reach = shift + centre + self.eps
        found = []
        # a block of rows at a time, so that memory doesn't grow with the product of the boxes
        step = max(1, 500_000 // max(1, len(cb)))
        for k in range(0, len(ca), step):
            dx, dy = xb[None, :] - xa[k : k + step, None], yb[None, :] - ya[k : k + step, None]
            i, j = np.nonzero((ca[k : k + step, None] == cb[None, :]) & (np.abs(dx) <= reach) & (np.abs(dy) <= reach))
            found.append((i + k, j, dx[i, j], dy[i, j]))
        self.i, self.j, self.dx, self.dy = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),) * 2
        kinds, both = np.unique(np.concatenate([ca, cb]), return_inverse=True)
        self.kind_a, self.kind_b, self.kinds = both[: len(ca)], both[len(ca) :], len(kinds)

    def bound(self, pick: np.ndarray) -> int:
        """No more boxes than this can be paired by these pairs: of each class the fewer of both sides' boxes."""
        a, b = np.zeros(len(self.kind_a), bool), np.zeros(len(self.kind_b), bool)
        a[self.i[pick]] = True
        b[self.j[pick]] = True
        return int(np.minimum(np.bincount(self.kind_a[a], minlength=self.kinds), np.bincount(self.kind_b[b], minlength=self.kinds)).sum())

    def matched(self, pick: np.ndarray, goal: int) -> int:
        """Boxes these pairs match one to one, or less than ``goal`` if that can't be reached."""
        if len(pick) < goal or self.bound(pick) < goal:
            return 0
        return _most_matched(list(zip(self.i[pick].tolist(), self.j[pick].tolist())), goal)

    def at(self, x: float, y: float, pick: np.ndarray) -> np.ndarray:
        return pick[np.hypot(self.dx[pick] - x, self.dy[pick] - y) <= self.centre + self.eps]

    def peaks(self, shift: float, most: int = 6) -> list[tuple[float, float]]:
        """Shifts at which many pairs lie close together."""
        side = int(np.ceil(2 * (shift + self.centre) / self.centre)) + 1
        cx, cy = (np.floor((d + shift + self.centre) / self.centre).astype(int).clip(0, side - 1) for d in (self.dx, self.dy))
        heaps = np.bincount(cx * side + cy, minlength=side * side)
        out = []
        for cell in np.argsort(-heaps, kind="stable")[:most]:
            x, y = (cell // side + 0.5) * self.centre - shift - self.centre, (cell % side + 0.5) * self.centre - shift - self.centre
            for _ in range(3):
                near = np.hypot(self.dx - x, self.dy - y) <= self.centre
                if near.any():
                    x, y = self.dx[near].mean(), self.dy[near].mean()
            out.append((float(np.clip(x, -shift, shift)), float(np.clip(y, -shift, shift))))
        return out


def _corners(cx: np.ndarray, cy: np.ndarray, r: float, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Points of the box of which one lies in every region that overlapping discs form in it.

    Such a region has a corner: a crossing of two circles, of a circle and an edge of the box, a corner of the box, or it is a whole disc.
    """
    x0, x1, y0, y1 = box
    p, q = np.triu_indices(len(cx), 1)
    ax, ay = (cx[q] - cx[p]) / 2, (cy[q] - cy[p]) / 2
    half = np.hypot(ax, ay)
    ok = (half > 0) & (half <= r + 1e-9)
    mx, my, ax, ay, half = (cx[p] + cx[q])[ok] / 2, (cy[p] + cy[q])[ok] / 2, ax[ok], ay[ok], half[ok]
    t = np.sqrt(np.maximum(r**2 - half**2, 0)) / half
    px, py = [cx, mx - t * ay, mx + t * ay, np.array([x0, x0, x1, x1])], [cy, my + t * ax, my - t * ax, np.array([y0, y1, y0, y1])]
    for edge, along, across, first in ((x0, cx, cy, True), (x1, cx, cy, True), (y0, cy, cx, False), (y1, cy, cx, False)):
        gap = r**2 - (along - edge) ** 2
        on = gap >= -1e-10  # a circle may just touch the edge
        for sign in (-1, 1):
            other = across[on] + sign * np.sqrt(np.maximum(gap[on], 0))
            px.append(np.full(on.sum(), edge) if first else other)
            py.append(other if first else np.full(on.sum(), edge))
    x, y = np.concatenate(px), np.concatenate(py)
    inside = (x >= x0 - 1e-9) & (x <= x1 + 1e-9) & (y >= y0 - 1e-9) & (y <= y1 + 1e-9)
    return x[inside], y[inside]


def _best_in(s: _Shifts, always: np.ndarray, maybe: np.ndarray, box: tuple[float, float, float, float], best: int) -> int:
    """The most boxes any shift in the box matches, if more than ``best``; always and maybe: pairs whose disc covers or cuts the box."""
    if not len(maybe):
        return max(best, s.matched(always, best + 1))
    spots, circle = np.unique(np.stack([s.dx[maybe], s.dy[maybe]], 1).round(11), axis=0, return_inverse=True)
    circle = circle.ravel()
    x, y = _corners(spots[:, 0], spots[:, 1], s.centre, box)
    hit = np.hypot(spots[None, :, 0] - x[:, None], spots[None, :, 1] - y[:, None]) <= s.centre + s.eps
    many = len(always) + hit @ np.bincount(circle, minlength=len(spots))
    hit, many = hit[many > best], many[many > best]
    seen = set()
    for k in np.argsort(-many, kind="stable"):
        if many[k] <= best:
            break
        which = hit[k].tobytes()
        if which not in seen:
            seen.add(which)
            best = max(best, s.matched(np.concatenate([always, maybe[hit[k][circle]]]), best + 1))
    return best


def best_match(ca, xa, ya, cb, xb, yb, need: int, centre: float = CENTRE, shift: float = SHIFT) -> int:
    """Most boxes that pair one to one by class within ``centre`` after one common shift; 0 if under ``need``.

    The square of shifts is searched by branch and bound. A part of it that few circles cut is settled by trying every corner of
    their overlaps; one with more is divided in four, and given up where all discs that reach into it can't match more boxes than were
    matched already. Memory grows with the pairs of boxes that can meet, not with the crossings of their circles.
    """
    s = _Shifts(ca, xa, ya, cb, xb, yb, centre, shift)
    everything = np.arange(len(s.i))
    best = max(need, 1) - 1
    top = s.bound(everything)
    if top <= best:
        return 0
    if len(everything) > MOST_CIRCLES:
        for x, y in s.peaks(shift):
            best = max(best, s.matched(s.at(x, y, everything), best + 1))
            if best >= top:
                return best
    turn = count()
    heap = [(-top, 2 * shift, next(turn), (-shift, shift, -shift, shift), everything)]
    while heap:
        most, side, _, (x0, x1, y0, y1), held = heapq.heappop(heap)
        if -most <= best:
            break
        dx, dy = s.dx[held], s.dy[held]
        covers = np.hypot(np.maximum(np.abs(dx - x0), np.abs(dx - x1)), np.maximum(np.abs(dy - y0), np.abs(dy - y1))) <= centre
        maybe = held[~covers]
        if len(maybe) <= MOST_CIRCLES or len(np.unique(np.stack([s.dx[maybe], s.dy[maybe]], 1).round(11), axis=0)) <= MOST_CIRCLES:
            best = _best_in(s, held[covers], maybe, (x0, x1, y0, y1), best)
        elif side < 1e-8:
            # more circles than that through one point: the part is that point
            best = max(best, s.matched(held, best + 1))
        else:
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            for part in ((x0, mx, y0, my), (mx, x1, y0, my), (x0, mx, my, y1), (mx, x1, my, y1)):
                away = np.hypot(np.maximum(np.maximum(part[0] - dx, dx - part[1]), 0), np.maximum(np.maximum(part[2] - dy, dy - part[3]), 0))
                reach = held[away <= centre + s.eps]
                best = max(best, s.matched(s.at((part[0] + part[1]) / 2, (part[2] + part[3]) / 2, reach), best + 1))
                bound = s.matched(reach, best + 1)
                if bound > best:
                    heapq.heappush(heap, (-bound, side / 2, next(turn), part, reach))
        if best >= top:
            break
    return best if best >= need else 0


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        columns = [pdf[c].to_numpy() for c in ("cls_a", "xs_a", "ys_a", "cls_b", "xs_b", "ys_b")]
        total = (pdf["n_a"] + pdf["n_b"]).to_numpy()
        need = (total - pdf["most"].to_numpy() + 1) // 2
        matched = np.array([best_match(*[c[k] for c in columns], need=int(need[k])) for k in range(len(pdf))], dtype="int64")
        out = pd.DataFrame({"image_t": pdf["image_t"], "image_e": pdf["image_e"], "matched": matched, "total": total.astype("int64"), "overlap": pdf["overlap"]})
        # a match below what is needed is 0
        yield out[matched > 0]


@dataclass
class SceneOverlaps:
    """near: (image_t, image_e, matched, total, overlap) between one image each of every set of copies; members: (split, same, same2,
    image_id) and heads: the same with the least image of each set."""

    near: DataFrame
    members: DataFrame
    heads: DataFrame


def scene_classes(records: DataFrame, percent: int = MOST_UNPAIRED_PERCENT, ws: Workspace | None = None) -> SceneOverlaps:
    """Near-same train and evaluation images; images with the very same boxes are one class, looked up and checked once.

    With a workspace the cut records are written once for the many reads of them.
    """
    keep = ws.keep if ws else lambda df: df
    side = F.when(F.col("split") == "train", F.lit("t")).otherwise(F.lit("e"))
    tagged = records.withColumn("split", side).withColumn("same", F.xxhash64("cls", "xs", "ys")).withColumn("same2", F.xxhash64(F.lit(1), "cls", "ys", "xs"))
    members = tagged.select("split", "same", "same2", "image_id")
    heads = tagged.groupBy("split", "same", "same2").agg(F.min("image_id").alias("image_id"))
    single = keep(cut_records(tagged.join(heads.select("split", "image_id"), ["split", "image_id"], "left_semi")))
    met = chunk_candidates(single, percent).unionByName(index_candidates(single, percent)).distinct()
    cols = ("n", "cls", "xs", "ys", "occ", "chunks")
    left = single.where("split = 't'").select(F.col("image_id").alias("image_t"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = single.where("split = 'e'").select(F.col("image_id").alias("image_e"), *[F.col(c).alias(f"{c}_b") for c in cols])
    both = F.col("n_a") + F.col("n_b")
    shared = F.aggregate(F.array_intersect("chunks_a", "chunks_b"), F.lit(0), lambda t, c: t + c["length"])
    candidates = (
        met.join(right, "image_e")
        .join(left, "image_t")
        .withColumn("most", unpaired_limit(both, percent).cast("int"))
        # boxes of equal classes bound what geometry can pair
        .where(both - 2 * F.size(F.array_intersect("occ_a", "occ_b")) <= F.col("most"))
        .withColumn("overlap", F.round(2 * shared / both, 6))
        .drop("occ_a", "occ_b", "chunks_a", "chunks_b")
    )
    near = candidates.mapInPandas(_checked, "image_t long, image_e long, matched long, total long, overlap double")
    return SceneOverlaps(near, members, heads)


def scene_overlaps(records: DataFrame, percent: int = MOST_UNPAIRED_PERCENT, ws: Workspace | None = None) -> DataFrame:
    """(image_t, image_e, score, overlap): train and evaluation images whose boxes are near-same.

    Pairs of classes of copies are joined back to their images at the end, so a scene that was copied often costs its result and no
    more. overlap is the fraction of both records' length that lies in content-defined chunks they share.
    """
    found = scene_classes(records, percent, ws)
    score = F.round(1 - 2 * F.col("matched") / F.col("total"), 6)
    out = found.near.select("image_t", "image_e", score.alias("score"), "overlap")
    for s in "te":
        same = [F.col("same").alias(f"same_{s}"), F.col("same2").alias(f"same2_{s}")]
        head = found.heads.where(F.col("split") == s).select(F.col("image_id").alias(f"image_{s}"), *same)
        member = found.members.where(F.col("split") == s).select(F.col("image_id").alias(f"image_{s}"), *same)
        out = out.join(head, f"image_{s}").drop(f"image_{s}").join(member, [f"same_{s}", f"same2_{s}"]).drop(f"same_{s}", f"same2_{s}")
    return out.select("image_t", "image_e", "score", "overlap")


def class_links(records: DataFrame, ws: Workspace, percent: int = MOST_UNPAIRED_PERCENT) -> DataFrame:
    """(image_id, side, class_id, n_copies, n_links): every record once, with the least image of its set of copies and side, how many are in
    that, and with how many images of the other side it is near-same. No pair of copies is written out."""
    found = scene_classes(records, percent, ws)
    size = ws.keep(found.members.groupBy("split", "same", "same2").agg(F.count("*").alias("n_copies"), F.min("image_id").alias("class_id")))
    near = ws.keep(found.near.select("image_t", "image_e"))
    weight = size.select(F.col("class_id").alias("_c"), "n_copies", F.col("split").alias("_s"))
    links = None
    for own, other in (("t", "e"), ("e", "t")):
        of = near.join(weight.where(F.col("_s") == other), F.col(f"image_{other}") == F.col("_c"))
        one = of.groupBy(F.lit(own).alias("_own"), F.col(f"image_{own}").alias("_head")).agg(F.sum("n_copies").alias("n_links"))
        links = one if links is None else links.unionByName(one)
    whole = size.join(links, (size["split"] == F.col("_own")) & (size["class_id"] == F.col("_head")), "left").select("split", "same", "same2", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    side = F.when(F.col("split") == "t", F.lit("train")).otherwise(F.lit("evaluation"))
    return found.members.join(whole, ["split", "same", "same2"]).select("image_id", side.alias("side"), "class_id", "n_copies", "n_links")


def listed_overlaps(sides: DataFrame, pairs: DataFrame, most: float = SAME_SCORE) -> DataFrame:
    """(image_t, image_e, score): pairs of the scorer's list, not low-info, of at most ``most``, by stem."""
    score = N.effective_score("score", "raw_max_dist", "aligned_max_dist")
    ends = (
        pairs.where(~N.low_info("low_info", "n_boxes"))
        .select(N.stem("stem_a").alias("a"), N.stem("stem_b").alias("b"), score.alias("score"))
        .where((F.col("score") <= most) & F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.min("score").alias("score"))
    )
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).distinct()
    t = sides.where("split = 'train'").select(F.col("image_id").alias("image_t"), F.col("stem").alias("a"))
    e = sides.where("split <> 'train'").select(F.col("image_id").alias("image_e"), F.col("stem").alias("b"))
    return both.join(t, "a").join(e, "b").select("image_t", "image_e", "score")


def same_stem(sides: DataFrame) -> DataFrame:
    """(image_t, image_e, score 0): exports of one photograph in train and in valid or test."""
    t = sides.where("split = 'train' and stem is not null").select("stem", F.col("image_id").alias("image_t"))
    e = sides.where("split <> 'train' and stem is not null").select("stem", F.col("image_id").alias("image_e"))
    return t.join(e, "stem").select("image_t", "image_e", F.lit(0.0).alias("score"))


def cross_split_overlaps(images: DataFrame, boxes: DataFrame, classes: DataFrame, pairs: DataFrame, ws: Workspace) -> DataFrame:
    """(image_t, image_e, reason, score) of every train image and every valid or test image that overlap.

    reason is stem, listed or boxes; a pair found for several reasons has a row for each. Images without a
    split, id or name are in no pair; images with fewer than six valid boxes only by stem or list.
    Repeated rows of an image, of a box or of a pair count once.
    """
    sides = image_sides(images)
    records = ws.keep(box_records(sides, boxes, classes))
    parts = (("stem", same_stem(sides)), ("listed", listed_overlaps(sides, pairs)), ("boxes", scene_overlaps(records, ws=ws)))
    frames = [df.select("image_t", "image_e", F.lit(reason).alias("reason"), "score") for reason, df in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def overlap_report(overlaps: DataFrame, images: DataFrame) -> DataFrame:
    """(split, device_key, reason, n_images, n_pairs, best_score): evaluation images that overlap with train.

    An image without a device counts under its family. n_images counts an image once for each reason.
    """
    split = N.split_label("split")
    devices = (
        images.where(split.isin("valid", "test"))
        .groupBy(F.col("image_id").alias("image_e"))
        .agg(F.min(split).alias("split"), F.min(N.device_or_family("device_name", "family")).alias("device_key"))
    )
    return (
        overlaps.join(devices, "image_e")
        .groupBy("split", "device_key", "reason")
        .agg(F.count_distinct("image_e").alias("n_images"), F.count("*").alias("n_pairs"), F.min("score").alias("best_score"))
    )
