"""Filling fixed-capacity containers: vector bin packing by the dot-product heuristic.

An item uses up tokens, one segment and a number of loss-bearing tokens. For instruction data a text is a prompt, which bears no loss, and a
response, which does; here the prompt is a text's first sentence or line. A container is filled by adding, again and again, the item that
fits in all three and whose needs have the largest dot product with what is left; once it holds an item, one or two more that leave no token
unused close it, those with the largest dot product. The limits on segments and loss hold for containers of several items: an item that exceeds one
by itself is a container by itself. Items with the same needs are interchangeable, so the search runs over kinds of items, not over items.

Work is split into shards of bounded size by hash and each is packed in a task of its own. What the shards can't fill well is given up and
packed again over all shards' leavings, in at most half as many shards, until one shard is left: if more than half of the items lie in poor
containers, only the poorest are given up, so that the number of poor containers that are kept is one shard's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from . import encode as E

CAPACITY = 2_048
SEGMENTS = 64
#: A container of several items may bear loss on this much more of its tokens than the items that need not be alone do on the whole.
LOSS_MARGIN = 0.03
#: Items of one packing problem.
SHARD = 6_000
#: A container with more than this share unused is packed again with other shards' poor ones.
POOR = 0.02


# Where a prompt ends: at the first end of a sentence or of a line.
_PROMPT = re.compile(r"[\r\n]|[.!?:][\"”»)\]']*(?=\s)|[。！？]")


def text_sizes(texts: list[str | None], path: str) -> Iterator[tuple[int, int]]:
    """(tokens, tokens of the prompt) of each text; a text that is one sentence has no prompt."""
    for text, (words, ids, whole) in zip(texts, E.cut_texts(texts, path)):
        end = _PROMPT.search(text or "")
        prompt = end.end() if end and text[end.end() :].strip() else 0
        if words is None:
            yield len(whole), len(E.encode_texts([text[:prompt]], path)[0]) if prompt else 0
            continue
        at = first = 0
        for word in words:
            if at >= prompt:
                break
            at += len(word)
            first += len(ids[word])
        yield sum(map(len, map(ids.__getitem__, words))), first


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(key, piece, first_token, tokens, loss_tokens): the items of each text; only a text over the capacity has more than one.

    The tokens of the prompt, and the first token of an item, which has nothing before it to be predicted from, bear no loss.
    Texts without tokens (null or empty) give no item.
    """
    path = vocabulary or E.vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, piece, first, size, loss = [], [], [], [], []
            for k, (n, prompt) in enumerate(text_sizes(batch.column(1).to_pylist(), path)):
                for p, at in enumerate(range(0, n, capacity)):
                    where.append(k)
                    piece.append(p)
                    first.append(at)
                    size.append(min(capacity, n - at))
                    loss.append(max(0, size[-1] - max(1, prompt - at)))
            arrays = [batch.column(0).take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(size, pa.int32()), pa.array(loss, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "piece", "first_token", "tokens", "loss_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, first_token long, tokens int, loss_tokens int")


def fill(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0; no item may have more tokens than the capacity.

    Equal items are taken in their order, ties of the dot product go to the kind with fewer tokens.
    """
    kinds, of = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    of = of.ravel()
    left = np.bincount(of, minlength=len(kinds))
    t, l = kinds[:, 0].copy(), kinds[:, 1].copy()
    queue = np.argsort(of, kind="stable")
    begin = np.concatenate([[0], np.cumsum(left)[:-1]])
    taken = np.zeros(len(kinds), dtype=np.int64)
    out = np.empty(len(tokens), dtype=np.int64)
    container = 0

    def take(k: int) -> None:
        out[queue[begin[k] + taken[k]]] = container
        taken[k] += 1
        left[k] -= 1

    for k in np.nonzero((l > loss_capacity) | (segments < 1))[0]:
        for _ in range(left[k]):
            take(k)
            container += 1
    live = np.nonzero(left)[0]
    while len(live):
        room_t, room_s, room_l = capacity, segments, loss_capacity
        fits = live
        while room_s > 0 and len(fits):
            if room_t < capacity:
                # kinds are sorted by tokens
                fits = fits[: np.searchsorted(t[fits], room_t, side="right")]
                fits = fits[(left[fits] > 0) & (l[fits] <= room_l)]
                if not len(fits):
                    break
                pair = _closing(t, l, left, fits, room_t, room_l, room_s)
                if pair is not None:
                    for k in pair:
                        take(k)
                    break
            # needs and rests in shares of the capacity; the need of a segment is the same for all and so decides nothing here
            score = t[fits] * (room_t / capacity**2) + l[fits] * (room_l / loss_capacity**2)
            k = int(fits[np.argmax(score)])
            take(k)
            room_t, room_s, room_l = room_t - int(t[k]), room_s - 1, room_l - int(l[k])
        live = live[left[live] > 0]
        container += 1
    return out


def _closing(t, l, left, fits, room_t: int, room_l: int, room_s: int) -> tuple[int, ...] | None:
    """The one or two items that leave no token unused and have the largest dot product with the room, if there are such."""
    sizes = t[fits]
    exact = fits[np.searchsorted(sizes, room_t) :]
    if len(exact):
        # the tokens are the same for all: the loss decides, and fits are sorted by it
        return (int(exact[-1]),)
    if room_s < 2:
        return None
    # the partner of each is found by bisection: of its size the one with the most loss
    at = np.searchsorted(sizes, room_t - sizes, side="right") - 1
    pick = np.nonzero((at >= 0) & (sizes + sizes[at] == room_t))[0]
    at = at[pick]
    ok = (l[fits[pick]] + l[fits[at]] <= room_l) & ((at != pick) | (left[fits[pick]] > 1))
    pick, at = pick[ok], at[ok]
    if not len(pick):
        return None
    # of equal products the pair with the largest larger item, so that small ones stay for later
    i = np.lexsort((sizes[pick], l[fits[pick]] + l[fits[at]]))[-1]
    return int(fits[pick[i]]), int(fits[at[i]])


def loss_limit(items: DataFrame, capacity: int = CAPACITY) -> int:
    """Loss-bearing tokens a container of several items may have: LOSS_MARGIN over the share of all items under the capacity.

    So every container bears about as much loss as the others, and the limit never asks for more containers than the tokens do.
    """
    shared = items.where(F.col("tokens") < capacity).agg(F.sum("loss_tokens") / F.sum("tokens")).first()[0]
    return max(1, min(capacity, int(capacity * ((1 if shared is None else shared) + LOSS_MARGIN))))


def pack(
    items: DataFrame,
    ws: Workspace,
    key: str = "doc_id",
    capacity: int = CAPACITY,
    segments: int = SEGMENTS,
    loss_capacity: int | None = None,
    shard: int = SHARD,
) -> DataFrame:
    """(container_id, key, piece, first_token, tokens, loss_tokens): every item in exactly one container.

    items: as from ``pieces``. An item over the capacity raises an error, for it can't be placed whole; loss_capacity is
    by default that of ``loss_limit``. No items, no containers. Equal items are told apart by key and piece.
    """
    cols = [key, "piece", "first_token", "tokens", "loss_tokens"]
    todo = ws.keep(items.select(*cols).where("tokens > 0"))
    limit = loss_capacity or loss_limit(todo, capacity)
    kind = todo.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, first_token long, tokens int, loss_tokens int, round int, shard int, number long, used int"

    def packer(level: int) -> Callable[[tuple[Any, ...], pd.DataFrame], pd.DataFrame]:
        def run(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([key, "piece"], ignore_index=True)
            size, loss = pdf["tokens"].to_numpy(np.int64), pdf["loss_tokens"].to_numpy(np.int64)
            if (size > capacity).any():
                raise ValueError("an item is larger than a container")
            number = fill(size, loss, capacity, segments, limit)
            used = np.bincount(number, weights=size)[number]
            return pdf.drop(columns="_shard").assign(round=level, shard=int(group[0]), number=number, used=used.astype(int))

        return run

    n = todo.count()
    done: list[DataFrame] = []
    shards = max(1, -(-n // shard))
    level = 0
    while n:
        dealt = todo.withColumn("_shard", F.pmod(F.xxhash64(key, "piece", F.lit(level)), F.lit(shards)).cast("int"))
        # a task for each shard, whatever its bytes
        placed = ws.keep(dealt.repartition(shards, "_shard").groupBy("_shard").applyInPandas(packer(level), schema))
        if shards == 1:
            done.append(placed)
            break
        bar = _bar(placed, capacity, n // 2)
        poor = F.col("used") < bar
        done.append(placed.where(~poor))
        todo = placed.where(poor).select(*cols)
        n = todo.count() if bar else 0
        shards = max(1, min(-(-n // shard), shards // 2))
        level += 1
    if not done:
        return todo.select(F.lit(None).cast("string").alias("container_id"), *cols)
    all_done = done[0]
    for df in done[1:]:
        all_done = all_done.unionByName(df)
    return all_done.select(F.format_string("%d-%05d-%07d", "round", "shard", "number").alias("container_id"), *cols)


def _bar(placed: DataFrame, capacity: int, most: int) -> int:
    """The fill under which containers are given up: POOR below the capacity, or less where more than ``most`` items would be."""
    # at most a row for each fill
    held = placed.where(F.col("used") < capacity * (1 - POOR)).groupBy("used").agg(F.count("*").alias("n")).collect()
    total, bar = 0, 0
    for r in sorted(held, key=lambda r: r["used"]):
        total += r["n"]
        if total > most:
            break
        bar = r["used"] + 1
    return bar
