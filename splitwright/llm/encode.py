"""Encoding whole texts with a public byte-level BPE, and decoding back, over Arrow batches.

The vocabulary file is a parameter and is read on the executors, once a worker; its folder is the
installed package of public tokenizers unless another is given. Ids are those of the text's bytes; the strings of special
tokens are ordinary text.

A byte-level vocabulary encodes the words that its pattern cuts a text into one by one, so each different word goes through the library
once a worker and is looked up after that. Where the library's Unicode tables might cut differently, for a text has a character that is young or
changed its kind, and for vocabularies of another build the whole text goes through the library, in slices of bounded size.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
#: Characters handed to the library at once.
SLICE = 400_000
#: Words a worker remembers, and the longest that it does.
REMEMBERED = 300_000
LONGEST = 100
# Fixed value: the pattern byte-level vocabularies of this family cut texts by, in the standard library's words for letters, numbers and
# spaces; the characters for which those mean another thing are among the unsettled ones.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """Where a vocabulary file lies: in ``folder``, or in the installed package."""
    if folder:
        return str(Path(folder) / name)
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return str(Path("/opt/tokenizers") / name)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a vocabulary file; special tokens' strings are read as ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=1)
def byte_characters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, for the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id."""
    table = byte_characters()
    vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        # a special token's string is no byte string
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def decode_ids(ids, path: str) -> str:
    """The text of ids. Bytes of a character may be spread over tokens, so they are joined before they are read."""
    pieces = token_bytes(path)
    return b"".join(pieces[i] for i in ids).decode("utf-8", errors="replace")


def slices(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of runs of texts with about ``most`` characters; nulls as empty texts."""
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= most or len(held) >= 1024:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


@lru_cache(maxsize=1)
def _unsettled() -> frozenset[str]:
    """Characters that tables of different age or kind may count for letters, numbers, spaces or others.

    All that the oldest table lacks or has otherwise, numbers that are no decimal digits, and the separators that only the standard library takes for spaces.
    """
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    every = map(chr, range(0x30000))
    return frozenset(c for c in every if old(c) == "Cn" or old(c)[0] != new(c)[0] or new(c) in ("Nl", "No") or "\x1c" <= c <= "\x1f")


def _settled(text: str) -> bool:
    return text.isascii() and not re.search("[\x1c-\x1f]", text) or (_unsettled().isdisjoint(held := set(text)) and max(held, default="") < "\U00030000")


@lru_cache(maxsize=4)
def _by_words(path: str) -> bool:
    """Whether a vocabulary file says that texts are cut by WORDS and by nothing else."""
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    cut = file.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not file.get("normalizer")
    return plain and file["model"].get("type") == "BPE" and not file["model"].get("dropout") and all(t.get("special") for t in file.get("added_tokens") or ())


@lru_cache(maxsize=4)
def _known(path: str) -> dict[str, list[int]]:
    return {}


def cut_texts(texts: list[str | None], path: str) -> Iterator[tuple[list[str] | None, dict[str, list[int]], list[int] | None]]:
    """(words, their ids, None) of each text, or (None, {}, ids) where it was encoded as a whole; nulls as empty texts."""
    tokenizer, known = load(path), _known(path)
    fast = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    by_words = _by_words(path)
    for _, part in slices(texts):
        cut = [WORDS.findall(t) if by_words and _settled(t) else None for t in part]
        whole = iter(fast([t for t, c in zip(part, cut) if c is None], add_special_tokens=False))
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w for c in cut if c is not None for w in c if w not in known})
        ids = known
        found = [e.ids for e in fast(new, add_special_tokens=False)]
        if any(len(w) > LONGEST for w in new):
            ids = known | dict(zip(new, found))
        known.update((w, i) for w, i in zip(new, found) if len(w) <= LONGEST)
        for c in cut:
            yield (c, ids, None) if c is not None else (None, {}, next(whole).ids)


def encode_texts(texts: list[str | None], path: str) -> list[list[int] | None]:
    """The ids of each text; a null's are null."""
    out: list[list[int] | None] = []
    for text, (words, ids, whole) in zip(texts, cut_texts(texts, path)):
        out.append(None if text is None else whole if words is None else list(chain.from_iterable(map(ids.__getitem__, words))))
    return out


def _lists(values: list[list[int] | None]) -> pa.Array:
    """An Arrow array of lists of integers."""
    offsets = np.concatenate([[0], np.cumsum([len(v or ()) for v in values])]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(v or () for v in values), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([v is None for v in values], pa.bool_()))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's text. An empty text gives an empty list, a null text null.

    One pass over the rows, no shuffle; repeated rows are encoded each, further columns are left behind.
    """
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(encode_texts(batch.column(1).to_pylist(), path))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def encode_with_offsets(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids, starts, ends): as encode, with each token's place in code points of the text.

    A token that holds only part of a character's bytes has that character as its place. Null for a null text.
    """
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns: list[list[list[int] | None]] = [[], [], []]
            for start, part in slices(texts):
                for k, e in enumerate(tokenizer.encode_batch(part, add_special_tokens=False)):
                    void = texts[start + k] is None
                    for column, values in zip(columns, (e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets])):
                        column.append(None if void else values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.list_(pa.int32())) for c in columns]], names=[key, "ids", "starts", "ends"]
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, text): the texts of token ids; an empty list gives an empty text, null gives null."""
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens): the number of tokens; null for a null text."""
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [None if i is None else len(i) for i in encode_texts(batch.column(1).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def count_bytes(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, n_bytes): the length of the bytes that token ids stand for; null for null."""
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = np.array([len(b) for b in token_bytes(path)])
        for batch in batches:
            n = [None if x is None else int(long[np.array(x, np.int64)].sum()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_bytes"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, n_bytes long")
