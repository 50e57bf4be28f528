import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from splitwright.llm import encode as E
from splitwright.llm import pack as P

PATH = E.vocabulary_path()
TEXTS = ["", None, "a", "<|endoftext|>", "é́ 日本 👩‍🔧", "\x00\x07\r\n\t ", "a" * 300_000, "row 35. " * 5000, " leading", "a", "१२ ﬁ ½"]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def test_round_trip_and_defined_ids(spark):
    df = documents(spark)
    ids = {r["doc_id"]: r["ids"] for r in E.encode(df).collect()}
    assert ids[0] == [] and ids[1] is None and 50256 not in ids[3]
    back = {r["doc_id"]: r["text"] for r in E.decode(E.encode(df)).collect()}
    assert back == dict(enumerate(TEXTS))


def test_same_ids_as_another_library(spark):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    P_ = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P_.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P_.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for t in TEXTS if t and len(t) < 50_000]
    assert E.encode_texts(texts, PATH) == [other.encode_ordinary(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.text())
def test_any_text_comes_back(text):
    assert E.decode_ids(E.encode_texts([text], PATH)[0], PATH) == text


def test_offsets_cover_the_text(spark):
    texts = ["Küche 日本 x", "", None]
    got = {r["doc_id"]: r for r in E.encode_with_offsets(documents(spark, texts)).collect()}
    assert got[2]["ids"] is None and got[1]["starts"] == []
    spans = list(zip(got[0]["starts"], got[0]["ends"]))
    assert spans[0][0] == 0 and spans[-1][1] == len(texts[0]) and all(a <= b for a, b in spans)
    assert got[0]["ids"] == E.encode_texts(texts[:1], PATH)[0]


def test_counts_and_empty_table(spark, rows):
    assert rows(E.count_tokens(documents(spark, ["", None, "a"]))) == [(0, 0), (1, None), (2, 1)]
    assert rows(E.encode(documents(spark, []))) == []


def check(out, tokens, loss, capacity, segments, loss_capacity):
    n = out.max() + 1 if len(out) else 0
    assert (np.bincount(out, minlength=n) > 0).all() and (np.bincount(out) <= segments).all()
    assert (np.bincount(out, weights=tokens) <= capacity).all() and (np.bincount(out, weights=loss) <= loss_capacity).all()
    return n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=80), st.integers(1, 8), st.integers(30, 60))
def test_any_items_fit(sizes, segments, loss_capacity):
    tokens = np.array(sizes)
    loss = np.minimum(tokens // 2, 30)
    check(P.fill(tokens, loss, 60, segments, loss_capacity), tokens, loss, 60, segments, loss_capacity)


def test_nearly_nothing_is_wasted():
    rng = np.random.default_rng(0)
    tokens = np.clip(rng.lognormal(5, 1, 6000).astype(int), 1, 2048)
    n = check(P.fill(tokens, tokens - 1, 2048, 512, 2048), tokens, tokens - 1, 2048, 512, 2048)
    assert n <= -(-tokens.sum() // 2048) + 2


@pytest.mark.parametrize("shard", [60_000, 150])
def test_every_piece_is_placed_once(spark, ws, shard):
    texts = ["word " * k for k in range(0, 900, 3)] + ["x y z " * 3000, None, "", "word word", "word word"]
    df = documents(spark, texts)
    items = {(r["doc_id"], r["piece"]): r for r in P.pieces(df, capacity=512).collect()}
    got = P.pack(P.pieces(df, capacity=512), ws, capacity=512, shard=shard).collect()
    assert len(got) == len(items) and {(r["doc_id"], r["piece"]) for r in got} == set(items)
    used = {}
    for r in got:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["tokens"]
    total = sum(used.values())
    assert max(used.values()) <= 512 and total == sum(len(i or ()) for i in E.encode_texts(texts, PATH))
    assert len(used) <= -(-total // 512) + (2 if shard > 1000 else 8)


def test_only_too_long_texts_are_cut(spark, rows):
    got = rows(P.pieces(documents(spark, ["a b c", "a " * 50, None, ""]), capacity=40).select("doc_id", "piece", "first_token", "tokens", "loss_tokens"))
    assert got[0] == (0, 0, 0, 3, 2) and [r[0] for r in got] == [0, 1, 1] and got[1][3] == 40 and got[2][2] == 40


def test_too_large_an_item_is_an_error(spark, ws):
    items = spark.createDataFrame([(1, 0, 0, 90, 89)], "doc_id long, piece int, first_token long, tokens int, loss_tokens int")
    with pytest.raises(Exception, match="larger than a container"):
        P.pack(items, ws, capacity=50).collect()


def test_nothing_to_pack(spark, ws, rows):
    assert rows(P.pack(P.pieces(documents(spark, ["", None])), ws)) == []


def test_words_are_cut_as_the_library_cuts_them():
    import random

    rng, tokenizer = random.Random(5), E.load(PATH)
    odd = [chr(c) for c in (*range(256), 0x2BC, 0x300, 0x345, 0x3F4, 0x660, 0x1680, 0x180E, 0x2028, 0x202F, 0x2160, 0xFEFF, 0x1F600, 0x1FAE8, 0x20000)]
    texts = ["".join(rng.choice(["a", " ", "  ", "7", "'s", "'", "\n", "!", "é", rng.choice(odd)]) for _ in range(rng.randrange(12))) for _ in range(4000)]
    assert E.encode_texts(texts, PATH) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_prompts_bear_no_loss(spark):
    texts = ["Say it. Then more words", "One line\nand another", "no prompt at all.", "½ odd. And more"]
    sizes = list(P.text_sizes(texts, PATH))
    ids = E.encode_texts(["Say it.", "One line\n", "", "½ odd."], PATH)
    assert [p for _, p in sizes] == [len(i) for i in ids]
    got = {r["doc_id"]: (r["tokens"], r["loss_tokens"]) for r in P.pieces(documents(spark, texts)).collect()}
    assert got == {k: (n, n - max(1, p)) for k, (n, p) in enumerate(sizes)}


def test_an_item_over_a_side_limit_is_alone():
    tokens, loss = np.array([50, 50, 10, 10, 10]), np.array([45, 5, 0, 0, 0])
    out = P.fill(tokens, loss, 100, 3, 40)
    assert (out == out[0]).sum() == 1 and (np.bincount(out) <= 3).all()


def test_every_shard_is_a_task_and_leavings_meet(spark, ws):
    # sizes that combine badly: nothing but more than a third and less than a half
    items = spark.range(4000).selectExpr("id AS doc_id", "0 AS piece", "0L AS first_token", "CAST(700 + pmod(xxhash64(id), 320) AS int) AS tokens", "100 AS loss_tokens")
    got = P.pack(items, ws, shard=500)
    assert got.count() == 4000 and got.select("doc_id").distinct().count() == 4000
    used = [r["u"] for r in got.groupBy("container_id").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "u").collect()]
    assert max(used) <= 2048 and len(used) <= 2010
