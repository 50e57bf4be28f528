import random

import numpy as np
import pytest

from splitwright.llm import language as L
from splitwright.llm.byte_cnn import ByteCNN, as_array, windows

# invented sentences, three openings and three endings for each language
PARTS = {
    "de": (["Die Lampe stand gestern", "Niemand hat die Kiste", "Wir haben alle Bilder"], ["auf dem alten Tisch.", "noch einmal geprüft.", "zu spät gefunden."]),
    "en": (["The lamp stood yesterday", "Nobody has the box", "We have all pictures"], ["on the old table.", "checked once more.", "found far too late."]),
    "es": (["La lámpara estaba ayer", "Nadie ha mirado la caja", "Tenemos todas las fotos"], ["sobre la mesa vieja.", "una vez más hoy.", "demasiado tarde."]),
    "ru": (["Лампа вчера стояла", "Никто не смотрел коробку", "У нас есть все снимки"], ["на старом столе.", "ещё один раз.", "слишком поздно."]),
    "zh": (["昨天灯放在那里", "没有人看过这个盒子", "我们有所有的照片"], ["在旧桌子上面。", "再检查了一次。", "发现得太晚了。"]),
}


def sentence(code, rng):
    a, b = PARTS[code]
    return f"{rng.choice(a)}{'' if code == 'zh' else ' '}{rng.choice(b)}"


def text(code, rng, n=4):
    return " ".join(sentence(code, rng) for _ in range(n))


@pytest.fixture(scope="module")
def net():
    rng = random.Random(0)
    pairs = [(c, w) for c in PARTS for _ in range(60) for _, _, w in L.sentences(sentence(c, rng))]
    return L.train(pairs)


def test_labels():
    good = {" DE ": "de", "en_GB": "en", "Deutsch": "de", "zh-Hans": "zh", "français": "fr", "français": "fr", "spa": "es", "русский": "ru"}
    assert {k: L.label_language(k) for k in good} == good
    assert [L.label_language(x) for x in (None, "", "und", "xx", "mul", "N/A", "uk")] == [None] * 7


def test_sentences_have_places_and_skip_what_is_no_language():
    t = 'IMG_0001.jpg\nThe lamp stood here. "ad hoc". See also row 35. Next one begins.\n{"imgsz": 640, "batch": 4}\n0.1 0.2 0.3\nC284: 176µF ±12'
    assert [t[a:b] for a, b, _ in L.sentences(t)] == ["The lamp stood here.", "See also row 35.", "Next one begins."]
    assert L.sentences(None) == [] == L.sentences("") == L.sentences("AAAA" * 5000) == L.sentences("12 34\n\n\t")
    assert len(L.sentences("灯移动以后阴影变得柔和。其他都没有动。")) == 2


def test_full_stops_after_numbers():
    cut = lambda t: [t[a:b] for a, b, _ in L.sentences(t)]
    assert len(cut("See also row 35. The lamp stood there. / Nobody came to row 36. / We left.")) == 4
    assert len(cut("the two lists disagree on row 135. training stopped after sixty epochs because of it.")) == 2
    assert len(cut("Lamba bu yüzden durdu ve 70. satır yeniden okunmalı.")) == 1


def test_a_long_run_is_read_in_linear_time():
    assert L.sentences("A" * 2_000_000) == [] and len(L.sentences("the lamp stood here and " * 50_000 + ".")) == 1


def test_windows():
    assert windows(b"abc", 4) == [b"abc"] and windows(b"abcdefghij", 4) == [b"abcd", b"efgh", b"ghij"]
    assert as_array([b"ab"], 4).tolist() == [[97, 98, 0, 0]] and as_array([], 4).shape == (0, 4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = ByteCNN.fresh(("a", "b"), filters=3, embedding=4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = rng.integers(1, 256, (3, 64)).astype(np.uint8), np.array([0, 1, 0])

    class NoDrop:
        def random(self, shape):
            return np.full(shape, 0.9)

    g = net._gradients(x, y, np.full(3, 0.75), NoDrop())  # what is kept is scaled by 1 / 0.75
    scale = 1 / 0.75

    def loss():
        f = net._features(x)[0] * scale
        z = f @ net.weights["out"] + net.weights["out_bias"]
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
        return -0.75 * z[np.arange(3), y].mean()

    for name in ("out", "conv3", "bias2"):
        w = net.weights[name]
        at = tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_held_out_accuracy(net):
    rng = random.Random(9)
    reader = L.Reader(net)
    right = total = 0
    for code in PARTS:
        for _ in range(20):
            s = sentence(code, rng).upper() if rng.random() < 0.3 else sentence(code, rng) + " " + sentence(code, rng).lower()
            for z in reader.read([w for _, _, w in L.sentences(s)]):
                right += net.classes[int(z.argmax())] == code
                total += 1
    assert right / total >= 0.95


def test_rules_for_texts():
    sure, unsure = np.log([0.97, 0.01, 0.02]), np.log([0.3, 0.4, 0.3])
    other = np.log([0.01, 0.97, 0.02])
    assert L.text_languages([sure, unsure, sure]) == [0, 0, 0]
    assert L.text_languages([sure, other, unsure]) == [0, 1, 1]
    assert L.text_languages([]) == []
    assert L.languages_of([0]) == [0] and L.languages_of([0, 0, 1]) == [0] and sorted(L.languages_of([0, 0, 1, 1])) == [0, 1]


def frame(spark, rows_):
    return spark.createDataFrame([(i, lang, t, "clash", 0) for i, (lang, t) in enumerate(rows_)], "doc_id long, lang string, text string, label string, segment int")


def test_label_errors(spark, net, rows):
    rng = random.Random(5)
    en, de, zh = (text(c, rng) for c in ("en", "de", "zh"))
    df = frame(
        spark,
        [("en", en), ("Deutsch", de), ("fr", en), (None, zh), ("und", de), ("de", de + "\n" + en), ("en", en + " " + sentence("ru", rng)), ("en", None), (None, ""), (None, "123\n{}"), ("xx", 'C1: 3pF "niet zeker"')],
    )
    got = rows(L.label_errors(L.detect(df, net)))
    assert got == [(2, "en"), (3, "zh"), (4, "de"), (5, "de"), (5, "en")]


def test_segments_cover_stretches(spark, net):
    rng = random.Random(6)
    de, en = text("de", rng), text("en", rng)
    t = f"{de}\n[07:59:41] 191/300 0.7\n{en}"
    got = [r for r in L.detect(frame(spark, [("de", t)]), net).orderBy("segment").collect()]
    assert [(r["lang"], r["n_sentences"]) for r in got] == [("de", 4), ("en", 4)]
    assert t[got[0]["start"] : got[0]["end"]] == de and t[got[1]["start"] : got[1]["end"]] == en
    assert all(0 < r["confidence"] <= 1 and r["in_text"] for r in got)


def test_sample_is_bounded_and_learns_from_wrong_labels(spark, rows):
    rng = random.Random(7)
    codes = ["de", "en", "es", "ru"]
    docs = [(c if rng.random() > 0.08 else rng.choice(codes), text(c, rng, 6)) for c in codes for _ in range(40)]
    df = frame(spark, docs + [(None, docs[0][1]), ("de", None)])
    sample = L.labelled_sample(df, per_language=30, per_text=3)
    n = {c: sum(1 for k, _ in sample if k == c) for c in codes}
    assert all(0 < v <= 90 for v in n.values()) and sample == L.labelled_sample(df.repartition(7), per_language=30, per_text=3)
    one = {r["doc_id"]: r["lang"] for r in L.document_languages(L.detect(df, L.train(sample))).collect()}
    truth = [c for c in codes for _ in range(40)]
    assert sum(one.get(i) == c for i, c in enumerate(truth)) >= 0.97 * len(truth)


def test_nothing_to_learn_from(spark, rows):
    df = frame(spark, [(None, "The lamp stood on the table."), ("xx", None)])
    assert {r["lang"] for r in L.detect(df).collect()} == {None}
    assert rows(L.label_errors(L.detect(df))) == []
    assert rows(L.detect(frame(spark, []))) == []


def test_the_same_documents_train_once(spark, monkeypatch):
    rng = random.Random(8)
    df = frame(spark, [(c, text(c, rng)) for c in PARTS for _ in range(12)])
    first = L.trained(df)
    L._networks.clear()
    monkeypatch.setattr(L, "_train_on", None)  # a second training would fail
    again = L.trained(df)
    assert again.classes == first.classes
    assert all(np.array_equal(again.weights[k], v) for k, v in first.weights.items())


def test_long_sentences_are_sampled_over_their_whole_length(spark):
    long = " ".join("".join(chr(97 + k // 26**e % 26) for e in range(4)) for k in range(4000)) + " lastword."
    parts = [p for _, p in L.labelled_sample(frame(spark, [("en", long)]))]
    assert 2 < len(parts) <= L.SAMPLE_WINDOWS and len(set(parts)) > 1
    data = L.clean(long).encode()
    assert max(data.find(p) for p in parts) > len(data) * 0.8


def test_short_texts_get_a_language_that_does_not_count(spark, net):
    df = frame(spark, [(None, "stand gestern"), (None, "IMG_0001.jpg"), (None, "12 34"), (None, PARTS["en"][0][0] + " on it.\n" + PARTS["ru"][0][0] + " там.")])
    found = L.detect(df, net)
    assert found.where("in_text").count() == 0 == L.label_errors(found).count()
    got = {r["doc_id"]: r for r in L.document_languages(found).collect()}
    assert set(got) == {0, 3} and got[0]["n_sentences"] == 0 and got[3]["n_sentences"] == 1


def test_windows_in_any_batch_are_read_alike(net):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (77, 64)).astype(np.uint8)
    f = net._features(x)[0] @ net.weights["out"] + net.weights["out_bias"]
    want = f - np.logaddexp.reduce(f, axis=1)[:, None]
    assert np.allclose(net.log_probabilities(x), want, atol=1e-4) and np.allclose(net.log_probabilities(x, 5), want, atol=1e-4)
