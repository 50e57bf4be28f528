"""Missing or wrong document language labels: a byte CNN over fixed windows of sentences.

A text is cut into sentences; what is no language in them (numbers, codes, file names, short quoted words)
is blanked, and a sentence with too few words left is none. Each sentence's bytes go through the network in
fixed windows, its language is that of the summed log probabilities. The network is trained in numpy on a bounded sample of
the labelled documents, twice: the second time without the windows whose label the first network
finds implausible, for some labels are wrong. Its weights are kept in the shared folder under a hash of sample and settings, so that the same
documents train it once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import shared_folder
from .byte_cnn import EMBEDDING, FILTERS, WIDTHS, WINDOW, ByteCNN, as_array, windows

# The languages told apart and how labels write them.
SPELLINGS = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pl": ("pl", "pol", "polish", "polski"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "tr": ("tr", "tur", "turkish", "türkçe", "turkce"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "漢語", "普通话"),
}
LANGUAGES = tuple(SPELLINGS)
_BY_SPELLING = {s: code for code, spellings in SPELLINGS.items() for s in spellings}

#: Bounds of the training sample: documents a language, sentences a document.
SAMPLE_DOCUMENTS = 300
SAMPLE_SENTENCES = 6
#: Windows of a sentence, spread over the whole of it, and how often a sentence that many of those documents have counts at most.
SAMPLE_WINDOWS = 7
SAMPLE_REPEATS = 6
#: A sentence under this confidence counts for the text's main language, unless that is very unlikely for it.
SURE = 0.9

_BOUNDARY = re.compile(r"[\n\r\u2028\u2029\u0085。！？.!?…](?:(?<![.!?…])|(?=[\"”»)\]']*\s))")
# a full stop after a number may be that of an ordinal: a capital letter must follow, behind a mark maybe
_CAPITAL = re.compile(r"\s+(?:[^\w\s]{1,3}\s+)?[^\W\d_a-zà-öø-ÿ]")
# before a small letter it ends a sentence only if enough stands on both sides
_NUMBER_STOP = re.compile(r"(?<=\d\.)\s+(?=[a-zà-öø-ÿа-яё])")
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»\n.!?。]{1,40}[\"”“»]")
# a run of ASCII that holds a sign of code is judged whole; it begins where a run begins, so a run of any length is read once
_CODE = re.compile(r"(?<![!-~])[!-~]*[0-9=_{}|<>@/\\#][!-~]*")
_WORD = re.compile(r"[^\W\d_]{2,}")
_HAN = re.compile(r"[㐀-鿿]")
_NO_LETTER = re.compile(r"[\W\d_]+")


def label_language(label: str | None) -> str | None:
    """The language a label names, by code, name in English or its own language, or regional tag; else null."""
    low = unicodedata.normalize("NFC", (label or "").strip().casefold())
    return _BY_SPELLING.get(low) or _BY_SPELLING.get(re.split(r"[-_\s(]", low)[0])


def clean(sentence: str) -> str:
    """Its words as the network reads them, or '' if it is no sentence."""
    bare = _CODE.sub(" ", _QUOTED.sub(" ", sentence))
    han = 0 if bare.isascii() else len(_HAN.findall(bare))
    words = sum(1 for _ in islice(_WORD.finditer(bare), 4))
    ended = sentence.rstrip().rstrip(" \"”»)]'").endswith((".", "!", "?", "。", "！", "？", "…"))
    if not (han >= 4 or words >= 4 or (words >= 2 and ended)):
        return ""
    return _NO_LETTER.sub(" ", bare.casefold()).strip()


def _cut_at_numbers(text: str, cuts: list[int]) -> list[int]:
    """The cuts, and those after numbers that end a sentence before one that begins with a small letter."""
    out = [cuts[0]]
    for a, b in zip(cuts, cuts[1:]):
        places = [m.end() for m in _NUMBER_STOP.finditer(text, a, b)]
        for p, after in zip(places, [*places[1:], b]):
            if len(_WORD.findall(text, out[-1], p)) >= 4 and len(_WORD.findall(text, p, after)) >= 5:
                out.append(p)
        out.append(b)
    return out


def _after_number(text: str, at: int) -> bool:
    """Whether a full stop behind a digit stands before this place."""
    return at >= 2 and text[at - 1] == "." and text[at - 2].isdecimal()


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, cleaned words) of each sentence of a text, in order; places are code points."""
    if not text:
        return []
    plain = unicodedata.is_normalized("NFC", text)
    # composition moves places: a text is cut as it is and composed piece by piece
    cuts = [0, *[m.end() for m in _BOUNDARY.finditer(text) if not _after_number(text, m.end()) or _CAPITAL.match(text, m.end())], len(text)]
    if _NUMBER_STOP.search(text):
        cuts = _cut_at_numbers(text, cuts)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        piece = text[a:b]
        words = clean(piece if plain else unicodedata.normalize("NFC", piece))
        if words:
            lead = len(piece) - len(piece.lstrip())
            out.append((a + lead, a + len(piece.rstrip()), words))
    return out


class Reader:
    """Languages of cleaned sentences, with a memory for repeated ones."""

    def __init__(self, net: ByteCNN, remember: int = 100_000):
        self.net, self.known, self.remember = net, {}, remember

    def read(self, cleaned: list[str]) -> list[np.ndarray]:
        """Log probabilities of each sentence, the mean over its windows weighed by nothing but number."""
        if len(self.known) > self.remember:
            self.known.clear()
        new = [s for s in dict.fromkeys(cleaned) if s not in self.known]
        parts = [windows(s.encode()) for s in new]
        logs = self.net.log_probabilities(as_array([p for w in parts for p in w]))
        at = 0
        for s, w in zip(new, parts):
            z = logs[at : at + len(w)].sum(0)
            self.known[s] = z - np.logaddexp.reduce(z)
            at += len(w)
        return [self.known[s] for s in cleaned]


def text_languages(logs: list[np.ndarray], sure: float = SURE) -> list[int]:
    """The class of each sentence of one text. An unsure one is of the likeliest language that others of the
    text surely have, unless none of those is plausible for it."""
    if not logs:
        return []
    z = np.stack(logs)
    first = z.argmax(1)
    strong = z.max(1) >= np.log(sure)
    sure_ones = np.unique(first[strong])
    if not len(sure_ones):
        total = z.sum(0)
        sure_ones = np.array([total.argmax()])
    best = sure_ones[z[:, sure_ones].argmax(1)]
    follow = ~strong & (z[np.arange(len(z)), best] > np.log(0.01))
    return np.where(follow, best, first).tolist()


def languages_of(classes: list[int]) -> list[int]:
    """The languages of a text: the only one, or those of at least two sentences."""
    seen: dict[int, int] = {}
    for c in classes:
        seen[c] = seen.get(c, 0) + 1
    return list(seen) if len(seen) == 1 else [c for c, n in seen.items() if n >= 2]


def labelled_sample(documents: DataFrame, per_language: int = SAMPLE_DOCUMENTS, per_text: int = SAMPLE_SENTENCES) -> list[tuple[str, bytes]]:
    """(language, window of a cleaned sentence) pairs, at most per_language * per_text * SAMPLE_WINDOWS for each language.

    The documents are those with the lowest hashes of their ids, so the sample doesn't depend on any order.
    """
    of = F.lit(None).cast("string")
    low = F.lower(N.strip("lang"))
    head = F.regexp_extract(low, r"\A([^-_\s(]+)", 1)
    for code, spellings in SPELLINGS.items():
        of = F.when(head.isin(*spellings), F.lit(code)).otherwise(of)
    order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        documents.select("doc_id", of.alias("code"))
        .where(F.col("code").isNotNull() & documents["text"].isNotNull())
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= per_language)
        .select("doc_id", "code")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(dict.fromkeys(s for _, _, s in sentences(text)))
                step = max(1, len(found) // per_text)
                for words in found[::step][:per_text]:
                    parts = windows(words.encode())
                    wide = -(-len(parts) // SAMPLE_WINDOWS)
                    rows.append((code, parts[::wide]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], names=["code", "parts"])

    # ids has at most per_language rows for each language: a bounded broadcast
    picked = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("code", "text").mapInArrow(cut, "code string, parts array<binary>")
    counted = picked.groupBy("code", "parts").agg(F.least(F.count("*"), F.lit(SAMPLE_REPEATS)).alias("n"))
    return sorted((r["code"], bytes(part)) for r in counted.collect() for part in r["parts"] for _ in range(r["n"]))


def train(sample: list[tuple[str, str | bytes]], epochs: int = 1, seed: int = 0, least: int = 3) -> ByteCNN:
    """A network from (language, sentence or window of one) pairs; languages with fewer than ``least`` of them are left out.

    Without any pairs the network knows no language.
    """
    counts: dict[str, int] = {}
    for code, _ in sample:
        counts[code] = counts.get(code, 0) + 1
    classes = tuple(sorted(c for c, n in counts.items() if n >= least))
    parts, labels = [], []
    for code, words in sample:
        if code in classes:
            for part in windows(words if isinstance(words, bytes) else words.encode()):
                parts.append(part)
                labels.append(classes.index(code))
    net = ByteCNN.fresh(classes, seed)
    if not parts:
        return net
    x, y = as_array(parts), np.array(labels)
    # small samples get more passes, so that every sample is seen by about as many steps
    passes = max(epochs, min(60, 12_000 // len(x)))
    net.fit(x, y, passes, seed)
    plausible = net.log_probabilities(x)[np.arange(len(y)), y] > np.log(0.15)
    if plausible.sum() > len(classes):
        net = ByteCNN.fresh(classes, seed + 1)
        net.fit(x[plausible], y[plausible], passes + 1, seed + 1)
    return net


def trained(documents: DataFrame) -> ByteCNN:
    """The network of the documents' labelled sample: the one kept in the shared folder, or a new one that is kept there.

    A task on an executor trains it, for a driver has other work; what comes back is a row for each array of weights.
    """
    spark = documents.sparkSession
    sample = labelled_sample(documents)
    settings = (SAMPLE_DOCUMENTS, SAMPLE_SENTENCES, SAMPLE_WINDOWS, SAMPLE_REPEATS, WINDOW, WIDTHS, FILTERS, EMBEDDING)
    name = hashlib.sha256(repr((settings, sample)).encode()).hexdigest()[:32]
    if name not in _networks:
        path = f"{shared_folder(spark)}/language-{name}"
        try:
            held = spark.read.parquet(path).collect()
        except AnalysisException:
            rows = spark.createDataFrame([(c, bytearray(w)) for c, w in sample], "code string, part binary")
            rows.repartition(1).mapInArrow(_train_on, "name string, classes string, shape array<int>, data binary").write.mode("overwrite").parquet(path)
            held = spark.read.parquet(path).collect()
        # no labelled sentence, no language
        classes = tuple(c for c in held[0]["classes"].split(",") if c) if held else ()
        _networks[name] = ByteCNN(classes, weights={r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in held})
    return _networks[name]


def _train_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of a network trained on all rows (code, part), whatever their order."""
    sample = sorted((code, part) for batch in batches for code, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    net = train(sample)
    names = sorted(net.weights)
    values = [np.ascontiguousarray(net.weights[k], np.float32) for k in names]
    columns = [pa.array(names), pa.array([",".join(net.classes)] * len(names)), pa.array([list(v.shape) for v in values], pa.list_(pa.int32())), pa.array([v.tobytes() for v in values], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["name", "classes", "shape", "data"])


_networks: dict[str, ByteCNN] = {}


def short_words(text: str | None) -> str:
    """The words of a text that has no sentence, if there are two or more; '' else."""
    bare = _CODE.sub(" ", unicodedata.normalize("NFC", text or ""))
    return _NO_LETTER.sub(" ", bare.casefold()).strip() if len(_WORD.findall(bare)) >= 2 or len(_HAN.findall(bare)) >= 2 else ""


def detect(documents: DataFrame, net: ByteCNN | None = None) -> DataFrame:
    """One row for each stretch of a text in one language, and for each text without a language one without.

    (doc_id, label, segment, start, end, n_sentences, lang, confidence, in_text): label is what ``lang`` names, start and end are
    code points, confidence is the mean probability of the stretch's sentences, in_text whether the text counts as
    having that language. A text of some words but no sentence has one stretch of no sentences, with the confidence of its words, that doesn't
    count. Null, empty and wordless texts have segment, lang and confidence null, as have all where no labelled document is there to
    learn from. Repeated rows are read each.
    """
    if net is None:
        net = trained(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(net)
    names = ("label", "segment", "start", "end", "n_sentences", "lang", "confidence", "in_text")
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        classes = reader.net.classes
        for batch in batches:
            # a network that knows no language can't name one
            texts = batch.column(2).to_pylist()
            cut = [sentences(t) if classes else [] for t in texts]
            short = [short_words(t) if classes and not c else "" for t, c in zip(texts, cut)]
            logs = iter(reader.read([s for c in cut for _, _, s in c]))
            guesses = iter(reader.read([s for s in short if s]))
            where, rows = [], []
            for k, (spans, label) in enumerate(zip(cut, batch.column(1).to_pylist())):
                own = [next(logs) for _ in spans]
                found = text_languages(own)
                within = set(languages_of(found))
                label = label_language(label)
                if short[k]:
                    z = next(guesses)
                    where.append(k)
                    rows.append((label, 0, 0, len(texts[k]), 0, classes[int(z.argmax())], round(float(np.exp(z.max())), 4), False))
                elif not spans:
                    where.append(k)
                    rows.append((label, None, None, None, 0, None, None, False))
                at = segment = 0
                while at < len(spans):
                    to = at
                    while to + 1 < len(spans) and found[to + 1] == found[at]:
                        to += 1
                    sure = float(np.mean([np.exp(z[found[at]]) for z in own[at : to + 1]]))
                    where.append(k)
                    rows.append((label, segment, spans[at][0], spans[to][1], to - at + 1, classes[found[at]], round(sure, 4), found[at] in within))
                    at, segment = to + 1, segment + 1
            ids = batch.column(0).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]], names=["doc_id", *names])

    schema = f"doc_id {kind}, label string, segment int, start int, `end` int, n_sentences int, lang string, confidence double, in_text boolean"
    return documents.select("doc_id", "lang", "text").mapInArrow(run, schema)


def document_languages(detected: DataFrame) -> DataFrame:
    """(doc_id, label, lang, n_sentences, confidence): the languages of each text.

    Where none counts as the text's, for it is short or each sentence has another, the one of most sentences and confidence; no words, no row.
    """
    n = F.greatest("n_sentences", F.lit(1))
    per = (
        detected.where("lang is not null")
        .groupBy("doc_id", "label", "lang")
        .agg(F.sum("n_sentences").alias("n_sentences"), (F.sum(F.col("confidence") * n) / F.sum(n)).alias("confidence"), F.max("in_text").alias("in_text"))
    )
    # at most one entry a language
    one = per.groupBy("doc_id", "label").agg(F.collect_list(F.struct("in_text", "n_sentences", "confidence", "lang")).alias("all"))
    own = F.filter("all", lambda x: x["in_text"])
    kept = F.when(F.size(own) > 0, own).otherwise(F.array(F.array_max("all")))
    return one.select("doc_id", "label", F.explode(kept).alias("x")).select("doc_id", "label", "x.lang", "x.n_sentences", "x.confidence")


def label_errors(detected: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of each document whose label is missing or not its text's, and of each mixed document."""
    langs = detected.where("in_text").groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("label").alias("label"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return langs.where(wrong).select("doc_id", F.explode("langs").alias("lang"))
