"""Toxicity by multiple-instance learning: sentences are instances, documents bags.

A sentence's probability is a logistic function of its words' weights; a
document's is the noisy-or over its sentences, so a single bad sentence makes
a bad document. Weights are fitted to document labels only (the gradient of
the noisy-or likelihood reaches each sentence by its responsibility), and the
sentence probabilities then say where the offence is. A word's weight is the
sum of its own, its prefixes' and its suffix's, so inflected forms share what
is learned.

Fitting takes the labelled training documents, at most ``MAX_FIT`` of them by
lowest hash of the id (a documented bound of the classifier's sample; all
scoring covers every whole text).

Defined results: null, empty and wordless texts have no sentence and score the
bias's probability of an empty sentence; labels that are null are not used; of
several labels for an id the largest counts; without labelled rows of both
classes every score is 0; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The classifier's sample: labelled documents at most.
MAX_FIT = 6_000
#: Words of a feature table entry that occur in fewer training documents carry no weight.
MIN_DOCS = 4
EPOCHS = 150
#: Letters stay, sentence ends become line ends, every other ASCII byte a blank; bytes of other characters stay.
SPLIT = bytes(b if 97 <= b <= 122 or b >= 128 else 10 if b in b".!?\n\r" else 32 for b in range(256))
#: Quotation and opening marks outside ASCII, which part words.
MARKS = [x.encode() for x in "¡¿«»“”„‘’‚…–—\u00a0"]
SENTENCE = re.compile(r"[^.!?\n\r]+")


def bag(text: str) -> list[bytes]:
    """The sentences: lower-cased words between blanks."""
    out = text.lower().encode("utf-8", "replace").translate(SPLIT)
    if not out.isascii():
        for x in MARKS:
            out = out.replace(x, b" ")
    return [x for x in out.split(b"\n") if x and not x.isspace()]


def features(word: bytes) -> list[str]:
    word = word.decode("utf-8", "replace")
    own = [f"={word}"]
    if len(word) >= 4:
        own.append(f"<{word[:4]}")
    if len(word) >= 5:
        own.append(f"<{word[:5]}")
    if len(word) >= 6:
        own += (f"<{word[:6]}", f">{word[-4:]}")
    return own


class Model:
    """Weights of features and the bias; ``weights`` None scores everything 0."""

    def __init__(self, weights: dict[str, float] | None, bias: float = -8.0):
        self.weights, self.bias = weights, bias
        self.known: dict[bytes, float] = {}
        self.seen: set[bytes] = set()

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def learn(self, words: set[bytes]) -> None:
        """Enter words that are new; ``known`` holds those that carry weight, ``seen`` all."""
        if len(self.seen) > 500_000:
            self.seen.clear()
            self.known.clear()
        get = self.weights.get
        for w in words.difference(self.seen):
            if v := sum(get(f, 0.0) for f in features(w)):
                self.known[w] = v
        self.seen.update(words)

    def odds(self, sentence: bytes) -> float:
        """Log-odds of one sentence: the bias and each distinct word's weight."""
        known = self.known
        return self.bias + sum(known[w] for w in set(sentence.split()) if w in known)

    def scores(self, texts: list[str]) -> list[float]:
        """Noisy-or over the sentences of each text; the words of all texts are looked up together."""
        if self.weights is None:
            return [0.0] * len(texts)
        bags = [bag(t) for t in texts]
        words = [set(b" ".join(own).split()) for own in bags]
        every = set().union(*words)
        self.learn(every)
        charged = {w: self.known[w] for w in every.intersection(self.known)}
        bias, plain = self.bias, float(np.logaddexp(0.0, self.bias))
        out = []
        for own, has in zip(bags, words, strict=True):
            silent = plain * max(1, len(own))
            if not has.isdisjoint(charged):
                for s in own:
                    if v := sum([charged[w] for w in set(s.split()) if w in charged]):
                        silent += float(np.logaddexp(0.0, bias + v)) - plain
            out.append(-math.expm1(-silent))
        return out

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Offsets and probability of the sentences at ``least`` or more."""
        out = []
        for m in SENTENCE.finditer(text):
            for s in bag(m[0]):
                self.learn(set(s.split()))
                if (p := float(_sigmoid(self.odds(s)))) >= least:
                    out.append((m.start(), m.end(), p))
        return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def fit(texts: list[str], labels: list[int], min_docs: int = MIN_DOCS, epochs: int = EPOCHS, l2: float = 2e-5, rate: float = 0.3) -> Model:
    """Noisy-or likelihood with an L2 penalty, by full-batch Adam over sparse sentence rows."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(None)
    # Only features that tell the classes apart enter: 3 times the odds, in MIN_DOCS documents. Texts are taken
    # apart anew for each step, so that no more than one is held as words.
    def found_in(text: str) -> set[str]:
        return {f for w in set(b" ".join(bag(text)).split()) for f in features(w)}

    in_bad: dict[str, int] = {}
    for text, label in zip(texts, labels, strict=True):
        if label:
            for f in found_in(text):
                in_bad[f] = in_bad.get(f, 0) + 1
    in_bad = {f: n for f, n in in_bad.items() if n >= min_docs}
    in_good = dict.fromkeys(in_bad, 0)
    for text, label in zip(texts, labels, strict=True):
        if not label:
            for f in found_in(text).intersection(in_good):
                in_good[f] += 1
    bad, good = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    chosen = [f for f, n in in_bad.items() if (n + 0.5) / bad > 3 * (in_good[f] + 0.5) / good]
    ids = {f: i for i, f in enumerate(sorted(chosen))}
    rows, cols, doc, sentence = [], [], [], 0
    for d, text in enumerate(texts):
        for own in bag(text) or [b""]:
            for w in set(own.split()):
                for f in features(w):
                    if (i := ids.get(f)) is not None:
                        rows.append(sentence)
                        cols.append(i)
            doc.append(d)
            sentence += 1
    rows, cols, doc = np.asarray(rows, np.int64), np.asarray(cols, np.int64), np.asarray(doc, np.int64)
    weights, bias = np.zeros(len(ids)), -6.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for t in range(1, epochs + 1):
        odds = np.full(sentence, bias) + np.bincount(rows, weights[cols], sentence)
        p = _sigmoid(odds)
        silent = np.bincount(doc, np.logaddexp(0.0, odds), len(y))  # minus the log of no sentence being bad
        gain = np.where(y > 0, np.exp(-silent) / -np.expm1(-np.maximum(silent, 1e-12)), -1.0)
        by_sentence = gain[doc] * p
        g = np.append(np.bincount(cols, by_sentence[rows], len(ids)), by_sentence.sum()) / len(y)
        g[:-1] -= l2 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, bias = weights + step[:-1], min(bias + step[-1], -2.0)
    return Model({f: float(weights[i]) for f, i in ids.items() if abs(weights[i]) > 0.2}, float(bias))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT) -> Model:
    """The model of the ids that ``labels`` has, at most ``max_fit`` of them."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_fit)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    got = texts.join(F.broadcast(known), "_id").select("_id", "_text", "_y").toArrow().sort_by([("_id", "ascending"), ("_text", "ascending")])
    return fit(got.column("_text").to_pylist(), [int(x > 0) for x in got.column("_y").to_pylist()])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score (0 to 1) and spans (start, stop, probability of each sentence at 0.5 or more) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [x or "" for x in part.column("_text").to_pylist()]
                found = m.scores(texts)
                spans = [[{"start": a, "stop": b, "score": p} for a, b, p in m.spans(x)] if s >= 0.5 else [] for x, s in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(found, pa.float64()), pa.array(spans, span)], ["_id", "score", "spans"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"_id {kind}, score double, spans array<struct<start:long,stop:long,score:double>>"
    )
    return out.withColumnRenamed("_id", id_col)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score under ``threshold``, all their columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, text_col):
                keep = [s < threshold for s in m.scores([x or "" for x in part.column(at).to_pylist()])]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
