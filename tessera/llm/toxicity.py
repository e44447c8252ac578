"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in hashed word and word-prefix features. Each different
word of the sentence counts once, in training and in scoring, whatever stands around it; the document's probability is the noisy-or 1 - prod(1 - p). Only documents are labelled: the likelihood of the bag
labels trains the sentence model, which then locates the offending sentences.

The model is fitted on a bounded sample of labelled rows: at most SAMPLE rows of each class, taken by hash of the
doc_id, whatever their length. Of a text above BAG_CHARS code points the bag is first a sample of its sentences
by hash; the model fitted on these then reads the whole long texts, their highest-scoring sentences join the
bags, and the model is fitted again. Scoring covers every row and whole text.

Results for odd input: a null text is empty; a text without words has one empty sentence; very long texts are
read whole; rows whose label is null are no training rows, a doc_id labelled more than once is toxic if any label
says so, and of a repeated doc_id each row may be drawn; rows with equal texts have equal scores, a score that
ties with the threshold counts as over it; with no row of one class all scores are close to 0; an empty table
gives no rows. score() reads only id and text; keep() carries whole rows through, whatever their columns are
called.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, columns, in_fold, texts

SAMPLE = 4000
#: Code points of a training bag; of a longer text the bag is a choice of sentences.
BAG_CHARS = 10_000
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
#: The logit of every sentence where nothing can be learnt.
UNTRAINED = -20.0
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def buckets(word: str) -> list[int]:
    """The hashed features of a lower-case word: itself, and its prefixes if they are shorter."""
    return [zlib.crc32(b"w" + word.encode()) % BUCKETS, *(zlib.crc32(b"p" + word[:k].encode()) % BUCKETS for k in PREFIXES if len(word) > k)]


class Scores(dict):
    """Word to the sum of its features' weights; forgets all when it has grown large."""

    def __init__(self, weights: np.ndarray, most: int = 300_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
        value = self[word] = float(self.weights[buckets(word)].sum())
        return value


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logit(self, sentence: str, scores: Scores) -> float:
        return self.bias + sum(map(scores.__getitem__, dict.fromkeys(_WORD.findall(sentence.lower()))))

    def sentences(self, text: str, scores: Scores) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans of the sentences and their logits."""
        spans = [m.span() for m in _SENTENCE.finditer(text)] or [(0, 0)]
        return spans, np.array([self.logit(text[a:b], scores) for a, b in spans])

    def document(self, text: str, scores: Scores) -> float:
        return noisy_or(self.sentences(text, scores)[1])


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - p) of the sentences' probabilities."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def bag(text: str, most: int = BAG_CHARS, model: Model | None = None, scores: Scores | None = None) -> str:
    """A text of at most most code points whole; else as many of its sentences, by hash, and with a model half of them by score.

    A sentence above an eighth of that gives a part of its distinct tokens, by hash.
    """
    if len(text) <= most:
        return text
    parts = []
    for s in _SENTENCE.findall(text):
        if 8 * len(s) > most:
            tokens = sorted(set(s.split()), key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))
            fit = np.cumsum([len(w) + 1 for w in tokens]) * 8 <= most
            s = " ".join(w for w, ok in zip(tokens, fit, strict=True) if ok)
        parts.append(s)
    by_hash = sorted(range(len(parts)), key=lambda k: (zlib.crc32(parts[k].encode("utf-8", "surrogatepass")), k))
    by_score = sorted(range(len(parts)), key=lambda k: (-model.logit(parts[k], scores), k)) if model else []
    taken: dict[int, None] = {}
    room = most
    for order, least in ((by_score, most // 2), (by_hash, 0)):
        for k in order:
            if room - len(parts[k]) - 1 < least:
                break
            if k not in taken:
                taken[k] = None
                room -= len(parts[k]) + 1
    return "\n".join(parts[k] for k in sorted(taken))


def train(bags: list[str], y: np.ndarray, prior: float | None = None, epochs: int = 200, rate: float = 1.0, decay: float = 1e-5, least: int = 3, bias: float = -8.0) -> Model:
    """Gradient ascent with per-weight step sizes on the noisy-or likelihood of the bags.

    prior: the share of class 1 where the sample was taken from; without one, the sample's. A token counts once
    in a sentence, so repeating it proves nothing. The bias starts so low that long clean documents stay clean.
    """
    weights = np.zeros(BUCKETS)
    if not len(y) or y.min() == y.max():
        return Model(weights, UNTRAINED)
    index: dict[str, int] = {}
    words, ends, docs = array("i"), array("i"), array("i")
    for k, text in enumerate(bags):
        for s in _SENTENCE.findall(text) or [""]:
            words.extend([index.setdefault(w, len(index)) for w in dict.fromkeys(_WORD.findall(s.lower()))])
            ends.append(len(words))
            docs.append(k)
    if not index:
        return Model(weights, UNTRAINED)
    words, ends, docs = (np.frombuffer(x, np.int32) for x in (words, ends, docs))
    sentence = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    feats, size = array("i"), array("i")
    for w in index:
        feats.extend(own := buckets(w))
        size.append(len(own))
    feats, owner = np.frombuffer(feats, np.int32), np.repeat(np.arange(len(size)), size)
    # A feature of few bags says nothing yet.
    pairs = np.unique(docs[sentence] * np.int64(len(index)) + words)
    df = np.bincount(feats, weights=np.bincount(pairs % len(index), minlength=len(index))[owner], minlength=BUCKETS)
    use = (df >= least).astype(float)
    g2, gb2, b = np.full(BUCKETS, 1e-8), 1e-8, bias
    share = y.mean()
    weight = np.ones(len(y)) if prior is None else np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    for _ in range(epochs):
        per_word = np.bincount(owner, weights=weights[feats], minlength=len(index))
        z = b + np.bincount(sentence, weights=per_word[words], minlength=len(ends))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        bag = -np.expm1(-np.bincount(docs, weights=np.logaddexp(0, z), minlength=len(y)))
        pull = np.where(y == 1, (1 - bag) / np.maximum(bag, 1e-6), -1.0) * weight
        dz = p * pull[docs]
        gw = np.bincount(words, weights=dz[sentence], minlength=len(index))
        g = np.bincount(feats, weights=gw[owner], minlength=BUCKETS) * use - decay * len(y) * weights
        g2 += g * g
        weights += rate * g / np.sqrt(g2)
        gb = dz.sum()
        gb2 += gb * gb
        b += rate * gb / math.sqrt(gb2)
    return Model(weights, float(b))


def trained(docs: DataFrame, picked: DataFrame, prior: float, sample: int, before: Model | None = None) -> tuple[Model, int]:
    """A model of the rows of docs that are picked, fitted in one task on at most 2 * sample bags, and how many of them are long.

    The driver gets the weights alone. before: a model that chooses the sentences of long rows.
    """
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(before.weights) if before else None
        for b in batches:
            text = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([bag(t, BAG_CHARS, before, scores) for t in text], pa.string()), pa.array([len(t) > BAG_CHARS for t in text], pa.bool_())],
                                             ["doc_id", "y", "h", "bag", "long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        got = train([r[3] for r in rows], np.array([r[2] for r in rows]), prior)
        yield pa.RecordBatch.from_arrays([pa.array([got.weights.astype("<f4").tobytes()], pa.binary()), pa.array([got.bias], pa.float64()), pa.array([sum(r[4] for r in rows)], pa.int64())],
                                         ["weights", "bias", "long"])

    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), "text").mapInArrow(chosen, "doc_id long, y int, h long, bag string, long boolean")
    # A doc_id can be there many times: the bound holds for rows.
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(2 * sample).select("doc_id", "h", "y", "bag", "long")
    r = some.mapInArrow(run, "weights binary, bias double, long long").collect()  # one row
    return (Model(np.frombuffer(r[0]["weights"], "<f4").astype(float), r[0]["bias"]), r[0]["long"]) if r else (Model(np.zeros(BUCKETS), UNTRAINED), 0)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. Learns only from labels whose crc32 fold is not the held-out one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(
        ~in_fold(F.col("doc_id"), modulus, held)).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    counts = dict(known.groupBy("y").count().collect())  # two rows
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    # At most 2 * sample rows of two numbers: a bounded side.
    picked = known.where("y = 1").orderBy(*order).limit(sample).unionByName(known.where("y = 0").orderBy(*order).limit(sample))
    model, long = trained(docs, picked, prior, sample)
    return trained(docs, picked, prior, sample, model)[0] if long and model.bias != UNTRAINED else model


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 5, held: int = 0, threshold: float = 0.5, locate: bool = False,
          id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, and with locate the spans (code points) of sentences at or over the threshold."""
    bounded_batches(docs.sparkSession)
    body = texts(docs, id_col, text_col)
    model = fit(body, labels, label_col, modulus, held, sample)
    weights = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 1 MB
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*weights.value)
        scores = Scores(own.weights)
        least = math.log(threshold / (1 - threshold))
        for b in batches:
            ids, text = columns(b, "doc_id", "text")
            made, found = [], []
            for t in text:
                spans, z = own.sentences(t, scores)
                made.append(noisy_or(z))
                if locate:
                    found.append([{"start": spans[k][0], "end": spans[k][1], "score": float(1 / (1 + np.exp(-min(z[k], 30.0))))} for k in np.flatnonzero(z >= least)])
            cols = [pa.array(ids, pa.int64()), pa.array(made, pa.float64()), *([pa.array(found, span)] if locate else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "spans"][: len(cols)])

    schema = "doc_id long, score double" + ", spans array<struct<start:int,end:int,score:double>>" * locate
    scored = body.mapInArrow(run, schema)
    return scored.select("doc_id", in_fold(F.col("doc_id"), modulus, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["spans"] * locate)


def keep(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 5, held: int = 0, threshold: float = 0.5,
         id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score() predicts 0 for, with the columns they came with: filtered in place, each row by its own text."""
    bounded_batches(docs.sparkSession)
    model = fit(texts(docs, id_col, text_col), labels, label_col, modulus, held, sample)
    weights = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 1 MB

    rows = docs.select(F.struct("*").alias("row"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*weights.value)
        scores = Scores(own.weights)
        for b in batches:
            yield b.filter(pa.array([own.document(t or "", scores) < threshold for t in b.column(0).field(text_col).to_pylist()], pa.bool_()))

    return rows.mapInArrow(clean, rows.schema).select("row.*")
