"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has a Gaussian with a shrunk covariance over transformed statistics of the whole text; the score is
the sigmoid of the difference of the two log-densities (Mahalanobis distance and log-determinant from cached
Cholesky factors) plus the log-ratio of the class sizes. Sums of products for the covariances are taken by
Spark over all labelled rows of the training fold: no sample, and only d * d numbers reach the driver.

Results for odd input: a null text is empty; an empty text has the statistics of no words and gets a score; very
long texts are read whole; rows whose label is null are no training rows, repeated labels and repeated rows count
each; rows with equal texts have equal scores, and a score that ties with the threshold counts as at or over it;
with no row of one class all scores are 0.5; an empty table gives no rows. score() reads only id and text;
keep() carries whole rows through, whatever their columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, columns, in_fold, texts
from tessera.session import materialize

FEATURES = ("log_words", "word_length", "upper_words", "symbols", "marks", "repeats", "variety", "line_words", "upper", "digits", "odd_line", "sentence_ends")
#: Labels that are broadcast at most.
FEW = 1_000_000
#: How far each class covariance is pulled to the pooled one.
SHRINK = 0.3


#: Imaginary plain words that every share counts in: a repeat in a text of five words says little.
PLAIN = 15.0


# Fixed value: deletes the ASCII characters that aren't capitals.
_SMALL = bytes(set(range(128)) - set(range(65, 91)))


def capitals(text: str) -> int:
    """How many characters of the whole text are capitals."""
    if text.isascii():
        return len(text.encode().translate(None, _SMALL))
    return sum(map(str.isupper, text))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text, all finite; shares go through a square root."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words)) + 5 * PLAIN
    lines = sum(1 for x in text.split("\n") if x.strip())
    of = n + PLAIN
    odd = 0.0
    for line in text.split("\n"):
        part = line.split()
        if len(part) > 3:
            most = max(sum(map(line.count, "|*#%$&!")), sum(map(eq, part, part[1:])), sum(map(str.isupper, part)))
            odd = max(odd, most / (len(part) + PLAIN))
    ends = text.count(". ") + text.count(".\n") + text.endswith(".")
    return [
        math.log1p(n), math.log(chars / of), math.sqrt(sum(map(str.isupper, words)) / of), math.sqrt(sum(map(text.count, "|*#%$&!<>{}[]=+~^_\\/@")) / of),
        math.sqrt(text.count("!") / of), math.sqrt(sum(map(eq, words, words[1:])) / of), math.log((len(set(words)) + PLAIN) / of) / math.log(of + 2),
        math.log1p(of / max(1, lines)), math.sqrt(capitals(text) / chars), math.sqrt(sum(map(text.count, "0123456789")) / chars),
        math.log1p(4 * odd), math.log1p(ends * 20 / of)]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: array of the statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, body = columns(b, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([statistics(t) for t in body], pa.list_(pa.float64()))], ["doc_id", "x"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Two Gaussians. shrink pulls each class covariance to the pooled one, ridge the pooled one to its mean variance."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = 1e-3):
        self.parts = None
        if any(sums.get(c, (0,))[0] < 1 for c in (0, 1)):
            return
        total = sum(sums[c][0] for c in (0, 1))
        own = {c: xx / n - np.outer(x / n, x / n) for c, (n, x, xx) in sums.items()}
        pooled = sum(sums[c][0] * own[c] for c in (0, 1)) / total
        d = len(pooled)
        base = np.diag(np.maximum(np.diag(pooled), 1e-6))
        self.parts = []
        for c in (0, 1):
            n, x, _ = sums[c]
            a = max(shrink, d / (d + n))
            cov = (1 - a) * own[c] + a * ((1 - ridge) * pooled + ridge * base) + ridge * base
            chol = np.linalg.cholesky(cov)
            self.parts.append((x / n, np.linalg.inv(chol), np.log(np.diag(chol)).sum() * 2, math.log(n / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), 0.5)
        logs = [prior - 0.5 * ((((x - mean) @ inv.T) ** 2).sum(1) + det) for mean, inv, det, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def fit(feats: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", shrink: float = SHRINK) -> Discriminant:
    """feats: doc_id, x. labels: doc_id and the label; train: a condition on doc_id."""
    d = len(FEATURES)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(train)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    got = {}
    for r in feats.join(known, "doc_id").groupBy("y").agg(F.count("*").alias("n"), *sums).collect():  # two rows
        xx = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                xx[i, j] = xx[j, i] = r[f"p{i}_{j}"]
        got[r["y"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), xx)
    return Discriminant(got, shrink)


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 4, held: int = 2, threshold: float = 0.7,
          shrink: float = SHRINK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns from labels outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    feats = materialize(features(docs, id_col, text_col), "quality")
    model = fit(feats, labels, ~in_fold(F.col("doc_id"), modulus, held), label_col, shrink)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).flatten()).reshape(b.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = feats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), modulus, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 4, held: int = 2, threshold: float = 0.7,
         shrink: float = SHRINK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score() predicts 1 for, with the columns they came with: each row by its own text, no join by id.

    Two passes over the texts, and nothing of them is written or shuffled: one for the statistics of labelled rows, one
    that scores and filters in place. Up to FEW labels are broadcast, so the first pass reads only their texts; above
    that it reads all, and the statistics meet the labels in a join.
    """
    bounded_batches(docs.sparkSession)
    body = texts(docs, id_col, text_col)
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.count() <= FEW:
        body = body.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    model = fit(features(body), labels, ~in_fold(F.col("doc_id"), modulus, held), label_col, shrink)
    rows = docs.select(F.struct("*").alias("row"))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t or "") for t in b.column(0).field(text_col).to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold, pa.bool_()))

    return rows.mapInArrow(good, rows.schema).select("row.*")
