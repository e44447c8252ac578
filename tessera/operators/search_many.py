"""Many questions at once: BM25 that skips blocks of documents by their bounds, and exact search over int8 vectors in blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import B, BRANCH, K1, corpus_stats, postings
from tessera.session import materialize

#: Rows of a term's block list are dealt out over this many keys of the join.
SALTS = 16
#: A side of a block of vectors in bytes.
SIDE = 16 << 20


@dataclass
class BlockIndex:
    """postings: block, term, key, impact (what BM25 makes of the count and the length, without idf). blocks: term, salt,
    block, most (the largest impact there). terms: term, idf, of terms that aren't too frequent. stats: n, avg_length."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame


def block_index(chunks: DataFrame, key: str = "id", text: str = "body", fold: bool = True, size: int = 64, only: DataFrame | None = None) -> BlockIndex:
    """Tokenises the corpus once. only (column term): an index for these terms' questions alone, whose other postings go before any shuffle. A block is some size chunks, by a hash of the key; terms in more than max(8, 0.15 n) chunks
    are dropped here, as they would be from every question. Null texts have no terms but count in n."""
    stats = materialize(corpus_stats(chunks, text, fold), "stats")
    n = stats.first()["n"]
    lists = postings(chunks, key, text, fold, only).crossJoin(F.broadcast(stats))  # a row
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    block = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // size))))
    held = materialize(lists.select(block.alias("block"), "term", key, impact.alias("impact")), "postings")
    blocks = held.groupBy("term", "block").agg(F.max("impact").alias("most"), F.count("*").alias("df"))
    df = blocks.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") <= max(8.0, n * 0.15))
    terms = materialize(df.select("term", F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "terms")
    most = blocks.join(terms, "term", "left_semi").select("term", F.pmod("block", F.lit(SALTS)).alias("salt"), "block", "most")
    # What is scored reads no postings of terms that are too frequent: they are most rows, and would be shuffled for nothing.
    kept = held.join(terms, "term", "left_semi") if only is not None else held
    return BlockIndex(kept, materialize(most.repartition("term", "salt").sortWithinPartitions("term"), "blocks"), terms, stats)


def _top(scores: DataFrame, by: list, order: list, n: int) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def surviving(index: BlockIndex, questions: DataFrame, key: str = "id", question: str = "question", top: int = BRANCH, seeds: int = 16) -> tuple[DataFrame, DataFrame]:
    """(asked: question, term, idf; left: question, block of the blocks that may hold one of the question's top chunks).

    A block's bound is the sum over terms of idf times the largest impact. The seeds best blocks by bound are scored, and
    their top-th score is a floor: blocks whose bound is below it can't matter. Fewer than top chunks there: no floor.
    """
    asked = questions.select(question, F.explode(F.array_distinct("terms")).alias("term")).distinct().join(index.terms, "term")
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    bounds = salted.join(index.blocks.withColumn("salt", F.col("salt").cast("int")), ["term", "salt"]).groupBy(question, "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
    bounds = materialize(bounds, "bounds")  # read twice
    first = _top(bounds, [question], [F.col("bound").desc(), "block"], seeds).select(question, "block")
    floor = _top(score_blocks(index, asked, first, key, question), [question], [F.col("score").desc(), key], top).where(F.col("rank") == top).select(question, F.col("score").alias("floor"))
    # The margin covers sums in another order and scores that are ordered by nine digits.
    left = bounds.join(floor, question, "left").where(F.col("floor").isNull() | (F.col("bound") + 1e-8 >= F.col("floor"))).select(question, "block")
    return asked, left


def score_blocks(index: BlockIndex, asked: DataFrame, blocks: DataFrame, key: str, question: str) -> DataFrame:
    """question, key, score of the chunks of the blocks (question, block)."""
    return blocks.join(asked, question).join(index.postings, ["block", "term"]).groupBy(question, key).agg(F.sum(F.col("idf") * F.col("impact")).alias("score"))


def bm25_many(index: BlockIndex, questions: DataFrame, key: str = "id", question: str = "question", top: int = BRANCH, seeds: int = 16) -> DataFrame:
    """question, key, score, rank: for each question the rows that retrieval.bm25 gives it, for all questions in one job.

    questions: question, terms (repeats count once; null: none). Ties go by key. A question without a known term has no rows.
    """
    asked, left = surviving(index, questions, key, question, top, seeds)
    return _top(score_blocks(index, asked, left, key, question), [question], [F.round("score", 9).desc(), key], top)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integers: 1,000 products of int8 add up to less than 2 ** 24, which float32 holds."""
    out = 0
    for k in range(0, a.shape[1], 1000):
        out = out + (a[:, k:k + 1000].astype(np.float32) @ b[:, k:k + 1000].astype(np.float32).T).astype(np.int64)
    return out


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int8())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


def dense_many(index: DataFrame, questions: DataFrame, dims: int, key: str = "id", vector: str = "vector", question: str = "question", query: str = "q", top: int = BRANCH, side: int = SIDE) -> DataFrame:
    """question, key, score (long: the product of the int8 vectors), rank: exact, best first, ties by key.

    index: key, vector (array<tinyint>); questions: question (a name of its own each), query (array<tinyint>). Vectors that
    are null, hold a null or don't have dims components are left out, on either side. Both sides are cut into blocks of
    some side bytes by row number, so repeated keys don't meet; a task multiplies one block of each and gives out the best
    top of each question. The sides should be stored tables, whose row numbers stay when a task is run again.
    """
    rows = max(1, side // dims)

    def usable(df: DataFrame, name: str, column: str, as_name: str, as_column: str) -> DataFrame:
        v = F.col(column)
        return df.where(v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull())).select(F.col(name).alias(as_name), v.cast("array<tinyint>").alias(as_column))
    docs, asked = usable(index, key, vector, "_k", "_v"), usable(questions, question, query, "_q", "_a")
    n_docs, n_asked = (max(1, -(-df.count() // rows)) for df in (docs, asked))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    left = docs.withColumn("_i", mine(n_docs)).withColumn("_j", every(n_asked))
    right = asked.withColumn("_j", mine(n_asked)).withColumn("_i", every(n_docs))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.take(pc.sort_indices(a, sort_keys=[("_k", "ascending")], null_placement="at_start"))
        v, q, n = _matrix(a["_v"], dims), _matrix(b["_a"], dims), a.num_rows
        asked_at, doc_at, scores = [], [], []
        for s in range(0, len(q) if n else 0, 256):
            some = q[s:s + 256]
            held = np.empty((len(some), 0), np.int64)
            for t in range(0, n, 8192):
                # One integer orders by score, then by key: rows are sorted by it.
                new = _products(some, v[t:t + 8192]) * n + (n - 1 - np.arange(t, min(t + 8192, n)))
                held = np.concatenate([held, new], axis=1)
                if held.shape[1] > top:
                    held = np.partition(held, held.shape[1] - top, axis=1)[:, -top:]
            asked_at.append(np.repeat(np.arange(s, s + len(some)), held.shape[1]))
            doc_at.append((n - 1 - held % n).ravel())
            scores.append((held // n).ravel())
        if not scores:
            return pa.table({"_q": b["_q"].slice(0, 0), "_k": a["_k"].slice(0, 0), "score": pa.array([], pa.int64())})
        return pa.table({"_q": b["_q"].take(pa.array(np.concatenate(asked_at))), "_k": a["_k"].take(pa.array(np.concatenate(doc_at))), "score": np.concatenate(scores)})

    schema = f"_q {asked.schema['_q'].dataType.simpleString()}, _k {docs.schema['_k'].dataType.simpleString()}, score long"
    found = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(best, schema)
    return _top(found, ["_q"], [F.col("score").desc(), "_k"], top).select(F.col("_q").alias(question), F.col("_k").alias(key), "score", "rank")
