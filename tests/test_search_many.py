"""Many questions at once against one question at a time, and against plain numpy."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval, search_many


def test_bm25_of_many_questions_is_that_of_each(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("block"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None, 1), (-2, "", 1)], docs.schema))
    words = [r["term"] for r in retrieval.term_frequencies(docs, "doc_id", "text").orderBy(F.desc("df"), "term").collect()]
    ask = [("rare", words[-3:]), ("mixed", [words[len(words) // 50], words[-1], words[-1]]), ("all", words[::40]), ("none", ["nosuchword"]), ("empty", []), ("null", None)]
    questions = spark.createDataFrame(ask, "question string, terms array<string>")
    for size, top, only in ((4, 3, None), (64, 300, questions.select(F.explode("terms").alias("term")))):
        index = search_many.block_index(docs, "doc_id", "text", fold=False, size=size, only=only)
        got = {}
        for r in search_many.bm25_many(index, questions, "doc_id", top=top, seeds=2).orderBy("question", "rank").collect():
            got.setdefault(r["question"], []).append((r["doc_id"], round(r["score"], 6)))
        for name, terms in ask:
            want = [(r["doc_id"], round(r["score"], 6)) for r in retrieval.bm25(docs, terms or [], "doc_id", "text", top, fold=False).collect()]
            assert got.get(name, []) == want, (name, size, top)


def test_blocks_are_skipped(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    words = [r["term"] for r in retrieval.term_frequencies(docs, "doc_id", "text").where("df <= 12").orderBy(F.desc("df"), "term").collect()]
    index = search_many.block_index(docs, "doc_id", "text", fold=False, size=2)
    questions = spark.createDataFrame([("q", [words[0], words[1], words[2], words[-1]])], "question string, terms array<string>")
    asked, left = search_many.surviving(index, questions, "doc_id", top=2, seeds=2)
    reachable = asked.join(index.blocks, "term").select("block").distinct().count()
    assert 0 < left.count() < reachable


def test_empty_corpus_and_questions(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = search_many.block_index(none, "doc_id", "text")
    asked = spark.createDataFrame([("q", ["a"])], "question string, terms array<string>")
    assert search_many.bm25_many(index, asked, "doc_id").count() == 0
    vectors = spark.createDataFrame([], "id long, vector array<tinyint>")
    assert search_many.dense_many(vectors, vectors.toDF("question", "q"), 4).count() == 0


def test_int8_search_is_exact_in_any_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-127, 128, (300, 16))
    v[50:90] = v[50]  # ties
    rows = [(f"k{k:03d}", v[k].tolist()) for k in range(300)] + [("bad", None), ("short", [1]), ("hole", [None] * 16), ("k001", v[1].tolist())]
    index = spark.createDataFrame(rows, "id string, vector array<tinyint>").repartition(3)
    asked = spark.createDataFrame([(k, v[k].tolist()) for k in range(0, 300, 20)] + [(999, None)], "question int, q array<tinyint>")
    plain = [(name, np.array(x)) for name, x in rows if x and len(x) == 16 and None not in x]
    want = {(k, rank, name, score) for k in range(0, 300, 20)
            for rank, (score, name) in enumerate(sorted(((int(x @ v[k]), name) for name, x in plain), key=lambda p: (-p[0], p[1]))[:25], 1)}
    index.cache()
    for side in (1 << 20, 16 * 7):
        got = search_many.dense_many(index, asked, 16, top=25, side=side).collect()
        assert {(r["question"], r["rank"], r["id"], r["score"]) for r in got} == want and len(got) == 25 * 15
    index.unpersist()


def test_wide_int8_vectors_stay_exact():
    rng = np.random.default_rng(1)
    a, b = (np.full((2, 2500), -128) + (rng.random((2, 2500)) < 0.5)).astype(np.int8), np.full((3, 2500), -128, np.int8)
    assert (search_many._products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_int8_scores_are_those_of_dense(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", T.quantize("embedding").alias("vector"))
    asked = v.where("vec_id % 20 = 0").toDF("question", "q")
    got = search_many.dense_many(v, asked, 64, "vec_id", top=5).where("question = 20").orderBy("rank").collect()
    want = retrieval.dense(v, v.where("vec_id = 20").select(F.col("vector").alias("q")), "vec_id", top=5).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(r["vec_id"], int(r["score"])) for r in want]


def test_an_index_of_asked_terms_scores_no_frequent_ones(spark):
    """Postings of terms that are in too many documents don't go into the joins that score."""
    docs = spark.createDataFrame([(k, f"all word{k % 9}") for k in range(90)], "doc_id long, text string")
    asked = spark.createDataFrame([("all",), ("word3",), ("none",)], "term string")
    index = search_many.block_index(docs, "doc_id", "text", fold=False, only=asked)
    assert [r["term"] for r in index.postings.select("term").distinct().collect()] == ["word3"] and index.postings.count() == 10
