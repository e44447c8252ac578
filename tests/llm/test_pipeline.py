"""The pipeline: every stage against plain code that shares nothing with it but fitted numbers, with odd rows and odd column names."""

import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import exact_dedup, packing, quality, queries, simhash, toxicity
from tessera.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row string, x string, _kept_id long, __kept long, edge int, rid int"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ri", "to", "ne") for b in ("lo", "mi", "sa", "du") for c in ("n", "r", "st", "")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, junk, toxic sentences, nulls, empties, repeated rows and ids, one very long text."""
    rng = random.Random(31)
    rows, labels = [], []

    def put(text, doc_id=None):
        k = len(rows) if doc_id is None else doc_id
        rows.append((k, text, "en", "s", len(text or ""), "x.y", "r", "x", 7, 8, 1, 2))
        return k
    for _ in range(240):
        body = [sentence(rng, rng.randint(5, 12)) for _ in range(rng.randint(6, 14))]
        bad, toxic = rng.random() < 0.25, rng.random() < 0.3
        if bad:
            body = [" ".join(w.upper() + "!!" for w in s.split()) for s in body]
        if toxic:
            body.insert(rng.randrange(len(body)), f"You are a vilest{rng.choice('abc')} thing.")
        text = "\n".join(body)
        k = put(text)
        labels.append((k, int(not bad), int(toxic)))
        if rng.random() < 0.2:
            put(text.replace(" ", "  ", 1))
        if rng.random() < 0.2:
            put(text + " " + sentence(rng, 6))
    for text in (None, None, "", "  ", "One. " * 30_000, "Twice here this one is told."):
        put(text)
    rows += rows[-8:]
    put("Quite another text that is told once by this id.", 3)
    put("A text of no id at all stands here and stays.", None)
    rows[-1] = (None, *rows[-1][1:])
    labels += [(0, None, None), (1, *labels[1][1:]), (None, 1, 0), (10_000, 0, 1)]
    at = str(tmp_path_factory.mktemp("corpus"))
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def stages(spark, folder):
    """(name, rows in, rows out) of each stage."""
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, folder).cache()
        out.append((name, docs, after))
        docs = after
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_statistics(text):
    words = re.split(r"\s+", text.strip()) if text.strip() else []
    if not words:
        return [0.0] * 12
    n, of = len(words), len(words) + 15.0
    chars = sum(len(w) for w in words) + 75.0
    odd = 0.0
    for line in text.split("\n"):
        part = line.split()
        if len(part) > 3:
            odd = max([odd] + [m / (len(part) + 15.0) for m in (sum(c in "|*#%$&!" for c in line), sum(a == b for a, b in zip(part, part[1:], strict=False)), sum(w.isupper() for w in part))])
    lines = len([x for x in text.split("\n") if x.strip()])
    ends = len(re.findall(r"\.[ \n]", text)) + text.endswith(".")
    return [math.log(1 + n), math.log(chars / of), math.sqrt(len([w for w in words if w.isupper()]) / of), math.sqrt(len([c for c in text if c in "|*#%$&!<>{}[]=+~^_\\/@"]) / of),
            math.sqrt(text.count("!") / of), math.sqrt(len([1 for k in range(1, n) if words[k] == words[k - 1]]) / of), math.log((len(set(words)) + 15.0) / of) / math.log(of + 2),
            math.log(1 + of / max(1, lines)), math.sqrt(len([c for c in text if c.isupper()]) / chars), math.sqrt(len(re.findall("[0-9]", text)) / chars), math.log(1 + 4 * odd), math.log(1 + ends * 20 / of)]


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]


def test_stages_keep_rows_and_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema
        assert after.exceptAll(before).count() == 0
        assert 0 < after.count() <= before.count()


def test_quality_stage_is_the_discriminant_of_plain_statistics(stages, spark, folder):
    _, before, after = stages[0]
    docs = before.collect()
    for r in docs:
        assert quality.statistics(r["text"] or "") == pytest.approx(plain_statistics(r["text"] or ""))
    truth = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["quality"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    x = {c: np.array([plain_statistics(r["text"] or "") for i, y in truth if y == c for r in docs if r["doc_id"] == i]) for c in (0, 1)}
    total = len(x[0]) + len(x[1])
    cov = {c: np.cov(x[c].T, bias=True) for c in x}
    pooled = (len(x[0]) * cov[0] + len(x[1]) * cov[1]) / total
    ridge = 1e-3 * np.diag(np.maximum(np.diag(pooled), 1e-6))

    def log_density(v, c):
        a = max(0.3, 12 / (12 + len(x[c])))
        s = (1 - a) * cov[c] + a * ((1 - 1e-3) * pooled + ridge) + ridge
        d = np.array(v) - x[c].mean(0)
        return math.log(len(x[c]) / total) - 0.5 * (d @ np.linalg.solve(s, d) + np.linalg.slogdet(s)[1])
    odds = math.log(0.7 / 0.3)
    want = [tuple(r) for r in docs if log_density(v := plain_statistics(r["text"] or ""), 1) - log_density(v, 0) >= odds]
    assert rows_of(after) == sorted(want, key=str)


def test_toxicity_stage_is_the_noisy_or_of_its_sentences(stages, spark, folder):
    _, before, after = stages[1]
    model = toxicity.fit(before.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), spark.read.parquet(f"{folder}/labels.parquet"))
    w, bias = model.weights.astype(np.float32).astype(float), model.bias

    def clean(text):
        rest = 1.0
        for s in re.split(r"[.!?\n]+", text):
            z = bias
            for word in set(re.findall(r"\w+", s.lower())):
                z += w[zlib.crc32(b"w" + word.encode()) % len(w)] + sum(w[zlib.crc32(b"p" + word[:k].encode()) % len(w)] for k in (4, 5, 6) if len(word) > k)
            if s:
                rest *= 1 - 1 / (1 + math.exp(-z))
        return 1 - rest < 0.5
    assert rows_of(after) == sorted((tuple(r) for r in before.collect() if clean(r["text"] or "")), key=str)
    assert not any("vilest" in (r["text"] or "") for r in after.collect())
    assert sum("vilest" in (r["text"] or "") for r in before.collect()) > 20


def test_a_word_counts_once_whatever_stands_around_it():
    weights = np.zeros(toxicity.BUCKETS)
    weights[zlib.crc32(b"wbad") % toxicity.BUCKETS] = 2.0
    model = toxicity.Model(weights, -5.0)
    for text in ("bad bad", 'bad "bad (bad) Bad,', "bad-bad-bad", "a bad: b bad; c"):
        assert model.logit(text, toxicity.Scores(weights)) == -3.0
    assert model.logit("badly", toxicity.Scores(weights)) == model.logit("...", toxicity.Scores(weights)) == -5.0


def test_exact_stage_keeps_one_row_of_each_text(stages):
    _, before, after = stages[2]
    groups = {}
    for r in before.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    best = [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    assert len(best) < before.count()
    key = lambda r: (r["doc_id"], len(r["text"] or ""))
    assert sorted(map(key, after.collect()), key=str) == sorted(map(key, best), key=str)


def test_near_stage_keeps_one_row_of_each_class(stages):
    _, before, after = stages[3]
    docs = sorted(before.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles(r["text"] or "") for r in docs]
    low = list(range(len(docs)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    want = [tuple(docs[i]) for i in range(len(docs)) if find(i) == i]
    assert rows_of(after) == sorted(want, key=str)
    assert len(want) < len(docs)


def test_packing_stage_covers_what_is_left(stages):
    _, before, after = stages[4]
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in before.collect())
    pieces = after.collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]) for r in pieces if r["start"] == 0)
    assert got == want and sum(r["length"] for r in pieces) == sum(x[2] for x in want)
    assert max(r["offset"] + r["length"] for r in pieces) <= packing.SIZE


def test_run_equals_the_stages(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens"))
    assert rows_of(got) == rows_of(stages[-1][2].groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")))


def test_empty_tables_and_no_labels(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        none = f(spark, docs.limit(0), folder)
        assert none.count() == 0 and (k == 4 or none.columns == docs.columns)
    labels = spark.read.parquet(f"{folder}/labels.parquet").limit(0)
    assert toxicity.keep(docs, labels).count() == docs.count()
    assert quality.keep(docs, labels).count() == 0  # all scores are 0.5, below 0.7
    assert quality.score(docs.limit(0), labels).count() == packing.pack(docs.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_rows_not_ids_decide(spark):
    rows = [(0, "b"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(exact_dedup.drop_duplicates(df)) == [(0, "b"), (1, "a"), (None, "c")]
    assert rows_of(simhash.drop_similar(df)) == [(0, "b"), (1, "a"), (None, "c")]


def test_a_large_group_over_many_partitions_keeps_one_row(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same  text' when id % 3 = 1 then 'same text' else concat('text ', id) end as text").repartition(7)
    got = {r["text"]: r["doc_id"] for r in exact_dedup.drop_duplicates(df).collect()}
    assert len(got) == 1001 and got["same  text"] == 0


def test_long_texts_are_learnt_from(spark):
    """Every toxic training text is above the size of a bag: its offending sentence is found by the second fit."""
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(120):
        body = [sentence(rng, 9) for _ in range(260 if k % 2 else 5)]
        if k % 2 and k % 4 == 1:
            body.insert(rng.randrange(len(body)), "You are a vilest thing.")
            body.insert(rng.randrange(len(body)), "What a vilest thing it is.")
        docs.append((k, "\n".join(body)))
        labels.append((k, int(k % 4 == 1)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert min(len(t) for k, t in docs if k % 4 == 1) > toxicity.BAG_CHARS
    got = toxicity.score(d, spark.createDataFrame(labels, "doc_id long, toxic int"), locate=True).collect()
    truth = dict(labels)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.95
    text = dict(docs)
    assert all("vilest" in text[r["doc_id"]][s["start"]:s["end"]] for r in got for s in r["spans"])
    assert len(toxicity.bag("a" * 50_000 + ". b c. " * 9000)) <= toxicity.BAG_CHARS


def test_spans_are_those_of_the_text_where_lower_case_is_longer(spark):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), -1.0)
    text = "İ one. Two İİ. THREE"
    spans, z = model.sentences(text, toxicity.Scores(model.weights))
    assert [text[a:b].strip() for a, b in spans] == ["İ one", "Two İİ", "THREE"] and len(z) == 3
