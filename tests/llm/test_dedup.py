"""SimHash, exact, line and embedding dedup against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, exact_dedup, line_dedup, simhash
from tessera.llm.common import min_labels


def classes(adjacent: np.ndarray, ids: list[int]) -> dict[int, int]:
    order = np.argsort(ids)
    low = min_labels(adjacent[np.ix_(order, order)])
    return {ids[order[k]]: ids[order[low[k]]] for k in range(len(ids))}


def plain_fingerprint(text: str) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 60, 400]))) for _ in range(30)]
    rows = [(k, t, "x") for k, t in enumerate(base)]
    for t in base[:15]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w), "y"))
    rows += [(len(rows) + k, t, "z") for k, t in enumerate([None, "", "  \n\t ", base[0], base[0].upper(), "é ß 漢字 a", "word " * 20_000])]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string")


def test_xxh64_of_slices():
    rng = random.Random(1)
    buf = bytes(rng.randrange(256) for _ in range(3000))
    start = np.array([rng.randrange(2000) for _ in range(300)])
    end = start + np.array([rng.choice([0, 1, 3, 4, 7, 8, 31, 32, 33, 100, 700]) for _ in range(300)])
    assert [int(x) for x in simhash.xxh64(buf, start, end, 42)] == [xxhash.xxh64_intdigest(buf[a:b], 42) for a, b in zip(start, end, strict=True)]


@pytest.mark.parametrize("block", [1024, 4])
def test_simhash_classes(docs, block, monkeypatch):
    """Small blocks deal the buckets out, to the same classes."""
    monkeypatch.setattr(simhash.links, "__defaults__", (4, block, None, 0.0))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = list(text)
    fps = np.array([plain_fingerprint(text[i]) for i in ids], np.uint64)
    assert {i: int(got[i]["fingerprint"], 16) for i in ids} == dict(zip(ids, map(int, fps), strict=True))
    want = classes(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, ids)
    assert {i: got[i]["component_id"] for i in ids} == want


def test_simhash_every_distance_is_found(spark):
    """Fingerprints at each distance from one another, through the key join alone."""
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for d in range(1, 7):
            fps.add(f ^ sum(1 << k for k in rng.sample(range(64), d)))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f, k, 0) for k, f in enumerate(signed)], "fp long, rep long, tab int")
    from tessera.operators.graph import connected
    got = {r["node"]: r["component"] for r in connected(simhash.links(nodes)).collect()}
    a = np.array(fps, np.uint64)
    want = classes(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4, list(range(len(fps))))
    assert {k: got.get(k, k) for k in want} == want


def test_similar_documents(docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {i: shingles(t) for i, t in text.items()}
    for i in text:
        for j in text:
            both = len(sets[i] | sets[j])
            like = len(sets[i] & sets[j]) / both if both else 1.0
            if like > 0.92:
                assert got[i] == got[j], (i, j, like)
            if got[i] == got[j]:
                assert like > 0.6, (i, j, like)


def test_similar_documents_whatever_the_edit(spark):
    """Appended, cut off and scattered edits at 0.75 to 0.95: linked from 0.8 of the five-word shingles on, and not below."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    rows, like = [], {}

    def shingles(w):
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for k in range(180):
        w = [rng.choice(words) for _ in range(rng.randint(120, 500))]
        share = rng.uniform(0.04, 0.28)
        n = round(len(w) * share)
        if k % 3 == 0:
            v = w + [rng.choice(words) for _ in range(n)]
        elif k % 3 == 1:
            v = w[:len(w) - n]
        else:
            v = [rng.choice(words) if rng.random() < share / 8 else x for x in w]
        a, b = shingles(w), shingles(v)
        like[k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert min(sum(0.8 <= like[k] <= 0.95 for k in like if k % 3 == e) for e in range(3)) > 20 and sum(x < 0.8 for x in like.values()) > 5
    assert {k: got[2 * k + 1] == 2 * k for k in like} == {k: like[k] >= 0.8 for k in like}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.similar_documents(none).count() == 0
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_exact_groups(spark):
    rng = random.Random(3)
    kinds = ["", " ", "a b", "ab", "a\tb ", "a b", "long " * 3000, "long" * 3000, "A b", None, "é\n", "é"]
    rows = [(k, rng.choice(kinds), 1) for k in range(400)] + [(400 + k, "ab", 1) for k in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, sha long").repartition(7)
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, _ in rows}
    groups: dict[str, list[int]] = {}
    for i, t, _ in rows:
        groups.setdefault(norm[i], []).append(i)
    text = {i: t or "" for i, t, _ in rows}
    got = exact_dedup.exact_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        g = groups[norm[r["doc_id"]]]
        best = min(g, key=lambda i: (-len(text[i]), i))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(g), best == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()


def test_exact_keeps_one_row_of_a_group_whose_ids_repeat(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (1, "ab"), (None, "x"), (None, "x"), (None, " x"), (4, "y"), (4, "z")] + [(7, "w w")] * 300 + [(k, "ww") for k in range(8, 900)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    kept = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]), key=str)
    assert kept == sorted([(1, 1, 4), (None, None, 3), (4, 4, 1), (4, 4, 1), (7, 7, 1192)], key=str)


def test_exact_drop_keeps_columns_and_repeated_rows_once(spark):
    df = spark.createDataFrame([(1, "a b", "en"), (1, "a b", "en"), (2, "ab", "de"), (3, None, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, exact_dedup.drop_duplicates(df).collect()), key=str) == [(1, "a b", "en"), (3, None, None)]


def plain_lines(rows, size=3):
    seen, first = {}, {}
    out = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        gone = set()
        for p in range(len(lines) - size + 1):
            w = tuple(x.strip(" ") for x in lines[p:p + size])
            if not re.search(r"\w", "".join(w)):
                continue
            if w in first:
                d, q = first[w]
                gone |= {n for n in range(p, p + size) if not (d == i and n < q + size)}
            else:
                first[w] = (i, p)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    del seen
    return out


def test_line_windows(spark):
    rng = random.Random(4)
    pool = [f"line {k}" for k in range(12)] + ["", "--", "  indented"]
    rows = [(k, "\n".join(rng.choice(pool[:8] if k % 2 else pool) for _ in range(rng.randrange(0, 30)))) for k in range(60)]
    rows += [(100, None), (101, "a\nb"), (102, "x\nx\nx\nx\nx\nx"), (103, "k\nl\nm\n" * 2000)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_lines(rows)


def plain_links(rows, threshold):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(ok)
    adj = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                adj[a, b] = ok[a][1] @ ok[b][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[b][1]) >= threshold
    return [x[0] for x in ok], adj


@pytest.mark.parametrize("block", [512, 8])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.12).tolist(), c % 3))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(40)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [float("inf")] * 16, 0), (n + 7, [1e200] * 16, 0), (n + 8, [1e-200] * 16, 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=block).collect()}
    assert len(got) == len(rows)
    ids, adj = plain_links([r if r[0] not in (n + 7, n + 8) else (r[0], [1.0] * 16, 0) for r in rows], 0.93)
    want = dict(zip(ids, adj.sum(1).tolist(), strict=True))
    assert sum(got[i]["n_links"] for i in ids) >= 0.9 * sum(want.values())
    assert all(r["n_links"] <= want.get(i, 0) for i, r in got.items())
    comp = classes(adj, ids)
    assert sum(got[i]["component_id"] == comp[i] for i in ids) >= 0.95 * len(ids)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


@pytest.mark.parametrize("exact", [False, True])
def test_embedding_lengths_have_pivots_of_their_own(spark, exact):
    """No links are lost beside longer or more vectors; the exact form agrees with brute force in full."""
    rng = np.random.default_rng(16)
    rows = []
    for width, clusters, each in ((8, 40, 4), (16, 100, 7), (32, 3, 60), (3, 1, 2)):
        for _ in range(clusters):
            centre = rng.normal(size=width)
            rows += [(len(rows) + k, (centre + rng.normal(size=width) * 0.05).tolist(), int(rng.integers(2)) if width == 16 else 0) for k in range(each)]
    rows += [(len(rows) + k, *rows[0][1:]) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("perm", F.lit("x")).withColumn("h", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=32, exact=exact).collect()}
    ids, adj = plain_links(rows, 0.93)
    want = dict(zip(ids, adj.sum(1).tolist(), strict=True))
    short = sum(got[i]["n_links"] < want[i] for i in ids)
    assert all(got[i]["n_links"] <= want[i] for i in ids) and short <= (0 if exact else 0.01 * len(ids))
    assert {r["vec_id"] for r in got.values() if r["n_links"] < want[r["vec_id"]]} <= {i for i, v, _ in rows if len(v) != 8}
    comp = classes(adj, ids)
    assert sum(got[i]["component_id"] != comp[i] for i in ids) <= (0 if exact else 0.01 * len(ids))


def test_embedding_pivots_grow_with_the_rows_and_stay_apart(spark):
    rng = np.random.default_rng(17)
    x = np.concatenate([rng.normal(size=(600, 8)), rng.normal(size=8) + rng.normal(size=(600, 8)) * 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, vec array<double>").withColumn("h", F.xxhash64("vec"))
    few = embedding_dedup.choose_pivots(nodes, 0.93, least=16, few=100, most_bytes=8 * 8 * 20)[8]
    many = embedding_dedup.choose_pivots(nodes, 0.93, least=16, few=100)[8]
    assert len(few) <= 20 < len(many) <= 8 * 1200 ** 0.5
    near = many @ many.T - 2 * np.eye(len(many))
    assert near.max() <= 2 * 0.93 ** 2 - 1 + 1e-12


def test_embedding_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    one = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).collect()
    assert [tuple(r) for r in one] == [(1, 0, 1, True)]


def test_rows_without_an_id(spark):
    """Null ids: no operator fails, and each gives its defined result."""
    text = "some words that are told here and once more there"
    df = spark.createDataFrame([(None, text), (2, text), (3, text + " x"), (None, "other words"), (None, None)], "doc_id long, text string")
    near = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert len(near) == 5 and (2, 2) in near and near.count((None, 2)) >= 1
    exact = {(r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in exact_dedup.exact_duplicates(df).collect()}
    assert exact == {(2, 2, True, 2), (3, 3, True, 1), (None, 2, False, 2), (None, None, True, 1)}
    lines = "a1\nb2\nc3\nd4"
    got = line_dedup.dedup_lines(spark.createDataFrame([(None, lines), (1, lines), (2, lines)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (2, 4)]
    vecs = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)]
    got = {(r["vec_id"], r["component_id"], r["n_links"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int")).collect()}
    assert (1, 1, 2) in got and (2, 1, 2) in got and (None, 1, 2) in got
