"""Change points, token alignment and token files against brute force on small tables."""

import datetime
import functools
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tessera.llm import change_points, token_alignment, token_files
from tessera.llm.queries import tokenizer_file
from tessera.session import scratch_folder

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


# -- change points


def plain_cost(x: list[int]) -> int:
    n, s, q = len(x), sum(x), sum(v * v for v in x)
    return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))


def plain_segments(x: list[int], shortest: int, penalty: int) -> tuple[int, list[int]]:
    """The best key over all segmentations of every prefix: (cost, segments, starts from the last one backwards)."""
    n = len(x)
    if n < shortest:
        return plain_cost(x), [0]
    best: dict[int, tuple] = {0: (0, 0, ())}
    for j in range(1, n + 1):
        keys = [(best[i][0] + plain_cost(x[i:j]) + penalty * (i > 0), best[i][1] + 1, (i, *best[i][2])) for i in range(j - shortest + 1) if i in best]
        if keys:
            best[j] = min(keys)
    cost, _, starts = best[n]
    return cost, list(starts)[::-1]


@pytest.mark.parametrize("cells", [change_points.CELLS, 64])
def test_programme_against_all_prefixes(cells, monkeypatch):
    """Series of unlike length side by side, with ties, in blocks large and small."""
    monkeypatch.setattr(change_points, "CELLS", cells)
    rng = random.Random(3)
    series = [[rng.choice(v) for _ in range(n)] for n, v in [(1, [4]), (4, [1, 9]), (5, [0, 100]), (9, [0]), (11, [0, 1]), (40, [0, 50]), (70, range(400)), (33, [7])]]
    series += [[0] * 12 + [90] * 12 + [0] * 12, [*range(30)], [-5, 5] * 9]
    for penalty in (10_000, 10, 0):
        p = change_points.Programme([np.array(s, np.int64) for s in series], 5, penalty)
        for k, s in enumerate(series):
            got, whole = p.segments(k, len(s))
            assert (whole, [a for a, *_ in got]) == plain_segments(s, 5, penalty)
            assert whole == sum(c for *_, c in got) + penalty * (len(got) - 1)


def test_ties_take_fewest_segments_then_earliest_starts():
    p = change_points.Programme([np.zeros(20, np.int64)], 5, 0)
    assert p.segments(0, 20)[0] == [(0, 20, 0, 1, 0)]
    flat = np.array([0] * 7 + [1000] * 8, np.int64)
    assert [a for a, *_ in change_points.Programme([flat], 5, 0).segments(0, 15)[0]] == plain_segments(flat.tolist(), 5, 0)[1]


def test_integers_beyond_64_bits_stay_exact():
    s = [3_000_000_000 + 7 * k * (k % 5 == 0) for k in range(25)] + [1] * 10
    p = change_points.Programme([np.array(s, np.int64)], 5, 10_000)
    assert p.sums.dtype == object
    got, whole = p.segments(0, len(s))
    assert (whole, [a for a, *_ in got]) == plain_segments(s, 5, 10_000)
    assert all(v == 1 + (n * sum(x * x for x in s[a:a + n]) - t * t) // (n * n) for a, n, t, v, _ in got)


def test_logs_at_the_edge_of_an_integer():
    v = np.array([1, 2, 3, 10 ** 6, 2 ** 61])
    assert change_points.scaled_logs(v).tolist() == [math.floor(1000 * math.log(x)) for x in v.tolist()]


LINES = "vendor_id long, flag string, quantity int, shipped_at timestamp_ntz, day string, x string"


def test_change_points_of_odd_rows_equal_the_sql(spark):
    day = datetime.datetime(2024, 1, 1, 23, 59)
    rng = random.Random(8)
    rows = [(v, rng.choice(["kept", "swapped", "returned", None]), rng.choice([None, 0, 1, 3, 40, -2]), day + datetime.timedelta(days=rng.randrange(60)), "d", "x") for v in (1, 2, 3, None) for _ in range(200)]
    rows += [rows[0]] * 5 + [(9, "kept", 5, day, None, None), (8, "kept", None, day, None, None), (7, "kept", 1, None, None, None)]
    rows += [(6, "kept", k, day + datetime.timedelta(days=k), None, None) for k in range(4)] + [(4, "kept", 1, day, None, None), (4, "swapped", 2, day + datetime.timedelta(days=300), None, None)]
    lines = spark.createDataFrame(rows, LINES)
    got = sorted(map(tuple, change_points.change_points(lines).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE sale_lines (vendor_id BIGINT, flag VARCHAR, quantity INTEGER, shipped_at TIMESTAMP, day VARCHAR, x VARCHAR)")
    con.executemany("INSERT INTO sale_lines VALUES (?, ?, ?, ?, ?, ?)", rows)
    assert got == sorted(con.execute(change_points.ORACLE).fetchall(), key=str)
    assert {r[0] for r in got} == {1, 2, 3, 4, 6, 9, None}
    assert change_points.change_points(lines.limit(0)).collect() == []


# -- token alignment

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "two  spaces", "   three   ", "tab\there \n line\n \nbreak", "\n", " \n ", "<|endoftext|> is text <s> </s> <0x41>", "has ▁ a mark", "▁", "naïve café 漢字かな交じり文 😀😀 🏳️‍🌈",
    "word word word", "x" * 3000, "漢" * 500, "é   nbsp　wide \x1c ctrl\x00zero", "a   b", "1234567890 12.5% $99 'll don't", "word word word", "Ünïcödé ﬁ ligature Å", "﻿bom", "\r\nq \r\n w",
]


def byte_alphabet() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain_groups(text, libraries) -> list[tuple[list[int], list[int]]]:
    """Groups by walking both token sequences' bytes together."""
    a, b = libraries
    if not text:
        return []
    of = byte_alphabet()
    ta = [(k, bytes(of[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    tb = [(k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()) for k in b.encode(text) for p in [b.id_to_piece(k)]]
    want = (" " + text).encode()
    if b"".join(x for _, x in ta) != want or b"".join(x for _, x in tb) != want:
        return []
    out, x, y, ga, gb = [], 0, 0, [], []
    ta, tb = iter(ta), iter(tb)
    while True:
        if x <= y:
            k, raw = next(ta, (None, b""))
            if k is None:
                break
            ga.append(k)
            x += len(raw)
        else:
            k, raw = next(tb)
            gb.append(k)
            y += len(raw)
        if x == y:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def plain_alignment(rows, libraries):
    per = [(i, plain_groups(t, libraries)) for i, t in rows]
    count = Counter()
    for _, gs in per:
        count.update({(p, q) for ga, gb in gs for p in ga for q in gb})
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    out = []
    for i, gs in per:
        links = [(p, q) for ga, gb in gs for p in ga for q in gb]
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
        out.append((i, sum(len(g) for g, _ in gs), sum(len(g) for _, g in gs), len(gs), len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(written.encode()).hexdigest() if gs else ""))
    return out


@pytest.mark.parametrize(("size", "part"), [(token_alignment.BLOCK, token_alignment.PART), (50, 7), (token_alignment.BLOCK, 1)])
def test_alignment_of_odd_texts(spark, libraries, size, part, monkeypatch):
    monkeypatch.setattr(token_alignment._parts, "__defaults__", (part,))
    rows = [(k if k != 5 else None, t) for k, t in enumerate(ODD)] + [(6, "a "), (6, "a ")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, a string, block int").repartition(3)
    got = token_alignment.digest(docs, A, B, size=size)
    assert got.columns == [c.split()[0] for c in token_alignment.DIGEST.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_alignment(rows, libraries), key=str)
    assert token_alignment.digest(docs.limit(0), A, B).collect() == []


def test_alignment_of_the_documents(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = token_alignment.digest(docs, A, B, size=20_000).collect()
    assert sorted(map(tuple, got)) == sorted(plain_alignment(rows, libraries))


def test_alignment_of_random_strings(libraries):
    """Units, intervals and products agree with the walk on strings of many kinds of spaces and characters; products in slices too."""
    rng = random.Random(4)
    of = token_alignment.tables(A, B)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", "é", "漢", " ", " ", "  ", "\n", "\t", " ", "1", ".", "😀", "<s>"]) for _ in range(rng.randrange(1, 25)))
        block = token_alignment.Block(0, of)
        block.add(1, text)
        first, *more = block.rows().to_pylist()
        row = first | more[-1] | {k: first[k] for k in ("a", "b")}
        want = plain_groups(text, libraries)
        assert (row["n_groups"][0], row["n_links"][0]) == (len(want), sum(len(a) * len(b) for a, b in want)), text
        assert set(zip(row["a"], row["b"], strict=True)) == {(p, q) for a, b in want for p in a for q in b}, text


@pytest.mark.parametrize("slice_", [1 << 18, 7, 1])
def test_products_in_slices(slice_, monkeypatch):
    monkeypatch.setattr(token_alignment, "SLICE", slice_)
    rng = np.random.default_rng(1)
    n_a, n_b = rng.integers(1, 6, 40), rng.integers(1, 6, 40)
    ids_a, ids_b = rng.integers(0, 5, n_a.sum()).astype("<i4"), rng.integers(0, 5, n_b.sum()).astype("<i4")
    owner = np.sort(rng.integers(0, 9, 40))
    want, x, y = Counter(), 0, 0
    for o, p, q in zip(owner.tolist(), n_a.tolist(), n_b.tolist(), strict=True):
        want.update((o, int(a) << 32 | int(b)) for a, b in itertools.product(ids_a[x:x + p], ids_b[y:y + q]))
        x, y = x + p, y + q
    own, pair, n = token_alignment.linked(ids_a, ids_b, np.cumsum(n_a), np.cumsum(n_b), owner)
    assert dict(zip(zip(own.tolist(), pair.tolist(), strict=True), n.tolist(), strict=True)) == dict(want)


def test_groups_give_ranges_of_bytes(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in token_alignment.groups(docs, A, B).collect():
        text = ODD[r.doc_id]
        assert [(g.a, g.b) for g in r.groups] == plain_groups(text, libraries)
        assert [g.first for g in r.groups] == [0, *[g.past for g in r.groups]][:len(r.groups)]
        if r.groups:
            assert r.groups[-1].past == len((" " + text).encode())


# -- token files


@pytest.mark.parametrize("width", [1, 3, 8, 15, 16, 17, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 1003, dtype=np.uint64).astype("<u4")
    raw = token_files.pack_bits(ids, width)
    assert len(raw) == -(-len(ids) * width // 8)
    assert int.from_bytes(raw, "little") == sum(int(x) << k * width for k, x in enumerate(ids))
    assert (token_files.unpack_bits(raw, len(ids), width) == ids).all()
    assert (token_files.unpack_bits(raw, 100, width, 501) == ids[501:601]).all()
    if width < 32:
        with pytest.raises(ValueError, match="bits"):
            token_files.pack_bits(np.array([1 << width], np.uint32), width)


@pytest.mark.parametrize(("vocabulary", "width"), [(1, 1), (2, 1), (3, 2), (32_000, 15), (50_257, 16), (65_536, 16), (65_537, 17)])
def test_width_of_a_vocabulary(vocabulary, width):
    assert token_files.width_of(vocabulary) == width


def test_shard_ranges_and_damage(tmp_path):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 32_000, n).astype("<u4") for n in (0, 1, 7, 8, 9, 100, 0, 33, 1000)]
    path = str(tmp_path / "s.ids")
    store = pafs.LocalFileSystem()
    w = token_files.ShardWriter(store.open_output_stream(path), 32_000, 8)
    for k, d in enumerate(docs):
        w.add(k if k != 3 else None, d)
    assert w.close() == store.get_file_info(path).size
    flat = np.concatenate(docs)
    with store.open_input_file(path) as f:
        s = token_files.Shard(f)
        assert (s.width, s.ids, s.docs.tolist()[4], s.missing.tolist()) == (15, len(flat), 4, [0, 0, 0, 1, 0, 0, 0, 0, 0])
        assert all((s.document(k) == d).all() for k, d in enumerate(docs))
        for a, b in [(0, 0), (0, 1), (7, 9), (8, 16), (13, 1100), (0, len(flat))]:
            assert (s.range(a, b) == flat[a:b]).all()
        with pytest.raises(IndexError):
            s.range(0, len(flat) + 1)
    raw = bytearray((tmp_path / "s.ids").read_bytes())
    raw[40] ^= 1
    (tmp_path / "s.ids").write_bytes(raw)
    with store.open_input_file(path) as f:
        s = token_files.Shard(f)
        assert (s.range(64, 128) == flat[64:128]).all()
        with pytest.raises(ValueError, match="block 2"):
            s.range(16, 24)
    (tmp_path / "t.ids").write_bytes(bytes(100))
    with pytest.raises(ValueError, match="magic"), store.open_input_file(str(tmp_path / "t.ids")) as f:
        token_files.Shard(f)


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


def plain_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("block", [8, 4096])
def test_files_of_odd_texts(spark, block):
    rows = [*enumerate(reversed(ODD)), (None, "no id"), (None, None), (3, "same id"), (3, "same id"), (3, ""), (-7, "negative"), (50, "<|endoftext|>"), (51, "long " * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, start string, ids int").repartition(5)
    folder = scratch_folder(spark, "test-ids")
    shards = token_files.write(docs, folder, A, block=block)
    got = token_files.digest(shards, folder).orderBy("start").collect()
    pos = 0
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows if i is not None)) + [None, None]
    for r in got:
        assert r.start == pos
        pos += r.n_tokens
    key = lambda i, ids: (i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(key(i, plain_ids(t)) for i, t in rows)
    whole = {r.start: r.ids for r in token_files.read(shards, folder).collect()}
    flat = [x for s in sorted(whole) for x in whole[s]]
    assert len(flat) == pos and sorted(whole) == [r.start for r in got]
    asked = [(0, 5), (3, 0), (pos - 2, 10), (pos + 5, 3), (0, pos), (pos // 2, 300), (0, 5)]
    answers = token_files.windows(spark.createDataFrame(asked, "position long, length long"), shards, folder).collect()
    assert Counter((r.position, r.length, tuple(r.ids)) for r in answers) == Counter((p, n, tuple(flat[p:p + n])) for p, n in asked)
    # A lost attempt's shard is in no manifest: it is never read, and goes when asked to.
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_output_stream(f"{root}/part-0000000-lost.ids") as f:
        f.write(b"half a shard")
    assert token_files.digest(shards, folder).count() == len(rows)
    assert token_files.sweep(shards, folder) == ["part-0000000-lost.ids"]
    assert token_files.digest(shards, folder).count() == len(rows)


def test_files_of_the_documents_and_of_none(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in token_files.round_trip(docs, A).collect()}
    pos = 0
    for r in docs.orderBy("doc_id").collect():
        ids = plain_ids(r.text)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (pos, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        pos += len(ids)
    empty = token_files.round_trip(docs.limit(0), A)
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert token_files.round_trip(docs.where(F.lit(False)), A).count() == 0
