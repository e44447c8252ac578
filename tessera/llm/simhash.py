"""SimHash near-dedup with pigeonring filtering.

Fingerprints of b bits are cut into m segments on a ring. If two fingerprints differ in at most t bits, then
from some segment on, each chain of consecutive segments of length l differs in at most floor(l * t / m) bits
(the strong form of the pigeonring principle). With m = t + 1 the first segment of the chain is equal and the
first two differ in at most one bit: that pair of segments is the join key. The longer chains of the ring are
checked on the pairs that meet, and the full Hamming distance last.

Results for odd input: null text is empty; a text without words has fingerprint zero and is linked like any
other; equal fingerprints are one node, so thousands of copies cost one row; an empty table gives no rows;
very long texts are hashed whole, some shingles at a time; repeated doc_ids and repeated rows give a row each; rows
without a doc_id belong to the class of rows with their fingerprint and link no others (component_id is null if there is none).
near_duplicates() never reads other columns; drop_similar() carries whole rows through, whatever their columns
are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_batches, carried, columns, min_labels, sorted_groups, texts, with_computed
from tessera.operators.graph import connected, with_minimum
from tessera.session import materialize, once

BITS = 64
#: Rows of a bucket that one task compares with one another; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024

# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(buf: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each buf[start:end], for many slices at once."""
    raw = np.frombuffer(buf + b"\0" * 8, np.uint8)
    w64 = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    w32 = np.ndarray((len(raw) - 7,), "<u4", raw, strides=(1,))
    seed = np.uint64(seed)
    n = end - start
    at = start.copy()
    h = np.full(len(n), seed + P5)
    with np.errstate(over="ignore"):
        if (big := np.flatnonzero(n >= 32)).size:
            v = [np.full(big.size, s) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            pos, left = at[big].copy(), n[big] // 32
            live = np.arange(big.size)
            while live.size:
                for k in range(4):
                    v[k][live] = _round(v[k][live], w64[pos[live] + 8 * k])
                pos[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[big] = acc
            at[big] = pos
        h += n.astype(np.uint64)
        for _ in range(3):
            go = np.flatnonzero(end - at >= 8)
            if not go.size:
                break
            h[go] = _rot(h[go] ^ _round(np.zeros(go.size, np.uint64), w64[at[go]]), 27) * P1 + P4
            at[go] += 8
        if (go := np.flatnonzero(end - at >= 4)).size:
            h[go] = _rot(h[go] ^ (w32[at[go]].astype(np.uint64) * P1), 23) * P2 + P3
            at[go] += 4
        for _ in range(3):
            go = np.flatnonzero(end > at)
            if not go.size:
                break
            h[go] = _rot(h[go] ^ (raw[at[go]].astype(np.uint64) * P5), 11) * P1
            at[go] += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def shingle_hashes(text: str, size: int, seed: int, step: int = 1 << 15) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, repeats included, some at a time. None for a text without words."""
    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    start = np.concatenate([[0], gaps + 1])
    end = np.concatenate([gaps, [len(joined)]])
    n = max(1, len(start) - size + 1)
    end = end[min(size, len(start)) - 1:]
    for k in range(0, n, step):
        lo, hi = start[k:min(n, k + step)], end[k:min(n, k + step)]
        yield xxh64(joined[lo[0]:hi[-1]], lo - lo[0], hi - lo[0], seed)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """For each bit, in how many of the hashes it is set."""
    return np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)


def as_fingerprint(ones: np.ndarray, n: int, kind: str = "<u8") -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(kind)[0])


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, size, seed):
        ones += set_bits(h)
        n += len(h)
    return as_fingerprint(ones, n)


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, body = columns(b, "doc_id", "text")
            fp = np.array([fingerprint(x, size, seed) for x in body], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """Where each of distance + 1 segments begins, and its bits."""
    m = distance + 1
    cut = [round(k * BITS / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def _mask(start: int, width: int) -> int:
    return ((1 << width) - 1) << start


def ring_keys(nodes: DataFrame, distance: int) -> DataFrame:
    """key, fp, rep, probe, seg: a row in each segment's own bucket, and a probe for each bit that is 0 in the next segment.

    Of two fingerprints that differ in one bit of that segment, the one with 0 there probes the bucket of the
    other; so probing only the zeros finds each such pair once. nodes: fp, rep, tab (fingerprints of different
    tables never meet).
    """
    segs = segments(distance)
    m = len(segs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            rep = b.column(1).to_numpy()
            tab = b.column(2).to_numpy().astype(np.uint64)
            for i, (s, w) in enumerate(segs):
                s2, w2 = segs[(i + 1) % m]
                both = np.uint64(_mask(s, w) | (_mask(s2, w2) if m > 1 else 0))
                for flip in [None, *(range(s2, s2 + w2) if m > 1 else ())]:
                    one = np.uint64(0 if flip is None else 1 << flip)
                    pick = np.arange(len(fp)) if flip is None else np.flatnonzero((fp & one) == 0)
                    f, r = fp[pick], rep[pick]
                    if not len(f):
                        continue
                    with np.errstate(over="ignore"):
                        key = _rot(((f | one) & both) * P2 + np.uint64(i), 29) * P1 + tab[pick] * P3
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(f.view(np.int64)), pa.array(r), pa.array(np.full(len(f), flip is not None)),
                         pa.array(np.full(len(f), i, np.int8))], ["key", "fp", "rep", "probe", "seg"])

    return nodes.select("fp", "rep", "tab").mapInArrow(run, "key long, fp long, rep long, probe boolean, seg byte")


def _ring_links(x: np.ndarray, y: np.ndarray, seg: int, segs: list[tuple[int, int]], distance: int) -> np.ndarray:
    """Which of x (rows) and y (columns) keep to every chain budget from segment seg on, the whole ring included."""
    differ = x[:, None] ^ y[None, :]
    m = len(segs)
    ok = np.ones(differ.shape, bool)
    mask = 0
    for length in range(1, m + 1):
        mask |= _mask(*segs[(seg + length - 1) % m])
        ok &= np.bitwise_count(differ & np.uint64(mask)) <= length * distance // m
    return ok


def links(nodes: DataFrame, distance: int = 4, block: int = BLOCK, sketches: DataFrame | None = None, similarity: float = 0.0) -> DataFrame:
    """src, dst: enough pairs of representatives within distance to connect what is connected.

    nodes: fp, rep, tab. sketches (rep, sketch): pairs must also agree in a share of similarity of the sketch; with a
    column bands (array of keys), pairs that share one of them are candidates too, whatever their fingerprints.
    Each bucket is compared in blocks of at most about block rows against block rows; a task emits a spanning
    forest of what it found, so the rows out grow with the rows in and not with the square of a group. Buckets
    above one block are dealt out as pairs of blocks to different tasks.
    """
    segs = segments(distance)
    made = ring_keys(nodes, distance)
    if sketches is not None and "bands" in sketches.columns:
        zero = F.lit(0)
        made = made.unionByName(sketches.select(F.explode("bands").alias("key"), zero.cast("long").alias("fp"), "rep", F.lit(False).alias("probe"), zero.cast("byte").alias("seg")))
    keys = materialize(made, "ring")
    # A bucket can hold a link only if it has an index row and a second row.
    sizes = keys.groupBy("key").agg(F.count_if(~F.col("probe")).alias("n_index"), F.count("*").alias("n")).where(
        (F.col("n_index") > 0) & (F.col("n") > 1)).select("key", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    rows = keys.join(sizes, "key")
    extra = []
    if sketches is not None:
        rows, extra = rows.join(sketches.select("rep", "sketch"), "rep"), ["sketch"]
    mine = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    dealt = rows.withColumn("blk", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "key", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), "blk", "fp", "rep", "probe", "seg", *extra)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 3):
            src, dst = [], []
            bounds = np.append(g["_start"], len(g["key"]))
            fps = g["fp"].view(np.uint64)
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo < 2:
                    continue
                fp, rep, probe, blk = fps[lo:hi], g["rep"][lo:hi], g["probe"][lo:hi], g["blk"][lo:hi]
                if probe.all():
                    continue
                ok = _ring_links(fp, fp, int(g["seg"][lo]), segs, distance)
                ok &= ~(probe[:, None] & probe[None, :])
                if g["a"][lo] != g["b"][lo]:
                    ok &= blk[:, None] != blk[None, :]
                np.fill_diagonal(ok, False)
                if not ok.any():
                    continue
                if extra:
                    sk = np.frombuffer(b"".join(g["sketch"][lo:hi]), np.uint8).reshape(hi - lo, -1)
                    for i in np.flatnonzero(ok.any(axis=1)):
                        ok[i] &= (sk == sk[i]).mean(axis=1) >= similarity
                    ok |= ok.T
                label = min_labels(ok)
                far = np.flatnonzero(label != np.arange(len(label)))
                src.append(rep[far])
                dst.append(rep[label[far]])
            if src:
                s, d = np.concatenate(src), np.concatenate(dst)
                keep = s != d
                yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(d[keep])], ["src", "dst"])

    return ordered.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    fps = materialize(fingerprints(docs, size, seed, id_col, text_col), "fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = once(lambda: connected(links(nodes.where(F.col("rep").isNotNull()).withColumn("tab", F.lit(0)), distance)), "classes")
    classes = nodes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _multipliers(n: int) -> np.ndarray:
    """Odd multipliers that turn one hash into many, by a linear congruential rule."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x | 1)
    return np.array(out, np.uint64)


SKETCH = 128
#: Minima of a band. Two sets of Jaccard similarity 0.8 share none of SKETCH / BAND bands with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
BAND = 4
#: Standard errors of the sketch below the similarity that a pair may have and is still verified.
SLACK = 4.5
#: Bytes of text in a block of the verification.
BLOCK_BYTES = 16 << 20


def sketch(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The smallest of the hashes under each of many permutations."""
    low = np.full(len(many), np.uint64((1 << 64) - 1))
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 512):
            x = hashes[k:k + 512, None] * many[None, :]
            low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band of the minima."""
    parts = low.reshape(-1, BAND)
    key = np.arange(len(parts), dtype=np.uint64) * P3
    with np.errstate(over="ignore"):
        for k in range(BAND):
            key = _round(key, parts[:, k])
    return key.view(np.int64)


def shingle_set(text: str, size: int, seed: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, size, seed)]))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verified(members: DataFrame, similarity: float, floor: float, size: int, seed: int, block: int = BLOCK) -> DataFrame:
    """src, dst: enough pairs whose shingle sets have at least that Jaccard similarity to connect what is connected.

    members: component (of candidates), node, sketch, text. Pairs whose sketches agree in less than floor, and pairs
    that are connected already, aren't counted. Components above a block are dealt out as pairs of blocks.
    """
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("nb"))
    rows = members.join(sizes, "component").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "component", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), "blk", "node", "sketch", "text")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(n, "component", "a", "b").sortWithinPartitions("component", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 3):
            src, dst = [], []
            bounds = np.append(g["_start"], len(g["node"]))
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo < 2:
                    continue
                body, blk, cross = g["text"][lo:hi], g["blk"][lo:hi], g["a"][lo] != g["b"][lo]
                sk = np.frombuffer(b"".join(g["sketch"][lo:hi]), np.uint8).reshape(hi - lo, -1)
                sets: dict[int, np.ndarray] = {}

                def of(i: int, sets: dict = sets, body: np.ndarray = body) -> np.ndarray:
                    if i not in sets:
                        sets[i] = shingle_set(body[i], size, seed)
                    return sets[i]

                label = np.arange(hi - lo)
                for i in range(hi - lo - 1):
                    like = (sk[i + 1:] == sk[i]).mean(axis=1)
                    if cross:
                        like[blk[i + 1:] == blk[i]] = -1
                    left = i + 1 + np.argsort(-like, kind="stable")[:np.count_nonzero(like >= floor)]
                    while (left := left[label[left] != label[i]]).size:
                        j, left = left[0], left[1:]
                        if jaccard(of(i), of(j)) >= similarity:
                            label[label == label[j]] = label[i]
                            src.append(g["node"][lo + i])
                            dst.append(g["node"][lo + j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return ordered.mapInArrow(run, "src long, dst long").where("src <> dst")


def similar_rows(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 4, seed: int = 42,
                 id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with a number (rid) and all their columns (row), and rid, doc_id, class: a number for rows of one class.

    Classes are of rows whose word shingles of that size have a Jaccard similarity of at least similarity. An edit that
    leaves 0.8 of the five-word shingles turns over ten of 64 bits of their SimHash, beyond any selective index. So
    candidates are pairs within distance by their SimHash, found by pigeonring filtering, and pairs that share a band of
    minima of the shingle sets, which depend on the shingles' Jaccard similarity alone and not on the kind of edit.
    Pairs whose sketches of SKETCH minima agree (less SLACK standard errors) form components of candidates, and links
    inside these are verified by the sets of shingles themselves. Rows of equal shingle sets are one node.
    """
    bounded_batches(docs.sparkSession)
    many = _multipliers(SKETCH)
    floor = similarity - SLACK * (similarity * (1 - similarity) / SKETCH) ** 0.5
    kind = pa.struct([("fp", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64())), ("same", pa.binary())])

    def features(body: list[str]) -> pa.Array:
        out = []
        for text in body:
            ones, n = np.zeros(BITS, np.int64), 0
            low = np.full(SKETCH, np.uint64((1 << 64) - 1))
            hashes = [np.zeros(0, np.uint64)]
            for h in shingle_hashes(text, size, seed):
                ones += set_bits(h)
                n += len(h)
                low = np.minimum(low, sketch(h, many))
                hashes.append(h)
            own = np.unique(np.concatenate(hashes))
            out.append({"fp": as_fingerprint(ones, n, "<i8"), "sketch": (low >> np.uint64(7)).astype(np.uint8).tobytes(), "bands": band_keys(low),
                        "same": hashlib.blake2b(own.tobytes(), digest_size=16).digest()})
        return pa.array(out, kind)

    made = T.StructType().add("fp", "long").add("sketch", "binary").add("bands", T.ArrayType(T.LongType())).add("same", "binary")
    rows = materialize(with_computed(carried(docs, id_col, rid=F.monotonically_increasing_id()), text_col, "f", made, lambda: features), "rows")
    nodes = materialize(rows.groupBy("f.same").agg(F.min("rid").alias("rep"), F.min_by(F.struct("f.fp", "f.sketch", "f.bands"), "rid").alias("f")).select(
        "same", "rep", "f.fp", "f.sketch", "f.bands"), "nodes")
    near = once(lambda: connected(links(nodes.withColumn("tab", F.lit(0)), distance, sketches=nodes.select("rep", "sketch", "bands"), similarity=floor)), "near")
    text = rows.select(F.col("rid").alias("node"), F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text"))
    members = near.join(nodes.select(F.col("rep").alias("node"), "sketch"), "node").join(text, "node")
    comps = once(lambda: connected(verified(members, similarity, floor, size, seed)), "classes")
    classes = nodes.join(comps, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("component", "rep").alias("class"))
    return rows, rows.select("rid", "doc_id", F.col("f.same").alias("same")).join(classes, "same").select("rid", "doc_id", "class")


def similar_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its class) for every row, see similar_rows()."""
    _, of = similar_rows(docs, size, similarity, distance, seed, id_col, text_col)
    return of.join(of.groupBy("class").agg(F.min("doc_id").alias("component_id")), "class").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each class of similar_rows(): that with the smallest doc_id (a null one last, of ties the first row).

    Columns are those the rows came with. The numbers of the rows that go are written first, so that the planner knows
    their size: a small list is broadcast and the texts aren't shuffled, a large one is joined.
    """
    rows, of = similar_rows(docs, size, similarity, distance, seed, id_col, text_col)
    best = of.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m"), F.count("*").alias("n"))
    gone = materialize(with_minimum(of, best, "class", "rid", rows.count()).where(F.col("rid") != F.col("m.rid")).select("rid"), "gone")
    return rows.join(gone, "rid", "left_anti").select("row.*")
