"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its NEAREST nearest reference points (pivots), in order. Inverted lists, one for each
label and pivot, hold the vectors that have the pivot in their permutation. Two vectors of a list are a candidate
if they share at least SHARED pivots, and are verified by their cosine in double precision. A pair is looked at
in the list of its lowest shared pivot only.

Pivots are rows of the table taken by hash of the vector, for each vector length its own: ROOTS times the square root
of that length's rows, at least LEAST and at most MOST and what fits into PIVOT_BYTES, so lists grow with the root of the
rows until then. It is a bounded sample, of which crowded ones are left out;
every row is indexed. Lengths of few rows, and all lengths beyond the
WIDTHS most frequent, need none: their vectors are one list for each label, compared in full. exact=True does
that for every length. Equal vectors of one label are one node with a weight, so copies are never expanded.
Lists longer than a block are dealt out as pairs of blocks; tasks return sums of links and a spanning forest,
never the pairs.

Results for odd input: vectors that are null, zero, or hold null or non-finite components, and vectors without a
label, link with nothing; vectors of different lengths never link; a cosine that ties with the threshold links; repeated
vec_ids are vectors of their own; rows without a vec_id count as copies of equal vectors and link no others; an empty table gives no rows. Only id, vector and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, min_labels, sorted_groups
from tessera.operators.graph import connected
from tessera.session import materialize

ROOTS, LEAST, MOST, PIVOT_BYTES, WIDTHS = 8, 256, 8192, 32 << 20, 32
NEAREST = 8
SHARED = 2
BLOCK = 512


def unit_vectors(rows: DataFrame) -> DataFrame:
    """rows (vec_id, raw, label) with vec: raw scaled to length 1 in double precision; null where it can't link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.array([] if raw is None or label is None or None in raw else raw, float)
                if len(x) and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()  # before squaring: no overflow, no underflow
                    out.append(x / np.sqrt(x @ x) + 0.0)
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "label", "vec"])

    return rows.select("vec_id", "raw", "label").mapInArrow(run, "vec_id long, label string, vec array<double>")


def apart(points: np.ndarray, threshold: float) -> np.ndarray:
    """Those points that are further from all earlier ones that stay than twice the angle at which vectors link."""
    most = 2 * threshold * threshold - 1
    stay = np.ones(len(points), bool)
    for k in range(len(points)):
        if stay[k]:
            stay[k + 1:] &= points[k + 1:] @ points[k] <= most
    return points[stay]


def choose_pivots(nodes: DataFrame, threshold: float, least: int = LEAST, few: int = BLOCK, most_bytes: int = PIVOT_BYTES) -> dict[int, np.ndarray]:
    """For each frequent vector length its pivots: the rows with the smallest hashes, the same on every run. Bounded by most_bytes.

    Pivots that crowd in one dense place would cut it up, so only those apart() from one another stay.
    """
    lengths = nodes.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).where(F.col("n") > few).orderBy(F.col("n").desc(), "width").limit(WIDTHS).collect()
    wanted = {r["width"]: min(max(least, int(ROOTS * r["n"] ** 0.5)), r["n"], MOST, most_bytes // len(lengths) // (8 * r["width"])) for r in lengths}
    chosen = {}
    for r in lengths:  # at most WIDTHS
        w, n, p = r["width"], r["n"], wanted[r["width"]]
        # Twice as many rows as are wanted pass the hash, so that ordering them is cheap.
        part = nodes.where(F.size("vec") == w).withColumn("_r", F.xxhash64("h", F.lit(7))).where(F.pmod("_r", F.lit(1 << 30)) <= min(1.0, 2 * p / n + 64 / n) * (1 << 30))
        chosen[w] = apart(np.array([x["vec"] for x in part.orderBy("_r", "h", "node").limit(p).select("vec").collect()]).reshape(-1, w), threshold)
    return {w: x for w, x in chosen.items() if len(x) > 1}


def permutations(nodes: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """nodes with perm: the numbers of the nearest pivots of its length, nearest first; [-1] where the length has none. pivots: unit rows."""
    where = nodes.sparkSession.sparkContext.broadcast(pivots)
    names = nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(names.index("vec"))
            size = vecs.value_lengths().to_numpy()
            perm = np.full(b.num_rows, None, object)
            for w in np.unique(size):
                at = np.flatnonzero(size == w)
                if w not in where.value:
                    perm[at] = [[-1]] * len(at)
                    continue
                x = vecs.take(pa.array(at)).flatten().to_numpy().reshape(-1, w)
                for lo in range(0, len(at), 256):
                    like = x[lo:lo + 256] @ where.value[w].T
                    k = min(nearest, like.shape[1])
                    some = np.argpartition(-like, k - 1, axis=1)[:, :k]
                    order = np.lexsort((some, -np.take_along_axis(like, some, 1)), axis=1)
                    for i, row in zip(at[lo:lo + 256], np.take_along_axis(some, order, 1), strict=True):
                        perm[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(perm), pa.list_(pa.int32()))], [*names, "perm"])

    return nodes.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in nodes.dtypes) + ", perm array<int>")


def candidates(perm: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Pairs of rows that share at least that many pivots, none of them below pivot: those are looked at in a lower pivot's list."""
    if pivot < 0:
        return np.ones((len(perm), len(perm)), bool)
    own, at = np.unique(perm, return_inverse=True)  # neighbours have few pivots between them
    has = np.zeros((len(perm), len(own)), np.float32)
    np.put_along_axis(has, at.reshape(perm.shape), 1.0, axis=1)
    low = np.searchsorted(own, pivot)
    ok = has @ has.T >= shared
    if low and ok.any():
        ok &= has[:, :low] @ has[:, :low].T == 0
    return ok


def links(indexed: DataFrame, threshold: float = 0.93, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """node, weight, low: for each list that found links of a node, the linked rows (copies count) and a node that it
    reaches there, the same for all that it reaches. indexed: node, label, vec (unit), copies, perm."""
    rows = indexed.select("node", "label", F.size("vec").alias("width"), "vec", "copies", "perm", F.explode("perm").alias("pivot"))
    key = ["label", "width", "pivot"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, key).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    dealt = rows.withColumn("blk", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        *key, F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), "blk", "node", "vec", "copies", "perm")

    n = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(n, "label", "width", "pivot", "a", "b").sortWithinPartitions("label", "width", "pivot", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 5):
            bounds = np.append(g["_start"], len(g["node"]))
            out = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo < 2:
                    continue
                node, copies, blk, pivot = g["node"][lo:hi], g["copies"][lo:hi], g["blk"][lo:hi], g["pivot"][lo]
                x, perm = np.stack(g["vec"][lo:hi]), np.stack(g["perm"][lo:hi])
                ok = candidates(perm, pivot, min(shared, perm.shape[1]))
                if g["a"][lo] != g["b"][lo]:
                    ok &= blk[:, None] != blk[None, :]
                ok &= x @ x.T >= threshold
                np.fill_diagonal(ok, False)
                if ok.any():
                    weight = ok @ copies
                    hit = weight > 0
                    out.append((node[hit], weight[hit], node[min_labels(ok)][hit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "weight", "low"])

    return ordered.mapInArrow(run, "node long, weight long, low long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, least: int = LEAST, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK, exact: bool = False,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. exact: compare all vectors of a label and length, without pivots."""
    bounded_batches(vectors.sparkSession, 4000)
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("raw"), F.col(label_col).cast("string").alias("label"))
    units = materialize(unit_vectors(every).withColumn("h", F.xxhash64("vec")), "units")
    member = units.where(F.col("vec").isNotNull())
    nodes = member.groupBy("label", "h", "vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = materialize(nodes.select("node", "label", "h", "vec", "copies"), "vectors")
    indexed = permutations(nodes, {} if exact else choose_pivots(nodes, threshold, least, block), nearest)
    found = materialize(links(indexed.where(F.col("node").isNotNull()), threshold, shared, block), "links")
    comps = connected(found.select(F.col("node").alias("src"), F.col("low").alias("dst")))
    weight = found.groupBy("node").agg(F.sum("weight").alias("weight"))
    known = nodes.join(weight, "node", "left").join(comps, "node", "left").select(
        "label", "h", "vec", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = member.join(known, ["label", "h", "vec"]).select("vec_id", "n_links", "component_id")
    rest = units.where(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
