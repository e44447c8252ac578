"""Weighted co-membership graphs: edge derivation, degrees, components, pruning and closed-form layouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import dealt, materialize


def derive_edges(works: DataFrame, members: str = "person_ids", year: str = "year", tasks: int | None = None) -> DataFrame:
    """Undirected edges (src < dst) between members of one work, with weight, first_year and last_year.

    Members are cast to the element type they have, blanks and repeats go; works with fewer than two give
    nothing. Years that are null or not positive don't count. A work's pairs stream out of two nested explodes, member
    by member, so no row ever holds them all, and the only shuffle is that of the aggregate. With tasks (session.tasks_for)
    it has so many: the pairs go as they are, since a table of partial sums before the shuffle grows with a task's share.
    """
    ids = F.array_sort(F.array_distinct(F.filter(F.col(members), lambda x: x.isNotNull() & (F.trim(x.cast("string")) != ""))))
    good = F.when(F.col(year) > 0, F.col(year))
    pairs = (works.select(ids.alias("_ids"), good.alias("_year")).where(F.size("_ids") > 1)
             .select("_ids", "_year", F.posexplode("_ids").alias("_i", "src")).where(F.col("_i") + 1 < F.size("_ids"))
             .select("src", "_year", F.explode(F.slice("_ids", F.col("_i") + 2, F.size("_ids"))).alias("dst")))
    return (dealt(pairs, tasks, "src", "dst").groupBy("src", "dst")
            .agg(F.count("*").alias("weight"), F.min("_year").alias("first_year"), F.max("_year").alias("last_year")))


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge seen from either endpoint: node, other and the columns named."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *keep).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *keep))


def degrees(edges: DataFrame) -> DataFrame:
    """node, collaborators (edges at it) and shared_works (their weight)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(
        F.count("*").alias("collaborators"), F.sum("weight").alias("shared_works"))


#: Edges that one task of contracted() replaces by a forest.
EDGES = 250_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges that aren't the smallest of their component, each with that smallest node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    low = np.arange(len(nodes))
    while (open_ := low[a] != low[b]).any():
        a, b = low[a[open_]], low[b[open_]]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := low[low], low):
            low = further
    far = np.flatnonzero(low != np.arange(len(low)))
    return nodes[far], nodes[low[far]]


def contracted(pairs: DataFrame, count: int) -> tuple[DataFrame, bool]:
    """a, b: pairs (count of them) with the same components and no more edges than nodes in a task; whether these are the components.

    A task takes EDGES pairs or so and gives each node's smallest one among them. If all pairs fit into one, that is the
    smallest one reachable; else it is a start for the rounds of connected(). Nodes are integers or strings: other types stay as they are.
    """
    kind = pairs.schema["a"].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType)):
        return pairs, False
    tasks = max(1, -(-count // EDGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            a, b = stars(*(t.column(k).to_numpy() for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a, t.schema.field(0).type), pa.array(b, t.schema.field(1).type)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(x.num_rows for x in held) + batch.num_rows > EDGES:
                yield forest()
                held.clear()
            held.append(batch)
        if held:
            yield forest()

    return pairs.coalesce(tasks).mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])), tasks == 1


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for all nodes that have an edge to another node.

    Tasks first replace their edges by forests (contracted()), and one task's are components already: a round of joins is
    some nine shuffles, whose tasks the driver keeps book of however few the edges are. More edges than a task takes go on in rounds.

    A round alternates the large-star and small-star steps. Minima come from aggregates that combine before the
    shuffle, and come back by equi-joins in which only hubs are salted, so a hub with a third of all edges
    doesn't end in one task. Each round is written to the shared folder. Needs src and dst of one orderable type.
    """
    now = materialize(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
                      .where(F.col("a") != F.col("b")).distinct(), "edges")
    now, whole = contracted(now, now.count())
    now = materialize(now, "edges")
    seen = (0,) if whole else _digest(now)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        sym = now.union(now.select("b", "a")).toDF("u", "v")
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        star = with_minimum(sym.where(F.col("v") > F.col("u")), low, "u", "v", 2 * seen[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = star.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        near = with_minimum(star, least, "a", "b", 2 * seen[0])
        now = materialize(near.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                          .union(least.select("a", "m")).distinct(), "edges")
        then, seen = seen, _digest(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: At most so many keys are hubs; a hub's pairs are dealt to SALTS tasks.
HUBS, SALTS = 2000, 16


def with_minimum(pairs: DataFrame, low: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """pairs with the minimum m of their key. low: key, m, n (pairs of the key); total: the sum of n, at least.

    Keys with over total / HUBS pairs are hubs, of which there can be no more than HUBS: a bounded side. Their pairs are
    salted and their minima copied; all other keys are joined as they are.
    """
    hot = F.col("n") > max(16, total // HUBS)
    hubs = low.where(hot).select(F.col(key).alias("_hub"))
    salt = F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = pairs.join(F.broadcast(hubs), F.col(key) == F.col("_hub"), "left").withColumn("_salt", salt).drop("_hub")
    copies = low.select(key, "m", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))).alias("_salt"))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def number_rows(rows: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """rows with their place (from 0) in a total order, without one task that sees them all.

    A range exchange orders the partitions, each numbers its own rows, and the counts of the partitions before it
    (one row a partition: a bounded side) are added. End the order with a unique column.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_at", place).join(F.broadcast(before), "_p").select(*rows.columns, (F.col("_at") + F.col("_before")).cast("long").alias(name))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component, label, size: label counts from 0 by size (largest first), then smallest node.

    nodes has a column node. Singletons get labels. An edge to an unknown node is an error of the caller:
    see checks.dangling_edges.
    """
    members = nodes.select("node").distinct().join(connected(edges), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    ranked = number_rows(sizes, F.col("size").desc(), "component", name="label")
    return members.join(ranked, "component")


def prune_small(nodes: DataFrame, edges: DataFrame, minimum: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes (with component, label, size) of components of at least minimum nodes, and the edges among them."""
    labelled = components(nodes, edges)
    if minimum <= 1:
        return labelled, edges
    kept = labelled.where(F.col("size") >= minimum)
    ids = kept.select("node")
    inside = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, inside


def filter_edges(edges: DataFrame, minimum: int = 1, since: int = 0) -> DataFrame:
    """Edges of enough weight that were active in or after since (0: any time)."""
    return edges.where((F.col("weight") >= minimum) & ((F.lit(since) == 0) | (F.coalesce("last_year", F.lit(0)) >= since)))


def visible_subgraph(edges: DataFrame, nodes: DataFrame, groups: list, minimum: int = 1, since: int = 0) -> DataFrame:
    """Filtered edges whose two endpoints are in one of the groups (no group: all). nodes: node, groups array."""
    kept = filter_edges(edges, minimum, since)
    if not groups:
        return kept
    wanted = F.array(*[F.lit(g) for g in groups])
    ids = nodes.where(F.arrays_overlap("groups", wanted)).select("node").hint("shuffle_hash")
    return kept.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


#: Fixed value: the golden angle in radians.
GOLDEN = 2.399963229728653


def spiral(rank: Column, radius: Column) -> tuple[Column, Column]:
    """Point number rank (from 0) of a golden-angle spiral; distance grows with the root of the rank."""
    away = radius * F.sqrt(rank + F.lit(0.5))
    return away * F.cos(rank * F.lit(GOLDEN)), away * F.sin(rank * F.lit(GOLDEN))


def ring_layout(nodes: DataFrame, ring: float = 2.6, spread: float = 0.34, digits: int = 3) -> DataFrame:
    """node, grp, x, y: groups on a ring, members of a group on a spiral by degree (highest first), then id.

    nodes: node, grp, degree. A group's spiral has the radius spread * sqrt(members). Ranks come from one numbering of
    all nodes by ranges, so a group of any size is dealt to several tasks; a group's row is its first number and its index.
    """
    placed = number_rows(nodes.select("node", "grp", "degree"), "grp", F.col("degree").desc(), "node", name="_at")
    groups = number_rows(placed.groupBy("grp").agg(F.min("_at").alias("_first")), "grp", name="g")
    n = groups.agg(F.count("*").alias("n_groups"))
    ranked = placed.join(groups, "grp").crossJoin(F.broadcast(n))
    angle = F.lit(2.0) * F.pi() * F.col("g") / F.col("n_groups")
    x, y = spiral(F.col("_at") - F.col("_first"), F.lit(spread))
    return normalize_layout(ranked.select("node", "grp", (F.lit(ring) * F.cos(angle) + x).alias("x"), (F.lit(ring) * F.sin(angle) + y).alias("y")), digits)


def normalize_layout(points: DataFrame, digits: int = 3) -> DataFrame:
    """Centre on the middle of the bounding box and scale both axes by the larger half-extent."""
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    half = F.greatest((F.col("hi_x") - F.col("lo_x")) / 2, (F.col("hi_y") - F.col("lo_y")) / 2, F.lit(1e-9))
    put = lambda c: (F.round((F.col(c) - (F.col(f"hi_{c}") + F.col(f"lo_{c}")) / 2) / half, digits) + F.lit(0.0)).alias(c)
    return points.crossJoin(F.broadcast(box)).select(*[c for c in points.columns if c not in "xy"], put("x"), put("y"))


def satellites(labelled: DataFrame, smallest_main: int = 5, ring: float = 1.0, local: float = 0.05) -> DataFrame:
    """node, label, x, y for nodes of components below smallest_main: components spaced on a ring, half a step on, members around.

    labelled: node, component, label, size. Components go round by label. A component has fewer than smallest_main nodes.
    """
    small = labelled.where(F.col("size") < smallest_main)
    comps = small.groupBy("label").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    total = comps.agg(F.count("*").alias("n_comps"))
    spot = number_rows(comps, "label", name="c").crossJoin(F.broadcast(total)).select("label", "c", "n_comps", F.size("nodes").alias("size"), F.posexplode("nodes").alias("_at", "node"))
    a = F.lit(2.0) * F.pi() * (F.col("c") + 0.5) / F.col("n_comps")
    b = F.lit(2.0) * F.pi() * F.col("_at") / F.col("size")
    r = F.lit(local) * F.col("size")
    return spot.select("node", "label", (F.lit(ring) * F.cos(a) + r * F.cos(b)).alias("x"), (F.lit(ring) * F.sin(a) + r * F.sin(b)).alias("y"))


def with_satellites(labelled: DataFrame, layout: DataFrame, smallest_main: int = 5, digits: int = 3) -> DataFrame:
    """node, label, x, y of all nodes: the layout of the large components and the satellites around it, brought into the unit box.

    layout: node, x, y of the nodes of components of at least smallest_main. Without such a component it is the
    layout of all nodes, and is returned as it is.
    """
    every = layout.join(labelled.select("node", "label"), "node").select("node", "label", "x", "y")
    if labelled.where(F.col("size") >= smallest_main).isEmpty():
        return every
    both = every.unionByName(satellites(labelled, smallest_main))
    scale = both.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y"))).alias("s"))
    put = lambda c: (F.round(F.col(c) / F.col("s"), digits) + F.lit(0.0)).alias(c)
    return both.crossJoin(F.broadcast(scale)).select("node", "label", put("x"), put("y"))
