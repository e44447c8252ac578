"""The two collaboration networks as compositions: people of one directory, and people with trainees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import checks, entity, graph, views


@dataclass
class Network:
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame


def faculty_network(people: DataFrame, works: DataFrame, counts: DataFrame, minimum: int = 5, cap: int = 0) -> Network:
    """people: id, full_name, division_ids (the first is the group). works: work_id, person_ids, year. counts: id, n.

    Unknown ids fail before pruning, as a pruned edge would hide them. The directory's size and the capped count
    are taken over everybody, the other statistics over what is left.
    """
    edges = graph.derive_edges(works)
    ids = people.select(F.col("id").alias("node"))
    checks.enforce(checks.dangling_edges(edges, ids), "works of unknown people")
    linked = graph.both_ways(edges).select("node").distinct()
    kept, inside = graph.prune_small(linked, edges, minimum)
    grp = people.select(F.col("id").alias("node"), "full_name", F.try_element_at("division_ids", F.lit(1)).alias("grp"))
    nodes = kept.join(grp, "node").join(graph.degrees(inside), "node", "left").join(counts.select(F.col("id").alias("node"), F.col("n").alias("publications")), "node", "left").select(
        "node", "full_name", "grp", "label", F.coalesce("publications", F.lit(0)).alias("publications"), F.coalesce("collaborators", F.lit(0)).alias("collaborators"), F.coalesce("shared_works", F.lit(0)).alias("shared_works"))
    placed = graph.ring_layout(nodes.select("node", "grp", F.col("collaborators").alias("degree"))).select("node", "x", "y")
    bridge = works.select("work_id", F.explode(F.array_distinct("person_ids")).alias("person_id"))
    base = views.graph_stats(kept.select("node"), inside, bridge, grp.select("node", "grp"))
    comps = kept.select("component", "size").distinct().agg(F.count("*").alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component"))
    everybody = people.agg(F.count("*").alias("people"))
    stats = base.crossJoin(comps).crossJoin(everybody).crossJoin(views.capped_count(counts, cap))  # one-row tables
    return Network(nodes.join(placed, "node"), inside, stats)


def trainee_network(faculty: DataFrame, faculty_works: DataFrame, trainees: DataFrame, trainee_works: DataFrame) -> Network:
    """One graph of faculty and trainees; small components stay, groups count every member.

    faculty: id, division_ids. *_works: work_id, keys (identity keys in order), person_ids, year. trainees: id,
    faculty_id (null or the person that they are), group_id. A trainee's work that the faculty has, by its first
    known key, is that work.
    """
    same = trainees.select(F.col("id").alias("_t"), F.coalesce("faculty_id", "id").alias("_p"))
    build = faculty_works.withColumn("ordinal", F.col("work_id"))
    probe = trainee_works.withColumnRenamed("work_id", "probe")
    match = entity.first_key_match(probe, build, "probe", "work_id")
    theirs = probe.join(match, "probe").select(F.coalesce("match", "probe").alias("work_id"), "year", F.explode("person_ids").alias("_t")).join(same, "_t", "left").select(
        "work_id", "year", F.coalesce("_p", "_t").alias("person_id"))
    bridge = faculty_works.select("work_id", "year", F.explode("person_ids").alias("person_id")).unionByName(theirs)
    works = bridge.groupBy("work_id").agg(F.collect_set("person_id").alias("person_ids"), F.max("year").alias("year"))
    edges = graph.derive_edges(works)
    people = entity.collapse_people(trainees, faculty)
    checks.enforce(checks.dangling_edges(edges, people), "works of unknown people")
    mine = bridge.groupBy(F.col("person_id").alias("node")).agg(F.array_sort(F.collect_set("work_id")).alias("work_ids"))
    nodes = people.join(graph.degrees(edges), "node", "left").join(mine, "node", "left").select(
        "node", "kind", "groups", F.coalesce("collaborators", F.lit(0)).alias("collaborators"), F.coalesce("shared_works", F.lit(0)).alias("shared_works"), "work_ids")
    return Network(nodes, edges, views.membership_counts(people))


def organic_layout(nodes: DataFrame, edges: DataFrame, steps: int = 400, most: int = 5000, still: float = 1e-4) -> DataFrame:
    """node, x, y by Fruchterman and Reingold's force layout from a golden-angle spiral of the sorted nodes, so nothing is random.

    All pairs repel by k^2 / d and edges pull by weight * d / k, with k = 1 / sqrt(n); a step's length starts at a tenth
    of the wider side and cools evenly over the steps, and the layout ends early when it stands still. One task: all
    nodes repel one another, so there is nothing to deal out; it is meant for a pruned graph and takes at most most
    nodes, which is checked first.
    """
    if nodes.limit(most + 1).count() > most:
        raise checks.ContractError(f"the organic layout takes at most {most} nodes")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.loc[pdf["dst"].isna(), "src"])
        at = {n: k for k, n in enumerate(ids)}
        links = pdf[pdf["dst"].notna()]
        n = len(ids)
        pull = np.zeros((n, n))
        i, j = links["src"].map(at).to_numpy(int), links["dst"].map(at).to_numpy(int)
        pull[i, j] = pull[j, i] = links["weight"].to_numpy(float)
        k = np.arange(n)
        xy = np.stack([np.cos(k * graph.GOLDEN), np.sin(k * graph.GOLDEN)], 1) * np.sqrt((k + 0.5) / max(n, 1))[:, None]
        ideal = 1 / np.sqrt(max(n, 1))
        reach = 0.1 * np.ptp(xy, axis=0).max() if n else 0.0
        cool = reach / (steps + 1)
        for _ in range(steps if n > 1 else 0):
            away = xy[:, None] - xy[None]
            dist = np.maximum(np.sqrt((away ** 2).sum(2)), 0.01)
            force = (away * (ideal ** 2 / dist ** 2 - pull * dist / ideal)[..., None]).sum(1)
            step = force * (reach / np.maximum(np.sqrt((force ** 2).sum(1)), 0.01))[:, None]
            xy = xy + step
            reach -= cool
            if np.sqrt((step ** 2).sum()) / n < still:
                break
        return pd.DataFrame({"node": ids, "x": xy[:, 0], "y": xy[:, 1]})
    kind = dict(nodes.dtypes)["node"]
    rows = nodes.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(0).cast("long").alias("weight")).unionByName(edges.select("src", "dst", F.col("weight").cast("long").alias("weight")))
    return graph.normalize_layout(rows.groupBy().applyInPandas(place, f"node {kind}, x double, y double"))
