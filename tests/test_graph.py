"""Edges, components, pruning, networks, layouts and their contracts."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks, entity, graph, views
from tessera.plans import adapters
from tessera.session import tasks_for


def works(spark, *rows):
    return spark.createDataFrame([(f"w{k}", list(ids), year) for k, (ids, year) in enumerate(rows)], "work_id string, person_ids array<string>, year int")


def edges(df):
    return {(r["src"], r["dst"]): (r["weight"], r["first_year"], r["last_year"]) for r in df.collect()}


@pytest.mark.parametrize(("rows", "want"), [
    ([("a", 2000)], {}),
    ([("ab", 2018), ("ab", 2021)], {("a", "b"): (2, 2018, 2021)}),
    ([("abc", 2001)], {("a", "b"): (1, 2001, 2001), ("a", "c"): (1, 2001, 2001), ("b", "c"): (1, 2001, 2001)}),
    ([("aab", 2001)], {("a", "b"): (1, 2001, 2001)}),
    ([("ab", 0)], {("a", "b"): (1, None, None)}),
    ([("ba", None)], {("a", "b"): (1, None, None)}),
    ([(["a", "", None, "b"], 1999)], {("a", "b"): (1, 1999, 1999)}),
])
def test_edges(spark, rows, want):
    assert edges(graph.derive_edges(works(spark, *rows))) == want


def graph_of(spark, nodes, pairs):
    return (spark.createDataFrame([(n,) for n in nodes], "node string"),
            spark.createDataFrame([(a, b, 1, 2000, 2001) for a, b in pairs], "src string, dst string, weight int, first_year int, last_year int"))


def test_components_and_labels(spark):
    nodes, e = graph_of(spark, "abcdef", ["ab", "bc", "de"])
    got = {r["node"]: (r["component"], r["label"], r["size"]) for r in graph.components(nodes, e).collect()}
    assert got == {"a": ("a", 0, 3), "b": ("a", 0, 3), "c": ("a", 0, 3), "d": ("d", 1, 2), "e": ("d", 1, 2), "f": ("f", 2, 1)}


def test_long_chain_and_hub(spark):
    pairs = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.connected(e).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1400)}
    assert graph.connected(e.limit(0)).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    """Rounds of joins over next to nothing are thousands of tasks for the driver."""
    e = spark.createDataFrame([(k, k + 1) for k in range(300)], "src long, dst long")
    spark.sparkContext.setJobGroup("few", "few")
    try:
        assert {r["component"] for r in graph.connected(e).collect()} == {0}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_of_more_edges_than_a_task_takes(spark, kind, monkeypatch):
    """Forests of parts of the edges, then rounds: a chain, a hub, loops, repeats and both directions."""
    monkeypatch.setattr(graph, "EDGES", 60)
    pairs = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1150)] + [(7, 7), (3, 2), (1, 0), (0, 1), (2000, 2001)]
    e = spark.createDataFrame(pairs, "src long, dst long").select(*[F.lpad(c, 5, "0").alias(c) if kind == "string" else F.col(c) for c in ("src", "dst")]).repartition(5)
    assert not graph.contracted(e.toDF("a", "b"), len(pairs))[1]
    got = {int(r["node"]): int(r["component"]) for r in graph.connected(e).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1150)} | {2000: 2000, 2001: 2000}


def test_numbering_is_a_total_order(spark):
    rows = spark.createDataFrame([(k * 7 % 101, k % 5) for k in range(101)], "k long, g long").repartition(6)
    got = {r["k"]: r["n"] for r in graph.number_rows(rows, F.col("g").desc(), "k").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [r["k"] for r in rows.orderBy(F.col("g").desc(), "k").collect()]
    assert sorted(got.values()) == list(range(101))


def test_pruning(spark):
    nodes, e = graph_of(spark, "abcdeyz", ["ab", "bc", "cd", "de", "yz"])
    kept, inside = graph.prune_small(nodes, e, 5)
    assert {r["node"] for r in kept.collect()} == set("abcde") and inside.count() == 4
    kept, inside = graph.prune_small(*graph_of(spark, "abcd", ["ab", "cd"]), 5)
    assert kept.count() == 0 and inside.count() == 0
    kept, inside = graph.prune_small(nodes, e, 1)
    assert kept.count() == 7 and inside.count() == 5


def test_layouts_are_bounded_and_stable(spark):
    nodes = spark.createDataFrame([(f"n{k}", f"g{k % 3}", k) for k in range(30)], "node string, grp string, degree int")
    a = graph.ring_layout(nodes).collect()
    assert checks.layout_violations(graph.ring_layout(nodes)).count() == 0
    assert sorted(map(tuple, a)) == sorted(map(tuple, graph.ring_layout(nodes.repartition(5)).collect()))
    assert max(max(abs(r["x"]), abs(r["y"])) for r in a) == 1.0


def test_graph_contract(spark):
    nodes, _ = graph_of(spark, "ab", [])
    e = spark.createDataFrame([("a", "a", 1), ("a", "b", 1), ("b", "a", 1), ("a", "z", 0)], "src string, dst string, weight int")
    rules = sorted(r["rule"] for r in checks.graph_violations(e, nodes).collect())
    assert rules == ["duplicate", "self_loop", "unknown_dst", "weight"]
    assert "duplicate" not in {r["rule"] for r in checks.graph_violations(e, nodes, ordered_only=True).collect()}
    with pytest.raises(checks.ContractError):
        checks.enforce(checks.dangling_edges(e, nodes), "edges")
    points = spark.createDataFrame([("a", 0.5, 1.0), ("b", 5.0, 0.0), ("c", float("nan"), 0.0)], "node string, x double, y double")
    assert {r["node"] for r in checks.layout_violations(points).collect()} == {"b", "c"}


def test_network_of_faculty_and_trainees(spark):
    """Works meet by their first known key, trainees that are faculty collapse, edges run over all people."""
    fac_works = spark.createDataFrame([("w1", ["pmid:1"], ["f1", "f2"], 1), ("w2", ["pmid:2"], ["f1"], 2), ("w3", ["pmid:3"], ["f2", "f3"], 3), ("w4", ["pmid:4"], ["f3"], 4)],
                                      "work_id string, keys array<string>, people array<string>, ordinal int")
    tr_works = spark.createDataFrame([("x1", ["pmid:1"], ["t-a"]), ("x2", ["pmid:2"], ["t-a", "f3"]), ("x4", ["pmid:4"], ["t-b"]), ("x9", ["pmid:9"], ["t-a"]), ("x8", ["pmid:8"], ["t-b", "t-c"])],
                                     "probe string, keys array<string>, people array<string>")
    match = entity.first_key_match(tr_works, fac_works, "probe", "work_id")
    rows = fac_works.select("work_id", F.explode("people").alias("p")).unionByName(
        tr_works.join(match, "probe").select(F.coalesce("match", "probe").alias("work_id"), F.explode("people").alias("p")))
    members = rows.groupBy("work_id").agg(F.collect_set("p").alias("person_ids")).withColumn("year", F.lit(2020))
    got = {k: v[0] for k, v in edges(graph.derive_edges(members)).items()}
    assert got == {("f1", "f2"): 1, ("f1", "t-a"): 2, ("f2", "t-a"): 1, ("f3", "t-b"): 1, ("f3", "t-a"): 1, ("f1", "f3"): 1, ("f2", "f3"): 1, ("t-b", "t-c"): 1}
    trainees = spark.createDataFrame([("t-a", None, "res"), ("t-b", None, "res"), ("t-f3", "f3", "res")], "id string, faculty_id string, group_id string")
    faculty = spark.createDataFrame([("f3", ["card", "epi"]), ("f1", ["epi"])], "id string, division_ids array<string>")
    people = {r["node"]: (r["kind"], r["groups"]) for r in entity.collapse_people(trainees, faculty).collect()}
    assert people == {"f3": ("both", ["card", "epi", "res"]), "f1": ("faculty", ["epi"]), "t-a": ("trainee", ["res"]), "t-b": ("trainee", ["res"])}


def test_views(spark):
    e = spark.createDataFrame([("a", "b", 3, 2000, 2010), ("a", "c", 1, None, None), ("b", "c", 5, 1999, 2003)], "src string, dst string, weight int, first_year int, last_year int")
    assert {(r["src"], r["dst"]) for r in graph.filter_edges(e, 2, 2005).collect()} == {("a", "b")}
    assert graph.filter_edges(e, 1, 0).count() == 3
    assert {r["other"]: r["weight"] for r in views.ego(e, "c").collect()} == {"a": 1, "b": 5}
    assert [r["weight"] for r in views.top_edges(e, 2).collect()] == [5, 3]
    assert {r["node"]: (r["collaborators"], r["shared_works"]) for r in graph.degrees(e).collect()} == {"a": (2, 4), "b": (2, 8), "c": (2, 6)}
    took = spark.createDataFrame([(["aaaa", "bb", "cccc", "d"],)], "t array<string>").select(views.budgeted_take(F.col("t"), 7).alias("skip"), views.budgeted_take(F.col("t"), 7, True).alias("stop")).first()
    assert took["skip"] == ["aaaa", "bb", "d"] and took["stop"] == ["aaaa", "bb"]
    cited = spark.createDataFrame([("see [b] and [a], [b]", ["[a]", "[b]", "[c]"])], "a string, m array<string>").select(views.citation_numbers(F.col("a"), F.col("m")).alias("c")).first()["c"]
    assert [(x["marker"], x["number"]) for x in cited] == [("[b]", 1), ("[a]", 2)]


def test_shuffles_of_edges_grow_with_the_lines(spark, sf, monkeypatch):
    """Works, pairs and the bridge are dealt to as many tasks as their rows need, whatever the session's number; the rows stay the same."""
    before = sorted(map(tuple, adapters.edges(spark, sf).collect())), sorted(map(tuple, adapters.bridge(spark, sf).collect()))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert tasks_for(lines) is None and tasks_for(lines, lines.count() // 22) in (22, 23) and tasks_for(lines.limit(0), 1) is None
    monkeypatch.setattr(adapters, "tasks_for", lambda rows: 23)
    edges_now, bridge_now = adapters.edges(spark, sf), adapters.bridge(spark, sf)
    assert edges_now.rdd.getNumPartitions() == bridge_now.rdd.getNumPartitions() == adapters.works(spark, sf).rdd.getNumPartitions() == 23
    assert (sorted(map(tuple, edges_now.collect())), sorted(map(tuple, bridge_now.collect()))) == before


def test_newest_of_a_person_in_parts(spark):
    """A person's works are cut down in parts before they meet; repeated rows and years that are null change nothing."""
    rows = [(w, p, None if w % 7 == 0 else 1990 + w % 11) for w in range(400) for p in ((0, 1) if w % 3 else (0,))]
    bridge = spark.createDataFrame(rows + rows[:50], "work_id long, person_id long, year int")
    want = {w for p in (0, 1) for w in sorted((r for r in rows if r[1] == p), key=lambda r: (-(r[2] or 0), r[0]))[:5] for w in w[:1]}
    for tasks in (None, 6):
        assert sorted(r["work_id"] for r in views.newest_per_person(bridge, 5, tasks).collect()) == sorted(want)


def test_edges_are_read_once_for_degrees_and_for_the_rules_of_an_edge(spark):
    """Degrees and the row rules take one pass over the edges; joins to nodes hash these and don't sort the edges."""
    nodes, e = graph_of(spark, "abc", ["ab", "bc", "az"])

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    seen = checks.graph_violations(e.withColumn("weight", F.col("weight") - 1), nodes.union(nodes), tasks=5)
    assert sorted((r["rule"], r["dst"]) for r in seen.collect()) == [("unknown_dst", "z"), ("weight", "b"), ("weight", "c"), ("weight", "z")]
    none = spark.createDataFrame([(None, "a", 1)], "src string, dst string, weight int")
    assert [tuple(r) for r in checks.graph_violations(none, nodes).collect()] == [("unknown_src", None, "a")]
    assert plan(graph.degrees(e)).count("Scan ExistingRDD") == 1
    assert sorted(map(tuple, graph.degrees(e).collect())) == [("a", 2, 2), ("b", 2, 2), ("c", 1, 1), ("z", 1, 1)]
    assert "SortMergeJoin" not in plan(seen)
