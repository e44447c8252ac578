"""The composed networks, snapshots, refreshes and the whole retrieval."""

import pytest
from pyspark.sql import functions as F

from tests.embedding import pairs
from tessera.functions.text import person_slug
from tessera.operators import checks, network, retrieval, views
from tessera.plans import refresh


def faculty(spark):
    return spark.createDataFrame([("a", "A", ["cardio"]), ("b", "B", ["cardio"]), ("c", "C", ["epi"]), ("d", "D", ["epi"])], "id string, full_name string, division_ids array<string>")


def test_faculty_network(spark):
    works = spark.createDataFrame([("w1", ["a", "b"], 2019), ("w2", ["a", "c"], 2022), ("w3", ["a"], 2023)], "work_id string, person_ids array<string>, year int")
    counts = spark.createDataFrame([("a", 3), ("b", 1)], "id string, n long")
    net = network.faculty_network(faculty(spark), works, counts, minimum=1, cap=3)
    nodes = {r["node"]: r for r in net.nodes.collect()}
    assert set(nodes) == {"a", "b", "c"} and nodes["a"]["collaborators"] == 2 and nodes["c"]["publications"] == 0
    s = net.stats.first()
    assert (s["edges"], s["shared_works"], s["cross_group_edges"], s["people"], s["capped"], s["components"], s["largest_component"]) == (2, 2, 1, 4, 1, 1, 3)
    ghost = works.union(spark.createDataFrame([("w9", ["a", "ghost"], 2020)], works.schema))
    with pytest.raises(checks.ContractError):
        network.faculty_network(faculty(spark), ghost, counts, minimum=5)
    assert checks.stats_mismatch(net.stats, net.stats.withColumn("edges", F.lit(9).cast("long"))).count() == 1
    placed = network.organic_layout(net.nodes.select("node"), net.edges)
    assert checks.layout_violations(placed).count() == 0 and sorted(map(tuple, placed.collect())) == sorted(map(tuple, network.organic_layout(net.nodes.select("node"), net.edges).collect()))
    with pytest.raises(checks.ContractError):
        network.organic_layout(net.nodes.select("node"), net.edges, most=2)


def test_trainee_network(spark):
    w = "work_id string, keys array<string>, person_ids array<string>, year int"
    fw = spark.createDataFrame([("w1", ["pmid:1"], ["f1", "f2"], 1), ("w2", ["pmid:2"], ["f1"], 2), ("w3", ["pmid:3"], ["f2", "f3"], 3), ("w4", ["pmid:4"], ["f3"], 4)], w)
    tw = spark.createDataFrame([("x1", ["pmid:1"], ["t-a"], 1), ("x2", ["pmid:2"], ["t-a", "t-f3"], 2), ("x4", ["pmid:4"], ["t-b"], 4), ("x9", ["pmid:9"], ["t-a"], 5), ("x8", ["pmid:8"], ["t-b", "t-c"], 5)], w)
    fac = spark.createDataFrame([("f1", ["epi"]), ("f2", ["card"]), ("f3", ["card", "epi"])], "id string, division_ids array<string>")
    tr = spark.createDataFrame([("t-a", None, "res"), ("t-b", None, "res"), ("t-c", None, "res"), ("t-f3", "f3", "res")], "id string, faculty_id string, group_id string")
    net = network.trainee_network(fac, fw, tr, tw)
    e = {(r["src"], r["dst"]): r["weight"] for r in net.edges.collect()}
    assert (e["f1", "f2"], e["f1", "t-a"], e["f2", "t-a"], e["f3", "t-b"], e["f3", "t-a"], e["t-b", "t-c"]) == (1, 2, 1, 1, 1, 1)
    nodes = {r["node"]: r for r in net.nodes.collect()}
    assert nodes["f3"]["kind"] == "both" and nodes["f3"]["groups"] == ["card", "epi", "res"] and nodes["t-a"]["work_ids"] == ["w1", "w2", "x9"]
    assert {r["grp"]: r["n"] for r in net.stats.collect()} == {"card": 2, "epi": 2, "res": 4}
    assert tuple(views.view_summary(net.nodes, net.edges).first())[:4] == (6, 2, 3, 1)


def test_directory_and_refresh(spark, tmp_path):
    cards = spark.createDataFrame([("u1", 1, "Grace Hopper", "Dr", "https://p/1", ["d1"]), ("u1", 2, "Grace B Hopper", "Prof", "https://p/1", ["d2"]), ("u2", 3, "Al Poe", "", "https://p/2", ["d2"])],
                                  "id string, ordinal int, full_name string, title string, profile_url string, division_ids array<string>")
    profiles = spark.createDataFrame([("u1", "", "x", "")], "id string, bio string, academic string, orcid string")
    before = spark.createDataFrame([("u1", "old bio", "", "")], "id string, bio string, academic string, orcid string")
    ov = spark.createDataFrame([("u2", "Chief", True)], "id string, title string, has_title boolean")
    people = refresh.directory_snapshot(cards, profiles, ov, before, ["U"], ["title"]).cache()
    rows = {r["id"]: r for r in people.collect()}
    assert rows["u1"]["division_ids"] == ["d1", "d2"] and rows["u1"]["full_name"] == "Grace B Hopper" and rows["u1"]["bio"] == "old bio"
    assert rows["u2"]["title"] == "Chief" and rows["u1"]["pubmed_query"].startswith('"Hopper GB"')
    divisions = spark.createDataFrame([("d1",), ("d2",)], "id string")
    assert checks.directory_violations(people, divisions).count() == 0
    assert {r["rule"] for r in checks.directory_violations(people.union(people.where("id = 'u1'")), divisions.where("id = 'd1'")).collect()} == {"repeated", "unknown_division"}
    now = people.withColumn("collect_publications", F.lit(True))
    assert {r["id"] for r in refresh.refresh_targets(now, now.withColumn("full_name", F.when(F.col("id") == "u2", "New").otherwise(F.col("full_name")))).collect()} == {"u2"}
    ok = spark.createDataFrame([("u1", "ok"), ("u2", "ok")], "id string, status string")
    path = refresh.refresh(str(tmp_path / "r"), now, now, ok, {}, {"unique": lambda w: checks.repeated(w["people"], "id")})
    assert spark.read.parquet(f"{path}/people").count() == 2
    with pytest.raises(checks.ContractError):
        refresh.refresh_gates(now, now, now.select("id").where("id = 'u1'"), spark.createDataFrame([("u2", "error")], "id string, status string"), "division_ids")
    fresh = people.withColumn("title", F.lit("read again"))
    got = {r["id"]: r["title"] for r in refresh.targeted_refresh(people, spark.createDataFrame([("u1",), ("u2",)], "id string"), fresh, ov, ["title"]).collect()}
    assert got == {"u1": "read again", "u2": "Chief"}
    roster = spark.createDataFrame([("Poe", "Al", "Al Poe"), ("Doe", "Jane Ann", "Jane Ann Doe")], "last string, first string, name string")
    found = {r["id"]: r["faculty_id"] for r in refresh.trainee_directory(roster, people, person_slug("last", "first")).collect()}
    assert found == {"t-poe-al": "u2", "t-doe-jane-ann": None}
    health = refresh.division_health(spark.createDataFrame([("d1", True), ("d1", False), ("d2", True)], "division_id string, complete boolean"), spark.createDataFrame([("d1",), ("d2",), ("d3",)], "division_id string"))
    assert {r["division_id"]: r["status"] for r in health.collect()} == {"d1": "partial", "d2": "ok", "d3": "error"}
    assert refresh.health_log(ok, health).count() == 5


def test_publications_and_projections(spark):
    works = spark.createDataFrame([("w1", "T", ["a"], "preprint", True), ("w1", "", ["zz"], "article", False)], "id string, title string, person_ids array<string>, type string, has_abstract boolean")
    details = spark.createDataFrame([("w7", "x")], "id string, abstract string")
    assert {r["rule"] for r in checks.publication_violations(works, details, faculty(spark)).collect()} == {"title", "repeated", "unknown_person", "details_only"}
    stats = views.work_stats(works, spark.createDataFrame([("ok",), ("error",)], "status string")).first()
    assert tuple(stats) == (2, 1, 1, 2, 1)
    fixed = views.fixed_projection(works, {"title": ("string", "none"), "year": ("int", 0), "tags": ("array<string>", [])}).first()
    assert tuple(fixed) == ("T", 0, [])
    orgs = spark.createDataFrame([("o", [("n", "")]), ("p", None)], "id string, tools array<struct<name:string,url:string>>")
    assert orgs.select(views.fill_nested(F.col("tools"), {"name": "?", "url": "none"}).alias("t")).first()["t"][0]["url"] == "none"
    assert views.nested_totals(orgs, ["tools"]).first()[0] == 1


def test_search(spark):
    rows = [(f"w:{k}", "work", f"paper {k}", "gene editing in yeast" if k < 3 else "weather maps of the sea", ["p1"] if k < 3 else ["p2"], ["g1"] if k < 3 else ["g2"]) for k in range(20)]
    rows += [("t:1", "tool", "yeast tool", "yeast editing pipeline", ["p1"], ["g3"]), ("r:p1", "researcher", "P One", "yeast geneticist", ["p1"], ["g1"])]
    chunks = spark.createDataFrame(rows, "id string, kind string, title string, body string, owner_ids array<string>, group_ids array<string>")
    got = retrieval.search(chunks, ["yeast", "editing"])
    assert got["people"].first()["owner"] == "p1" and got["tools"].first()["id"] == "t:1"
    assert got["groups"].first()["grp"] in ("g1", "g3") and retrieval.answer_reason(got["pool"]).first()["confident"]
    assert tuple(retrieval.answer_reason(got["pool"].limit(0)).first()) == (False, "no_match")
    index = chunks.join(retrieval.embed(chunks, pairs(32), 32), "id")
    query = spark.createDataFrame([(pairs(32)(["yeast editing"], "RETRIEVAL_QUERY")[0],)], "q array<double>")
    assert retrieval.search(index, ["yeast"], query)["people"].first()["owner"] == "p1"
