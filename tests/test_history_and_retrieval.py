"""Merging batches, overlays, retrieval and limits."""

from pyspark.sql import functions as F

from tests.embedding import pairs
from tessera.operators import checks, entity, history, retrieval
from tessera.streaming import limits

ITEM = "id string, organization_id string, title string, published_at timestamp, first_seen_at timestamp, last_seen_at timestamp"


def at(day):
    import datetime
    return datetime.datetime.fromisoformat(day)


def test_merge_history(spark):
    before = spark.createDataFrame([("a", "o1", "old", at("2024-01-10"), at("2024-01-10"), at("2024-01-10")), ("b", "gone", "x", at("2024-01-10"), at("2024-01-10"), at("2024-01-10")),
                                    ("c", "o1", "edge", at("2024-01-05"), at("2024-01-05"), at("2024-01-05")), ("d", "o1", "late", at("2024-01-04"), at("2024-01-04"), at("2024-01-04"))], ITEM)
    fresh = spark.createDataFrame([("a", "o1", "new", at("2024-01-12")), ("e", "o1", "more", at("2024-01-14"))], "id string, organization_id string, title string, published_at timestamp")
    owners = spark.createDataFrame([("o1",)], "organization_id string")
    now = F.lit("2024-01-15").cast("timestamp")
    got = {r["id"]: r for r in history.merge_history(before, fresh, now, keep_days=10, owners=owners).collect()}
    assert set(got) == {"a", "c", "e"}  # the cutoff counts, one day before it doesn't
    assert got["a"]["title"] == "new" and got["a"]["first_seen_at"] == at("2024-01-10") and got["a"]["last_seen_at"] == at("2024-01-15")
    assert got["c"]["last_seen_at"] == at("2024-01-05") and got["e"]["first_seen_at"] == at("2024-01-15")
    capped = history.merge_history(before, fresh, now, per_owner=1)
    assert {r["id"] for r in capped.collect()} == {"e", "b"}
    none = spark.createDataFrame([], "id string, organization_id string, title string, published_at timestamp")
    assert history.merge_history(before, none, now).count() == 4


def test_merge_works(spark):
    schema = "id string, keys array<string>, year int, first_seen_at string, last_seen_at string, abstract string"
    before = spark.createDataFrame([("w1", ["doi:1", "pmid:1"], 2020, "t0", "t0", "long"), ("w2", ["pmid:2"], 1990, "t0", "t0", "")], schema)
    fresh = spark.createDataFrame([("n1", ["pmid:1"], 2021, "", "", ""), ("n3", ["pmid:3"], 2022, "", "", "new")], schema)
    now = F.lit("2024-06-01")
    got = {r["id"]: (r["year"], r["first_seen_at"], r["last_seen_at"], r["abstract"]) for r in history.merge_works(before, fresh, now, ["abstract"], 15).collect()}
    assert got == {"w1": (2021, "t0", "2024-06-01", "long"), "n3": (2022, "2024-06-01", "2024-06-01", "new")}


def test_split_and_join_details(spark):
    works = spark.createDataFrame([("a", "t", "abs", [("X", None)]), ("b", "u", "", []), ("c", "v", None, [("Y", "0")])], "id string, title string, abstract string, authors array<struct<name:string,orcid:string>>")
    index, details = history.split_index(works, ["abstract", "authors"])
    assert {r["id"]: r["has_abstract"] for r in index.collect()} == {"a": True, "b": False, "c": False} and {r["id"] for r in details.collect()} == {"a", "c"}
    back = {r["id"]: (r["abstract"], len(r["authors"])) for r in history.join_details(index, details).collect()}
    assert back == {"a": ("abs", 1), "b": ("", 0), "c": ("", 1)}


def test_overlay_and_carry(spark):
    base = spark.createDataFrame([("u1", "Ann", "bio"), ("u2", "Bob", "")], "id string, name string, bio string")
    ov = spark.createDataFrame([("u1", None, "", False, True)], "id string, name string, bio string, has_name boolean, has_bio boolean")
    assert {tuple(r) for r in entity.overlay(base, ov, "id", ["name", "bio"]).collect()} == {("u1", "Ann", ""), ("u2", "Bob", "")}
    old = spark.createDataFrame([("u2", "x", "old bio")], "id string, name string, bio string")
    assert {tuple(r) for r in entity.carry_forward(base, old, "id", ["bio"]).collect()} == {("u1", "Ann", "bio"), ("u2", "Bob", "old bio")}
    assert {tuple(r) for r in entity.replace_by_key(base, old, "id").collect()} == {("u1", "Ann", "bio"), ("u2", "x", "old bio")}
    assert entity.unknown_overrides(ov.union(ov.selectExpr("'zz'", "name", "bio", "has_name", "has_bio")), base, "id").first()["id"] == "zz"


def test_merge_records(spark):
    rows = spark.createDataFrame([("k", 1, "T", "", "2025-01-01", ["a"], ["pubmed"]), ("k", 2, "T2", "abs", "2025-09-06", ["a", "b"], ["crossref", "pubmed"])],
                                 "key string, ordinal int, title string, abstract string, published_at string, authors array<string>, sources array<string>")
    r = entity.merge_records(rows, "key", "ordinal").first()
    assert (r["title"], r["abstract"], r["published_at"], r["authors"], r["sources"]) == ("T", "abs", "2025-09-06", ["a", "b"], ["pubmed", "crossref"])


def test_names(spark):
    people = spark.createDataFrame([("u1", "Rex T. Roe, MD"), ("u2", "Ann Lee"), ("u3", "Ann B. Lee")], "person_id string, name string")
    probe = spark.createDataFrame([("t1", "Rex Roe Md"), ("t2", "Ann Lee"), ("t3", "Zed")], "probe string, name string")
    assert {r["probe"]: r["match"] for r in entity.unique_name_match(probe, people, "probe", "person_id").collect()} == {"t1": "u1", "t2": None, "t3": None}


def test_bm25_common_terms_say_nothing(spark):
    docs = spark.createDataFrame([(f"d{k:02}", "outbreak " + ("ergm models" if k == 3 else "filler")) for k in range(24)], "id string, body string")
    assert retrieval.bm25(docs, ["outbreak"]).count() == 0
    assert retrieval.bm25(docs, ["ergm", "outbreak", "model"]).first()["id"] == "d03"
    assert retrieval.bm25(docs, []).count() == 0


def test_fusion_and_roll_up(spark):
    a = spark.createDataFrame([("1", 3.0), ("2", 2.0), ("3", 1.0)], "id string, score double")
    b = spark.createDataFrame([("3", 3.0), ("1", 2.0), ("9", 1.0)], "id string, score double")
    fused = {r["id"]: r["score"] for r in retrieval.fuse([a, b]).collect()}
    assert fused["1"] > fused["2"] and fused["3"] > fused["9"]
    assert retrieval.fuse([a]).first()["id"] == "1"
    rows = [(f"b{k}", "broad", 0.010) for k in range(30)] + [(f"f{k}", "focused", 0.030) for k in range(3)]
    rolled = retrieval.roll_up(spark.createDataFrame(rows, "id string, owner string, score double"), "owner")
    got = {r["owner"]: r for r in rolled.collect()}
    assert got["focused"]["score"] > got["broad"]["score"] and len(got["broad"]["evidence"]) == 3
    assert retrieval.best_owners(rolled, "owner", 1).first()["evidence"] == ["f0", "f1"]


def test_index_reuse(spark):
    chunks = retrieval.make_chunks({"work": spark.createDataFrame([("a", "t", "one two", ["p"], ["g"]), ("b", "t", "three", ["p"], ["g"])], "key string, title string, body string, owner_ids array<string>, group_ids array<string>")})
    first = retrieval.build_index(chunks, spark.createDataFrame([], "id string, hash string, vector array<double>"), pairs(16), 16).cache()
    changed = retrieval.make_chunks({"work": spark.createDataFrame([("a", "t", "one two", ["p"], ["g"]), ("b", "t", "four", ["p"], ["g"])], "key string, title string, body string, owner_ids array<string>, group_ids array<string>")})
    previous = first.select("id", "hash", "vector")
    assert tuple(retrieval.dry_run(changed, previous).first()) == (1, 1, 0)
    again = {r["id"]: r for r in retrieval.build_index(changed, previous, pairs(16), 16).collect()}
    assert again["w:a"]["reused"] and not again["w:b"]["reused"]
    assert again["w:a"]["vector"] == first.where("id = 'w:a'").first()["vector"]


def test_guard_and_diff(spark):
    before = spark.createDataFrame([("a",)] * 4 + [("b",)] * 4, "g string")
    now = spark.createDataFrame([("a",)] * 2 + [("b",)] * 4, "g string")
    assert {r["grp"] for r in checks.drop_guard(before, now, "g").collect()} == {"a"}
    assert checks.snapshot_diff(before, before).count() == 0 and checks.snapshot_diff(before, now).count() == 2
    health = spark.createDataFrame([("d1", "ok"), ("d1", "ok"), ("d3", "error")], "division_id string, status string")
    divisions = spark.createDataFrame([("d1",), ("d2",)], "division_id string")
    assert {r["division_id"] for r in checks.health_covers(health, divisions).collect()} == {"d1", "d2", "d3"}


def test_costs(spark):
    df = spark.createDataFrame([(1_000_000, 1_000_000), (0, 2_000_000)], "i long, o long")
    assert [r["c"] for r in df.select(limits.micro_cost("i", "o", 100_000, 400_000).alias("c")).collect()] == [500_000, 800_000]


def test_sentinel(spark):
    df = spark.createDataFrame([(["NO_", "ANS", "WER", " x"],), (["NO", "pe"],), (["hello"],)], "f array<string>")
    assert [(r["r"], r["h"]) for r in df.select(limits.refused(F.col("f"), "NO_ANSWER").alias("r"), limits.held_prefix(F.col("f"), "NO_ANSWER").alias("h")).collect()] == [(True, 3), (False, 1), (False, 0)]
