"""Composed retrieval documents and the stored lexical index."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks, retrieval


@pytest.fixture(scope="module")
def parts(spark):
    works = spark.createDataFrame([(k, f"Phage genomes number {k}", "Annals", 2000 + k, ["phage", "soil"], "Long <b>abstract</b> " * 60, [f"A{j}" for j in range(9)], ["p1"], ["g1"]) for k in range(12)] +
                                  [(99, "Only a title", "", None, [], None, [], ["p1", "p2"], [])],
                                  "id long, title string, venue string, year int, keywords array<string>, abstract string, authors array<string>, person_ids array<string>, group_ids array<string>")
    people = spark.createDataFrame([("p1", "Ida Low", "Lead", "Soil Centre", "Digs. Note: this bio was AI-generated", ["mud"], ["g1"]), ("p2", "Al Poe", "", "", "", [], ["g2"]), ("p3", "No Works", None, None, None, None, None)],
                                   "id string, full_name string, role string, center string, bio string, expertise array<string>, group_ids array<string>")
    tools = spark.createDataFrame([("t1", "Sieve", "lab", "live", "Soil Centre", "Sorts <script>x</script> grains", ["grain"], ["p1"], ["g1"])],
                                  "id string, name string, category string, status string, center string, summary string, keywords array<string>, person_ids array<string>, group_ids array<string>")
    orgs = spark.createDataFrame([("g1", "Soil Centre", "SC", "About soil", ["mud", "sand"], ["earth"])], "id string, name string, acronym string, summary string, focus_areas array<string>, keywords array<string>")
    return orgs, people, tools, works


def test_four_kinds(parts):
    made = chunks.build_chunks(*parts)
    rows = made.collect()
    got = {r["id"]: r for r in rows}
    assert [r["id"] for r in rows] == sorted(got) and {k[0] for k in got} == set("ortw") and len(got) == 13 + 3 + 1 + 1
    assert all(r["hash"] == hashlib.sha256(r["body"].encode()).hexdigest()[:16] and len(r["body"]) <= 8000 and "<" not in r["body"] for r in rows)
    work = got["w:3"]["body"].split("\n")
    assert work[:3] == ["Phage genomes number 3", "Annals, 2003", "Keywords: phage, soil"] and len(work[3]) == 480 and work[4] == "Authors: A0, A1, A2, A3, A4, A5"
    assert got["w:99"]["body"] == "Only a title"
    person = got["r:p1"]["body"]
    assert person.startswith("Ida Low\nLead, Soil Centre\nDigs.\nExpertise: mud\nTopics: ") and "AI-generated" not in person
    recent = person.split("Recent work: ")[1].split("; ")
    assert recent == [f"Phage genomes number {k}" for k in range(11, 3, -1)]
    assert "phage" in person.split("Topics: ")[1].split("\n")[0].split(", ")
    assert got["r:p3"]["body"] == "No Works" and "Recent work: Only a title" in got["r:p2"]["body"] and got["r:p2"]["owner_ids"] == ["p2"]
    assert got["t:t1"]["body"] == "Sieve\nlab, live\nSoil Centre\nSorts x grains\nKeywords: grain"
    assert got["o:g1"]["body"] == "Soil Centre (SC)\nAbout soil\nFocus: mud, sand\nKeywords: earth"


def test_stored_index_gives_the_same_scores(spark, parts):
    made = chunks.build_chunks(*parts)
    index = retrieval.lexical_index(made)
    for terms in (["phage", "sieve"], ["mud"], ["nothing"], []):
        a = [tuple(r) for r in retrieval.bm25(made, terms).select("id", F.round("score", 9)).collect()]
        assert a == [tuple(r) for r in retrieval.bm25(None, terms, index=index).select("id", F.round("score", 9)).collect()]
    assert retrieval.search(made, ["sieve"], index=index)["tools"].first()["id"] == "t:t1"
