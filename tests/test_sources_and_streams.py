"""Readers, writers, page scans and the streaming forms."""

import json
import zipfile

import pytest

from tessera import schemas
from tessera.operators.checks import ContractError
from tessera.sources import documents, html, sinks
from tessera.streaming import limits


def test_snapshots(spark, tmp_path):
    assert documents.read_snapshot(spark, str(tmp_path / "none.json"), schemas.META) is None
    (tmp_path / "bad.json").write_text("{nope")
    assert documents.read_snapshot(spark, str(tmp_path / "bad.json"), schemas.META) is None
    with pytest.raises(ContractError):
        documents.read_strict(spark, str(tmp_path / "bad.json"), schemas.META)
    (tmp_path / "d.json").write_text(json.dumps({"document_type": "directory", "schema_version": 1, "generated_at": "t", "divisions": [{"id": "a", "name": "A"}]}))
    doc = documents.read_strict(spark, str(tmp_path / "d.json"), f"{schemas.META}, divisions array<struct<id:string,name:string>>")
    documents.check_version(doc, "directory")
    assert [tuple(r) for r in documents.child_rows(doc, "divisions").collect()] == [("a", "A")]
    with pytest.raises(ContractError):
        documents.check_version(doc, "publications")


def test_toml(spark, tmp_path):
    (tmp_path / "m.toml").write_text('title = "x"\n[[divisions]]\nid = "a"\nname = "A"\n[[divisions]]\nid = "b"\n')
    assert [tuple(r) for r in documents.toml_rows(spark, tmp_path / "m.toml", "divisions", "id string, name string").collect()] == [("a", "A"), ("b", None)]
    with pytest.raises(ContractError):
        documents.read_toml(tmp_path / "m.toml", {"divisions"})
    (tmp_path / "o.toml").write_text('[people.U1]\nbio = ""\n')
    r = documents.toml_overrides(spark, tmp_path / "o.toml", "people", ["bio", "title"]).first()
    assert (r["id"], r["bio"], r["has_bio"], r["has_title"]) == ("u1", "", True, False)
    (tmp_path / "b.toml").write_text('id = "b"\n')
    (tmp_path / "a.toml").write_text('id = "a"\nenabled = false\n')
    assert [r["id"] for r in documents.toml_profiles(spark, str(tmp_path / "[ab].toml"), "id string, name string").collect()] == ["b"]
    sinks.write_roster_toml([{"last": "Roe", "first": "R", "program": "P"}, {"last": "Doe", "first": 'J "J"', "program": "P"}], str(tmp_path / "r.toml"))
    assert [r["last"] for r in documents.read_toml(tmp_path / "r.toml")["trainees"]] == ["Doe", "Roe"]


def test_xlsx_roster(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [["Last", "First", "Degree", "Program", "Mail"], ["Van Hook", "Reed", "MD", "IM", "sam.vanhook@x.test"], ["", "No", "", "", ""], ["Poe", "Al", "MD", "IM", "a.poe@x.test"]]
    body = "".join(f'<row r="{k}">' + "".join(cell(f"{'ABCDE'[j]}{k}", v) for j, v in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1))
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    got = documents.trainee_roster(documents.read_xlsx(spark, tmp_path / "r.xlsx")).collect()
    assert [(r["last"], r["aliases"]) for r in got] == [("Van Hook", ["Sam"]), ("Poe", [])]
    assert "@" not in str(got)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"], None), ("a", [], 3)], "id string, groups array<string>, n int")
    sinks.publish(df, str(tmp_path / "c"), str(tmp_path / "m"))
    sinks.publish(df, str(tmp_path / "c"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == spark.read.parquet(str(tmp_path / "m")).count() == 2
    sinks.write_csv(sinks.csv_rows(df.orderBy("id").coalesce(1), ["groups"]), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text == "id,groups,n\na,,3\nb,x;y,\n"


def test_staged_commit(spark, tmp_path):
    root = str(tmp_path / "root")
    good = spark.createDataFrame([("a",)], "id string")
    sinks.staged_commit(root, {"t": good}, {"none is blank": lambda w: w["t"].where("id = ''")})
    assert sinks.current(spark, root, "t").first()["id"] == "a"
    with pytest.raises(ContractError):
        sinks.staged_commit(root, {"t": spark.createDataFrame([("",)], "id string")}, {"none is blank": lambda w: w["t"].where("id = ''")})
    assert sinks.current(spark, root, "t").first()["id"] == "a"


def test_collectors(spark):
    def fake(source):
        if source["source_id"] == "bad":
            raise ValueError("down")
        return [{"title": "x"}]
    got = documents.collect(spark.createDataFrame([("good",), ("bad",)], "source_id string"), fake, 2).collect()
    assert sorted((r["source_id"], r["status"], r["item"]) for r in got) == [("bad", "error", None), ("good", "item", '{"title": "x"}'), ("good", "ok", None)] or len(got) == 3
    registry = documents.AdapterRegistry()
    registry.register("a", lambda page: [])
    with pytest.raises(ContractError):
        registry.check({"a", "b"})
    assert [r["id"] for r in documents.requested_ids(spark, "U0012345, u0076543 u0012345").collect()] == ["u0012345", "u0076543"]
    for bad in ("", "faculty-1"):
        with pytest.raises(ContractError):
            documents.requested_ids(spark, bad)


PAGE = """<html><head><meta name="description" content="fallback"><script>x</script></head><body><h1>Ann <b>Lee</b></h1><div id="tab"><div class="card"><h3>Ann</h3><a href="/p/1">p</a><p>Prof</p><p>no</p></div>
<div class="card"><p>no heading</p></div></div><section><h2>Academic information</h2><p>Dean &amp; more</p></section><a href="https://orcid.org/0000-0002-1825-0097">o</a></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([("u1", PAGE), ("u1", PAGE), ("u2", None)], "url string, html string")
    got = {r["url"]: r for r in html.scan_profiles(pages).collect()}
    assert tuple(got["u1"])[1:] == ("Ann Lee", "fallback", "Dean & more", "https://orcid.org/0000-0002-1825-0097") and tuple(got["u2"])[1:] == ("", "", "", "")
    cards = html.scan_cards(pages.dropDuplicates(["url"]), "tab", "card").collect()
    assert sorted((r["url"], r["heading"], r["paragraph"], r["problem"]) for r in cards) == [("u1", "Ann", "Prof", None), ("u2", None, None, "no cards")]


def test_stream_counts_equal_the_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = limits.stream_tumbling_counts(stream, "event_type", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["event_type"], str(r["bucket"])): r["n"] for r in spark.table("counts").collect()}
    assert got == {(r["event_type"], str(r["bucket"])): r["n"] for r in limits.tumbling_counts(batch, "event_type", "hour").collect()}


def test_stream_limits(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = limits.stream_limits(stream, "user_id", 5, 1).writeStream.format("memory").queryName("limited").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r["event"]: r["decision"] for r in spark.table("limited").collect()}
    want = {r["event_id"]: "ip_day" if r["denied"] else "admit" for r in limits.over_limit(batch, "user_id", 1, "day").collect()}
    assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
