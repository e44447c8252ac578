"""The incremental source, the transactional table and gates that are counted while rows are written."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks
from tessera.operators.checks import ContractError
from tessera.sources import batches, incremental, sinks


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    """The sources' folder; workers read its name from a file's place, so it is the same for the whole session."""
    at = Path(os.environ["TESSERA_TEST_SOURCES"])
    for p in at.iterdir():
        p.unlink()
    spark.dataSource.register(incremental.CollectedSource)
    spark.dataSource.register(batches.BatchesSink)
    return at


def put(folder, source, n):
    (folder / f"{source}.json").write_text(json.dumps([{"n": k} for k in range(n)]))


def run(spark, tmp_path, **options):
    """One run to the end of what there is; its rows are what the transactional table gained."""
    before = batches.read_batches(spark, f"{tmp_path}/out", incremental.SCHEMA).collect()
    stream = spark.readStream.format("collected").option("collector", "tests.collectors:files").option("state", f"{tmp_path}/state").option("retries", 1).option("backoff", 0.01).option("health_seconds", 1).options(**options).load()
    q = stream.writeStream.format("batches").option("path", f"{tmp_path}/out").option("query", "collect").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    rows = batches.read_batches(spark, f"{tmp_path}/out", incremental.SCHEMA).collect()
    for r in before:
        rows.remove(r)
    return sorted((r["source_id"], r["status"], r["position"]) for r in rows)


def test_restarts_read_nothing_twice_and_failures_are_rows(spark, folder, tmp_path):
    put(folder, "a-1", 5)
    put(folder, "a-2", 0)
    put(folder, "b-1", 3)
    (folder / "b-1.torn").touch()
    first = run(spark, tmp_path, chunk=2)
    assert first == [*[("a-1", "item", k) for k in range(5)], *[("a-1", "ok", k) for k in (0, 2, 4)], ("b-1", "error", 0), ("b-1", "error", 2)]
    put(folder, "a-1", 7)
    put(folder, "c-1", 1)
    (folder / "c-1.down").touch()
    second = run(spark, tmp_path, chunk=2)  # b-1 fails again, c-1 doesn't answer
    assert second == [("a-1", "item", 5), ("a-1", "item", 6), ("a-1", "ok", 5), ("b-1", "error", 0), ("b-1", "error", 2), ("c-1", "error", 0)]
    for p in ("b-1.torn", "c-1.down"):
        (folder / p).unlink()
    (folder / "a-1.down").touch()  # its position stays
    third = run(spark, tmp_path, chunk=2)
    assert third == [("a-1", "error", 7), *[("b-1", "item", k) for k in range(3)], ("b-1", "ok", 0), ("b-1", "ok", 2), ("c-1", "item", 0), ("c-1", "ok", 0)]
    (folder / "a-1.down").unlink()
    put(folder, "a-1", 8)
    (folder / "a-1.shut").touch()
    assert run(spark, tmp_path) == [("a-1", "blocked", 7)]
    (folder / "a-1.shut").unlink()
    assert run(spark, tmp_path) == [("a-1", "item", 7), ("a-1", "ok", 7)]
    assert run(spark, tmp_path) == []


def test_a_batch_that_is_replayed(spark, folder, tmp_path):
    """The last batch's commit is lost on both sides: it runs again, with ranges that fail now or failed before."""
    put(folder, "a-1", 4)
    put(folder, "b-1", 2)
    (folder / "b-1.torn").touch()
    run(spark, tmp_path)

    def lose():
        last = max((p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        for p in (last, last.with_name(f".{last.name}.crc"), *(tmp_path / "out" / "_log").glob(f"collect-{int(last.name):012d}.json")):
            p.unlink(missing_ok=True)
    lose()
    (folder / "b-1.torn").unlink()  # what failed is read by the replay, and by it alone
    (folder / "a-1.torn").touch()   # what was read fails in the replay, and comes later
    run(spark, tmp_path)
    (folder / "a-1.torn").unlink()
    run(spark, tmp_path)
    got = batches.read_batches(spark, f"{tmp_path}/out", incremental.SCHEMA).where("status = 'item'").groupBy("source_id", "position", "item").count().collect()
    assert sorted((r["source_id"], r["position"], json.loads(r["item"])["n"], r["count"]) for r in got) == [*[("a-1", k, k, 1) for k in range(4)], *[("b-1", k, k, 1) for k in range(2)]]


def test_a_host_is_asked_at_its_pace(spark, folder, tmp_path):
    for s in ("a-1", "a-2", "b-1"):
        put(folder, s, 2)
    run(spark, tmp_path, pace=0.2, chunk=1)
    calls = [json.loads(x) for x in (folder / "calls.log").read_text().splitlines()]
    times = sorted(t for t, source, *_ in calls if source.startswith("a-"))
    assert len(times) == 4 and min(b - a for a, b in zip(times, times[1:])) >= 0.19


def test_a_task_that_dies_leaves_the_table_as_it_was(spark, folder, tmp_path):
    root = str(tmp_path / "t")
    write = lambda df, batch, mode="append": df.write.format("batches").option("path", root).option("batch", batch).mode(mode).save()
    rows = lambda: sorted(r["id"] for r in batches.read_batches(spark, root, "id long").collect())
    assert rows() == []
    write(spark.range(0, 10, 1, 3), "one")
    write(spark.range(100, 110), "one")  # the name is committed: a replay
    assert rows() == list(range(10))
    with pytest.raises(Exception, match="three"):
        write(spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("three"))).otherwise(F.col("id")).cast("long").alias("id")), "two")
    assert rows() == list(range(10)) and list(batches.manifests(root)) == ["one"]
    write(spark.range(20, 22), "two/x")
    write(spark.range(0), "none")
    assert rows() == [*range(10), 20, 21]
    write(spark.range(7, 9), "new", "overwrite")
    assert rows() == [7, 8]
    write(spark.range(9, 10), "later")
    assert rows() == [7, 8, 9]
    assert batches.sweep(root) == 0 and batches.sweep(root, 0) > 0 and rows() == [7, 8, 9]


def test_gates_count_while_rows_are_written(spark, tmp_path):
    works = spark.createDataFrame([("w1", "A", "p1", 1.0), ("w2", " ", "p2", 2.0), ("w3", None, None, 3.0), ("w4", "B", "p9", None)], "id string, title string, person string, `a.b` double")
    people = spark.createDataFrame([("p1",), ("p2",), ("p2",), (None,)], "id string")
    rules = {"title": F.trim("title") != "", "a:b": F.col("`a.b`") > 0}
    refs = {"person": ("person", people, "id")}
    out, seen = checks.gated(works, "id", rules, refs)
    out.write.parquet(str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).exceptAll(works).count() == 0 and out.columns == works.columns
    assert checks.broken_rules(seen) == {"title": (2, "w2"), "a:b": (1, "w4"), "person": (1, "w4")}
    again = checks.failing(works, "id", rules).groupBy("rule").count().collect()
    assert {r["rule"]: r["count"] for r in again} == {"title": 2, "a:b": 1}
    assert [r["key"] for r in checks.missing_refs(works, "person", people, "id").collect()] == ["p9"]
    empty, none = checks.gated(works.limit(0), "id", rules, refs)
    empty.write.parquet(str(tmp_path / "e"))
    assert checks.broken_rules(none) == {}


def test_a_broken_gate_leaves_the_published_batch(spark, tmp_path):
    root = str(tmp_path / "root")
    gates = {"t": ("id", {"id": F.trim("id") != ""})}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("gated", "")
    sinks.staged_commit(root, {"t": spark.createDataFrame([("a",)], "id string")}, {}, gates)
    assert len(tracker.getJobIdsForGroup("gated")) <= 4  # the write, the footers' schema, the pointer
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(ContractError, match="id"):
        sinks.staged_commit(root, {"t": spark.createDataFrame([("",)], "id string")}, {}, gates)
    assert sinks.current(spark, root, "t").first()["id"] == "a"
    assert len([p for p in Path(root).iterdir() if p.name.startswith("batch-")]) == 1


def test_contact_is_needed_where_pubmed_is_asked(spark):
    rows = spark.createDataFrame([("a", "q"), ("b", ""), ("c", None)], "id string, pubmed_query string")
    assert [r["id"] for r in checks.needs_contact(rows, " ").collect()] == ["a"]
    assert checks.needs_contact(rows, "x@y.test").count() == 0
