"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_file
from tessera.plans import adapters, catalog


def rows(frame):
    cols = sorted(frame.columns)
    return sorted([tuple(None if pd.isna(v) else float(v) if isinstance(v, float) else v for v in r) for r in frame[cols].astype(object).itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect(config={"threads": 2})
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert 0 < entry_file.entry(spark).count() <= 25


def test_names_match():
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())


def test_admission_against_a_plain_fold(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").toPandas()
    minute, day, glob, spent, want = {}, {}, {}, 0, {}
    for r in events.itertuples():
        m, d = (r.user_id, r.ts.strftime("%m-%d %H:%M")), r.ts.strftime("%m-%d")
        if spent >= 200_000_000_000:
            want[r.event_id] = "month_budget"
        elif glob.get(d, 0) >= 300:
            want[r.event_id] = "global_day"
        else:
            minute[m] = minute.get(m, 0) + 1
            if minute[m] > 5:
                want[r.event_id] = "ip_minute"
                continue
            day[r.user_id, d] = day.get((r.user_id, d), 0) + 1
            if day[r.user_id, d] > 3:
                want[r.event_id] = "ip_day"
                continue
            glob[d] = glob.get(d, 0) + 1
            spent += round(r.value * 1e6)
            want[r.event_id] = "admit"
    got = {r["event"]: r["decision"] for r in catalog.queries()["admission_sequence"](spark, sf).collect()}
    assert got == want


def test_cache_hits_against_a_plain_fold(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").toPandas()
    put, want = {}, {}
    for r in events.itertuples():
        k = (r.user_id, r.event_type)
        hit = k in put and (r.ts - put[k]).total_seconds() <= 7 * 86400
        if not hit:
            put[k] = r.ts
        want[r.event_id] = hit
    assert {r["event"]: r["hit"] for r in catalog.queries()["cache_hits_ttl"](spark, sf).collect()} == want


@pytest.mark.parametrize("name", ["newest_per_person_union", "edge_widths", "group_subgraph", "visible_degrees", "works_of_person", "graph_stats", "graph_violations", "node_sizes"])
def test_same_rows_where_shuffles_are_dealt_by_rows(spark, sf, duck, name, monkeypatch):
    """On larger tables the shuffles have a number of tasks of their own."""
    monkeypatch.setattr(adapters, "tasks_for", lambda rows: 7)
    got = catalog.queries()[name](spark, sf).toPandas()
    assert rows(got) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_work_identity_keys_of_odd_rows(spark, tmp_path):
    texts = [None, "", " \n", "*** -- !", "\u0301", "ΟΔΟΣ Σ ΑΣ. ΑΣΑ", "\u0130stanbul \u0130", "\ua7cb x\ua7dcy", "\u0870\ua7c0 \U00010570\U00031350", "\u0663 ² Ⅷ", "ß ẞ \u01c5 \ufb01", "  Lead Trail  "]
    sources = [None, "", "SRC1", "two words", " lead", "trail ", "x\ny", "ß", "É", "ΑΣ", "a|b", "a/b?c#d"]
    pairs = [(t, "src0") for t in texts] + [("A Title", s) for s in sources] + [(None, None), ("", "")]
    odd = [(i, *pair) for i, pair in enumerate((p for p in pairs for _ in range(6)), -12)] + [(None, "A Title", "src0")]
    spark.createDataFrame(odd, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect(config={"threads": 2})
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()["work_identity_keys"]).df()
    assert len(want) == len(odd)
    assert rows(catalog.queries()["work_identity_keys"](spark, str(tmp_path)).toPandas()) == rows(want)
