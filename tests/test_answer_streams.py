"""Streams of requests and answers against plain folds, over several micro-batches and a restart from the checkpoint."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.streaming import answers, limits

START = datetime.datetime(2024, 1, 30, 22, 0)


@pytest.fixture(scope="module")
def rocks(spark):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", keep)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, make, parts, schema, tmp_path):
    """The stream's rows over one file for each of parts, each a run of its own that goes on from the checkpoint."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


def in_order(n, keys, step, seed):
    rng = random.Random(seed)
    at, rows = START, []
    for k in range(n):
        at += datetime.timedelta(seconds=rng.choice(step))
        rows.append((k, at, rng.choice(keys), rng.choice([None, 100, 250, -5])))
    return rows


# -- admission


def plain_admission(rows, per_minute, per_day, daily, budget):
    counts, spent, out = Counter(), Counter(), {}
    for event, ts, who, cost in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        month, day, minute = ts.strftime("%Y-%m"), ts.strftime("%Y-%m-%d"), ts.strftime("%Y-%m-%d %H:%M")
        out[event] = "admit"
        if spent[month] >= budget:
            out[event] = "month_budget"
            continue
        if counts["all", day] >= daily:
            out[event] = "global_day"
            continue
        counts[who, minute] += 1
        if counts[who, minute] > per_minute:
            out[event] = "ip_minute"
            continue
        counts[who, day] += 1
        if counts[who, day] > per_day:
            out[event] = "ip_day"
            continue
        counts["all", day] += 1
        spent[month] += max(cost or 0, 0)
    return out


REQUESTS = "event_id long, ts timestamp, user_id string, cost long"


@pytest.mark.parametrize("limit", [(2, 30, 60, 4_000), (1, 5, 1000, 10 ** 9), (3, 8, 20, 2_500), (5, 1000, 1, 1), (1, 1, 1, 0)])
def test_admission_equals_the_fold(spark, limit):
    """With a hot address, ties in time, null addresses, costs and times, over the end of a month."""
    rows = in_order(500, ["hot"] * 6 + ["a", "b", None], [0, 0, 1, 20, 400], 5) + [(9000, None, "a", 5)]
    got = limits.admission(spark.createDataFrame(rows, REQUESTS).repartition(3), *limit).collect()
    assert len(got) == 500
    assert {r.event: r.decision for r in got} == plain_admission(rows, *limit)


def test_stream_admission_equals_the_fold(rocks, tmp_path):
    rows = in_order(240, ["hot"] * 6 + ["a", "b", None], [0, 1, 20, 900], 6)
    limit = (2, 6, 15, 2_500)
    got = run(rocks, lambda s: limits.stream_admission(s, *limit), [rows[:100], rows[100:101], rows[101:]], REQUESTS, tmp_path)
    want = plain_admission(rows, *limit)
    assert {"month_budget", "ip_minute", "ip_day", "global_day", "admit"} == set(want.values())
    assert len(got) == len(rows) and {r.event: r.decision for r in got} == want


# -- the cache


def plain_cache(rows, ttl):
    held, out = {}, {}
    for event, ts, key, answer in sorted(rows, key=lambda r: (r[1], r[0])):
        put = held.get(key)
        hit = put is not None and ts <= put[0] + ttl
        if not hit:
            held.pop(key, None)
            if answer is not None:
                held[key] = (ts, answer)
        out[event] = (hit, held[key][1] if key in held else None)
    return out


def test_stream_cache_across_batches_and_restarts(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(k, ts, key, None if cost is None else f"answer {k}") for k, ts, key, cost in in_order(200, ["q1", "q2", None], [1, 60, 3600], 8)]
    # Within a batch rows may come in any order; the watermark is wider than that.
    parts = [rows[:80], rows[80:90], rows[90:]]
    for p in parts:
        rng.shuffle(p)
    ttl = datetime.timedelta(hours=2)
    got = run(rocks, lambda s: answers.stream_cache(s, ["user_id"], 7200, F.col("answer"), late="30 days"), parts, "event_id long, ts timestamp, user_id string, answer string", tmp_path)
    want = plain_cache(rows, ttl)
    assert len(got) == len(rows) and {r.event: (r.hit, r.answer) for r in got} == want
    assert {h for h, _ in want.values()} == {True, False}
    batch = rocks.createDataFrame(rows, "event_id long, ts timestamp, user_id string, answer string")
    days = plain_cache(rows, datetime.timedelta(days=1))
    assert {r.event: r.hit for r in limits.cache_hits(batch, ["user_id"], 1, refusal=F.col("answer").isNull()).collect()} == {k: h for k, (h, _) in days.items()}


def test_cache_entries_end_with_their_timers(rocks, tmp_path):
    """A batch far ahead moves the watermark past the entries' ends; the keys' next requests miss and put again."""
    rows = [(k, START + datetime.timedelta(hours=h), key, f"a{k}") for k, (h, key) in enumerate([(0, "q"), (1, "q"), (50, "other"), (100, "other"), (101, "q"), (102, "q")])]
    got = run(rocks, lambda s: answers.stream_cache(s, ["user_id"], 7200, F.col("answer"), late="1 minute"), [rows[:2], rows[2:3], rows[3:4], rows[4:]], "event_id long, ts timestamp, user_id string, answer string", tmp_path)
    assert {r.event: (r.hit, r.answer) for r in got} == plain_cache(rows, datetime.timedelta(hours=2))


# -- held fragments

NO = "NO_ANSWER"
SAID = {
    "plain": ["Hello", " there", "."], "refusal": ["NO", "_ANS", "WER"], "refusal and more": [" \n", "NO_ANSWER", ".", " sorry"], "almost": ["NO", "_A", "LL", " good"], "short": ["  NO"], "empty": [""],
    "blank": [" ", "\n"], "later": ["Well, ", "NO_ANS", "WER"], "space first": ["  ", " ", "So", "me"], "null": [None, "x", None], "one": ["NO_ANSWER"], "just": ["N", "O", "NE"],
}


def plain_shown(pieces):
    out, said, held = [], [], True
    for n, p in enumerate(pieces):
        said.append(p or "")
        if held and NO.startswith("".join(said).lstrip()[:len(NO)]):
            continue
        out.append((n, "token", "".join(said) if held else p or ""))
        held = False
    whole = "".join(said).strip()
    if not whole or NO in whole:
        out.append((len(pieces), "no_match", None))
    elif held:
        out.append((len(pieces), "token", whole))
    return [*out, (len(pieces), "done", None)]


def test_shown_of_arrays(spark):
    df = spark.createDataFrame(list(SAID.items()), "answer string, f array<string>")
    got = df.select("answer", answers.shown(F.col("f"), NO).alias("s")).collect()
    for r in got:
        assert [tuple(x) for x in r.s] == plain_shown(SAID[r.answer]), r.answer


def test_stream_fragments_out_of_order_and_after_a_restart(rocks, tmp_path):
    rows = [(a, n, p, n == len(f) - 1) for a, f in SAID.items() for n, p in enumerate(f)]
    random.Random(3).shuffle(rows)
    rows += rows[:5]  # sent again
    got = run(rocks, lambda s: answers.stream_fragments(s, NO), [rows[:12], rows[12:20], rows[20:]], "answer string, n int, piece string, last boolean", tmp_path)
    by = defaultdict(list)
    for r in got:
        by[r.answer].append((r.n, r.kind, r.text))
    order = {"token": 0, "no_match": 0, "done": 1}
    assert {a: sorted(v, key=lambda x: (x[0], order[x[1]])) for a, v in by.items()} == {a: plain_shown(f) for a, f in SAID.items()}
