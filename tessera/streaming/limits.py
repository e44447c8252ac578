"""Rate limits, budgets and caches over request streams: batch forms and their streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.session import materialize


def tumbling_counts(events: DataFrame, key: str, unit: str = "minute", ts: str = "ts") -> DataFrame:
    """key, bucket, n per calendar-aligned bucket."""
    return events.groupBy(key, F.date_trunc(unit, ts).alias("bucket")).agg(F.count("*").alias("n"))


def over_limit(events: DataFrame, key: str, limit: int, unit: str = "minute", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """events with bucket, seq (its number in the bucket) and denied."""
    w = Window.partitionBy(key, "bucket").orderBy(ts, order)
    return events.withColumn("bucket", F.date_trunc(unit, ts)).withColumn("seq", F.row_number().over(w)).withColumn("denied", F.col("seq") > limit)


def micro_cost(input_tokens: Column | str, output_tokens: Column | str, price_in: int, price_out: int) -> Column:
    """Micro-dollars at prices in micro-dollars for a million tokens."""
    i, o = (F.col(c) if isinstance(c, str) else c for c in (input_tokens, output_tokens))
    return F.round(i * price_in / F.lit(1e6) + o * price_out / F.lit(1e6)).cast("long")


def cumulative_spend(requests: DataFrame, cost: str, budget: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """requests with month, spent (running in the month) and denied (the budget was reached before).

    Hours are summed first, so the running sum over a month has one row an hour, and the windows over single
    requests run within an hour.
    """
    hours = requests.groupBy(F.date_trunc("month", ts).alias("month"), F.date_trunc("hour", ts).alias("hour")).agg(F.sum(cost).alias("hour_spent"))
    before = F.coalesce(F.sum("hour_spent").over(Window.partitionBy("month").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = hours.select("hour", before.alias("before"))
    inside = F.sum(cost).over(Window.partitionBy("hour").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = requests.withColumn("month", F.date_trunc("month", ts)).withColumn("hour", F.date_trunc("hour", ts)).join(earlier, "hour")
    spent = rows.withColumn("spent", F.col("before") + inside)
    return spent.withColumn("denied", (F.col("spent") - F.col(cost)) >= budget).drop("before", "hour")


#: What admission() decides, in the order in which the checks come.
ADMIT, MONTH, DAILY, MINUTE, DAY = "admit", "month_budget", "global_day", "ip_minute", "ip_day"


def _before(rows: DataFrame, value: str, span: str, name: str) -> DataFrame:
    """rows with name: the sum of value over the earlier rows of the same span ("day" or "month") in the order of _second, ts, event.

    Sums go up by seconds and hours and come down again, so no window has more than a second's rows, an hour's seconds or a month's hours.
    """
    hour = F.date_trunc("hour", "_second")
    seconds = rows.groupBy("_second").agg(F.sum(value).alias("_s"))
    hours = seconds.groupBy(hour.alias("_hour")).agg(F.sum("_s").alias("_h"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("_hour", F.coalesce(F.sum("_h").over(earlier(Window.partitionBy(F.date_trunc(span, "_hour")).orderBy("_hour"))), F.lit(0)).alias("_h"))
    starts = seconds.select("_second", hour.alias("_hour"), F.coalesce(F.sum("_s").over(earlier(Window.partitionBy(hour).orderBy("_second"))), F.lit(0)).alias("_s"))
    starts = starts.join(hours, "_hour").select("_second", (F.col("_h") + F.col("_s")).alias("_start"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("_second").orderBy("ts", "event"))), F.lit(0))
    return rows.join(starts, "_second").withColumn(name, F.col("_start") + inside).drop("_start")


def admission(requests: DataFrame, per_minute: int, per_day: int, daily: int, budget: int, ts: str = "ts", order: str = "event_id", address: str = "user_id", cost: str = "cost") -> DataFrame:
    """event, decision of the ordered admission: month budget, global day cap, then the address's minute and day buckets.

    A denied request has still used the address's buckets that it reached, but neither the global cap nor the budget. The
    fold over a month falls apart into saturating counters, since the shared ones only ever shut: a day that is full stays
    full and a spent month stays spent, so what an address does before that doesn't depend on others, and after it doesn't
    count. An address's day count before a minute is the sum of its earlier minutes, each at most per_minute; the admitted
    of a day are its first daily candidates; the budget is reached where the running cost of those is. So there are sorts
    within an address's minute or within a second, and sums of bounded calendars, but no task that reads a month.

    Requests without a time are none and left out; a null address is an address; a null or negative cost costs nothing;
    requests of one time go by order. Rows that agree in both are each a request, in an order that stays open.
    """
    at = F.col(ts).cast("timestamp")
    rows = requests.where(at.isNotNull()).select(
        at.alias("ts"), F.col(order).cast("long").alias("event"), F.col(address).alias("_address"), F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0)).alias("_cost"),
        F.date_trunc("minute", at).alias("_minute"), F.date_trunc("second", at).alias("_second"))
    used = rows.groupBy("_address", "_minute").agg(F.least(F.count("*"), F.lit(per_minute)).alias("_used"))
    of_day = Window.partitionBy("_address", F.date_trunc("day", "_minute")).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    used = used.select(F.col("_address").alias("_a"), F.col("_minute").alias("_m"), F.coalesce(F.sum("_used").over(of_day), F.lit(0)).alias("_today"))
    nth = F.row_number().over(Window.partitionBy("_address", "_minute").orderBy("ts", "event"))
    counted = rows.withColumn("_nth", nth).join(used, F.col("_address").eqNullSafe(F.col("_a")) & (F.col("_minute") == F.col("_m")))
    own = F.when(F.col("_nth") > per_minute, MINUTE).when(F.col("_today") + F.col("_nth") > per_day, DAY).otherwise(ADMIT)
    judged = materialize(counted.select("ts", "event", "_second", "_cost", own.alias("own")).withColumn("_candidate", (F.col("own") == ADMIT).cast("long")), "judged")
    capped = materialize(_before(judged, "_candidate", "day", "_admitted").withColumn("_paid", F.when((F.col("_candidate") == 1) & (F.col("_admitted") < daily), F.col("_cost")).otherwise(0)), "capped")
    spent = _before(capped, "_paid", "month", "_spent")
    return spent.select("event", F.when(F.col("_spent") >= budget, MONTH).when(F.col("_admitted") >= daily, DAILY).otherwise(F.col("own")).alias("decision"))


def cache_hits(requests: DataFrame, key: list[str], ttl_days: int, ts: str = "ts", order: str = "event_id", refusal: Column | None = None) -> DataFrame:
    """event, hit: a hit finds a put of its key that hasn't expired; a miss puts unless its answer is a refusal, a hit doesn't renew.

    A key's requests stream through a task in order; nothing is held but the key and the time of its last put.
    """
    ttl = ttl_days * 86400 * 1_000_000
    rows = requests.select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(order).cast("long").alias("event"), (F.lit(False) if refusal is None else F.coalesce(refusal, F.lit(False))).alias("_refused"))
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "_t", "event")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, put = None, 0
        for pdf in parts:
            hit = []
            for *k, t, no in zip(*(pdf[c] for c in key), pdf["_t"], pdf["_refused"], strict=True):
                fresh = k == now and t <= put + ttl
                if not fresh:
                    now, put = (None, 0) if no else (k, t)
                hit.append(fresh)
            yield pdf[[*key, "event"]].assign(hit=hit)
    return ordered.mapInPandas(run, T.StructType([*(rows.schema[c] for c in key), T.StructField("event", T.LongType()), T.StructField("hit", T.BooleanType())]))


def refused(fragments: Column, sentinel: str) -> Column:
    """The joined fragments start with the refusal sentinel."""
    return F.startswith(F.ltrim(F.array_join(fragments, "")), F.lit(sentinel))


def held_prefix(fragments: Column, sentinel: str) -> Column:
    """How many leading fragments must be held back: while what has come could still become the sentinel. answers.shown()
    says what a reader sees of an answer, refusals and leading white space included."""
    start = F.struct(F.lit("").alias("seen"), F.lit(0).alias("n"), F.lit(False).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.concat(acc["seen"], x)
        maybe = ~acc["out"] & F.startswith(F.lit(sentinel), seen)
        return F.struct(seen.alias("seen"), (acc["n"] + F.when(maybe, 1).otherwise(0)).alias("n"), (acc["out"] | ~maybe).alias("out"))
    return F.aggregate(fragments, start, step)["n"]


# -- streaming forms

def stream_tumbling_counts(events: DataFrame, key: str, width: str = "1 minute", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """key, bucket, n of a stream; a bucket is final when the watermark has passed it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("bucket"), "n")


def stream_first_questions(requests: DataFrame, key: list[str], late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first request of each key within the watermark."""
    return requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


class KeyedLimit(StatefulProcessor):
    """Counts a key's requests in each minute and day; the state of a bucket ends with its time to live."""

    def __init__(self, per_minute: int, per_day: int):
        self.per_minute, self.per_day = per_minute, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.minutes = handle.getMapState("minutes", "bucket string", "n int", ttlDurationMs=3_600_000)
        self.days = handle.getMapState("days", "bucket string", "n int", ttlDurationMs=2 * 86_400_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The rows of a key in a batch come in several pieces; their order in time counts.
        for pdf in [pd.concat(list(rows))]:
            out = []
            for r in pdf.sort_values(["ts", "event_id"]).itertuples():
                minute, day = (r.ts.strftime("%Y-%m-%d %H:%M"),), (r.ts.strftime("%Y-%m-%d"),)
                n = (self.minutes.getValue(minute)[0] if self.minutes.containsKey(minute) else 0) + 1
                self.minutes.updateValue(minute, (n,))
                verdict = MINUTE
                if n <= self.per_minute:
                    d = (self.days.getValue(day)[0] if self.days.containsKey(day) else 0) + 1
                    self.days.updateValue(day, (d,))
                    verdict = ADMIT if d <= self.per_day else DAY
                out.append((key[0], r.event_id, verdict))
            yield pd.DataFrame(out, columns=["key", "event", "decision"])

    def close(self) -> None:
        pass


def stream_limits(events: DataFrame, key: str, per_minute: int, per_day: int) -> DataFrame:
    """key, event, decision of a stream of (key, ts, event_id). Needs the RocksDB state store provider."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    return rows.groupBy("key").transformWithStateInPandas(KeyedLimit(per_minute, per_day), "key string, event long, decision string", "Update", "ProcessingTime")


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a key in a batch, which come in several pieces, in the order of time."""
    return pd.concat(list(rows)).sort_values(["ts", "event"], kind="stable")


class AddressLimits(StatefulProcessor):
    """An address's counters of its latest minute and day: one row of state, read and written once a batch."""

    def __init__(self, per_minute: int, per_day: int):
        self.per_minute, self.per_day = per_minute, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "minute string, n long, day string, d long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        minute, n, day, d = self.counters.get() if self.counters.exists() else ("", 0, "", 0)
        batch, verdicts = _in_order(rows), []
        for now in batch["ts"].dt.strftime("%Y-%m-%d %H:%M"):
            if now != minute:
                minute, n = now, 0
            if now[:10] != day:
                day, d = now[:10], 0
            n += 1
            if n > self.per_minute:
                verdicts.append(MINUTE)
                continue
            d += 1
            verdicts.append(ADMIT if d <= self.per_day else DAY)
        self.counters.update((minute, n, day, d))
        yield batch[["event", "ts", "cost"]].assign(decision=verdicts)

    def close(self) -> None:
        pass


class SharedLimits(StatefulProcessor):
    """A month's budget and its latest day's cap, over requests that their addresses' limits have judged."""

    def __init__(self, daily: int, budget: int):
        self.daily, self.budget = daily, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "spent long, day string, admitted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spent, day, admitted = self.used.get() if self.used.exists() else (0, "", 0)
        batch, decisions = _in_order(rows), []
        for now, decision, cost in zip(batch["ts"].dt.strftime("%Y-%m-%d"), batch["decision"], batch["cost"], strict=True):
            if now != day:
                day, admitted = now, 0
            if spent >= self.budget:
                decision = MONTH
            elif admitted >= self.daily:
                decision = DAILY
            elif decision == ADMIT:
                admitted += 1
                spent += int(cost)
            decisions.append(decision)
        self.used.update((spent, day, admitted))
        yield batch[["event"]].assign(decision=decisions)

    def close(self) -> None:
        pass


def stream_admission(requests: DataFrame, per_minute: int, per_day: int, daily: int, budget: int, ts: str = "ts", order: str = "event_id", address: str = "user_id", cost: str = "cost") -> DataFrame:
    """event, decision of a stream that comes in order of time: admission() as two chained states, the addresses' counters and the month's.

    An address may go on counting after the shared limits have shut; as these stay shut, that changes nothing. State: one row
    for each address and each month. Needs the RocksDB state store provider.
    """
    at = F.col(ts).cast("timestamp")
    rows = requests.where(at.isNotNull()).select(F.coalesce(F.col(address).cast("string"), F.lit("\0")).alias("key"), at.alias("ts"), F.col(order).cast("long").alias("event"), F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0)).alias("cost"))
    own = rows.groupBy("key").transformWithStateInPandas(AddressLimits(per_minute, per_day), "event long, ts timestamp, cost long, decision string", "Append", "None")
    return own.withColumn("month", F.date_format("ts", "yyyy-MM")).groupBy("month").transformWithStateInPandas(SharedLimits(daily, budget), "event long, decision string", "Append", "None")
