"""Streams of answers: a cache whose entries end by event time, and fragments that are held until they can't be a refusal.

Both keep their state in Structured Streaming's state store (RocksDB provider), so a restart from the checkpoint goes on
with what was known, and a micro-batch that is run again finds the state that it found before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CACHED = "key string, event long, ts timestamp, hit boolean, answer string"


class AnswerCache(StatefulProcessor):
    """Get and put for one key: a request finds an unexpired answer or puts its own; a refusal (no answer) is never put.

    The entry ends with its event-time timer; a hit neither renews nor changes it. Requests are counted, hits too.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "put long, answer string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entry = self.entry.get() if self.entry.exists() else None
        before = entry
        out = []
        # The rows of a key in a batch come in several pieces; their order in time counts.
        batch = pd.concat(list(rows)).sort_values(["ts", "event"], kind="stable")
        for t, ts, event, answer in zip(batch["ts"].astype("datetime64[us]").astype("int64"), batch["ts"], batch["event"], batch["answer"], strict=True):
            hit = entry is not None and t <= entry[0] + self.ttl
            if not hit:
                entry = None if pd.isna(answer) else (int(t), answer)
            out.append((key[0], event, ts, hit, entry[1] if entry is not None else None))
        if entry != before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            if entry is None:
                self.entry.clear()
            else:
                self.entry.update(entry)
                self.handle.registerTimer(self._ends(entry))
        yield pd.DataFrame(out, columns=["key", "event", "ts", "hit", "answer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entry = self.entry.get() if self.entry.exists() else None
        if entry is not None and self._ends(entry) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def _ends(self, entry: tuple[int, str]) -> int:
        """The first millisecond after the entry's last instant."""
        return (entry[0] + self.ttl) // 1000 + 1

    def close(self) -> None:
        pass


def stream_cache(requests: DataFrame, key: list[str], ttl_seconds: int, answer: Column, late: str = "10 minutes", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """CACHED of a stream of requests: whether a cached answer served each, and the answer. answer: what the request
    would get (null: a refusal). A request later than the watermark is dropped, as any late row; rows without a time too."""
    name = F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]))
    rows = requests.select(name.alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).cast("long").alias("event"), answer.cast("string").alias("answer"))
    timed = rows.withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(AnswerCache(ttl_seconds), CACHED, "Append", "EventTime")


TOKEN, NO_MATCH, DONE = "token", "no_match", "done"
SHOWN = "answer string, n int, kind string, text string"


def may_refuse(seen: str, sentinel: str) -> bool:
    """What has come, without leading white space, can still be or is the sentinel's start."""
    return sentinel.startswith(seen.lstrip()[:len(sentinel)])


class HeldFragments(StatefulProcessor):
    """One answer's fragments in order: held while they may be a refusal, then released together, later ones at once.

    Fragments that arrive before their turn wait in a map state by ordinal. The last fragment ends the answer: a text that is empty or
    holds the sentinel anywhere gives no_match, a short one that was held to the end is shown now. The state goes with the end.
    """

    def __init__(self, sentinel: str):
        self.sentinel = sentinel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next int, released boolean, ended boolean")
        self.text = handle.getListState("text", "piece string")
        self.ahead = handle.getMapState("ahead", "n int", "piece string, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        want, released, ended = self.place.get() if self.place.exists() else (0, False, False)
        if ended:
            return
        for pdf in rows:
            for n, piece, last in zip(pdf["n"], pdf["piece"], pdf["last"], strict=True):
                if n >= want and not self.ahead.containsKey((int(n),)):  # a fragment that is sent again changes nothing
                    self.ahead.updateValue((int(n),), (piece or "", bool(last)))
        said = [p for (p,) in self.text.get()] if self.text.exists() else []
        known, out = len(said), []
        while not ended and self.ahead.containsKey((want,)):
            piece, ended = self.ahead.getValue((want,))
            self.ahead.removeKey((want,))
            said.append(piece)
            if not released and not may_refuse("".join(said), self.sentinel):
                released = True
                out.append((key[0], want, TOKEN, "".join(said)))
            elif released:
                out.append((key[0], want, TOKEN, piece))
            want += 1
        if ended:
            whole = "".join(said).strip()
            if not whole or self.sentinel in whole:
                out.append((key[0], want, NO_MATCH, None))
            elif not released:
                out.append((key[0], want, TOKEN, whole))
            out.append((key[0], want, DONE, None))
            self.text.clear()
            self.ahead.clear()
        else:
            for piece in said[known:]:
                self.text.appendValue((piece,))
        self.place.update((want, released, ended))
        if out:
            yield pd.DataFrame(out, columns=["answer", "n", "kind", "text"])

    def close(self) -> None:
        pass


def stream_fragments(pieces: DataFrame, sentinel: str) -> DataFrame:
    """SHOWN of a stream of fragments (answer, n from 0, piece, last): what may be shown, in order, and how each answer ends."""
    rows = pieces.select(F.col("answer").cast("string").alias("answer"), F.col("n").cast("int").alias("n"), F.col("piece").cast("string").alias("piece"), F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("answer").transformWithStateInPandas(HeldFragments(sentinel), SHOWN, "Append", "None")


def shown(fragments: Column, sentinel: str) -> Column:
    """The batch form over an answer's array of fragments: an array of (n, kind, text), as the stream gives them."""
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+", "")
    start = F.struct(F.lit("").alias("seen"), F.lit(False).alias("out"), F.array().cast("array<struct<n:int,kind:string,text:string>>").alias("events"), F.lit(0).alias("n"))

    def step(acc: Column, piece: Column) -> Column:
        seen = F.concat(acc["seen"], piece)
        free = acc["out"] | ~F.startswith(F.lit(sentinel), F.substring(trimmed(seen), 1, len(sentinel)))
        event = F.struct(acc["n"].cast("int").alias("n"), F.lit(TOKEN).alias("kind"), F.when(acc["out"], piece).otherwise(seen).alias("text"))
        return F.struct(seen.alias("seen"), free.alias("out"), F.when(free, F.concat(acc["events"], F.array(event))).otherwise(acc["events"]).alias("events"), (acc["n"] + 1).alias("n"))

    def finish(acc: Column) -> Column:
        whole = F.regexp_replace(acc["seen"], r"(?U)^\s+|\s+$", "")
        end = lambda kind, text: F.array(F.struct(acc["n"].cast("int").alias("n"), F.lit(kind).alias("kind"), text.cast("string").alias("text")))
        none = F.lit(None)
        refused = (whole == "") | F.contains(whole, F.lit(sentinel))
        return F.concat(acc["events"], F.when(refused, end(NO_MATCH, none)).when(~acc["out"], end(TOKEN, whole)).otherwise(F.array().cast("array<struct<n:int,kind:string,text:string>>")), end(DONE, none))

    return F.aggregate(F.transform(fragments, lambda x: F.coalesce(x, F.lit(""))), start, step, finish)
