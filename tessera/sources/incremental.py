"""A streaming source over injected collectors: a position for each source as the offset, pacing by host, retries, and
failures as rows instead of failed queries."""

from __future__ import annotations

import importlib
import json
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.sources import shared

SCHEMA = "source_id string, status string, message string, position long, item string"


class CollectedSource(DataSource):
    """spark.readStream.format("collected").option("collector", "package.module:attribute").option("state", folder).

    The collector, an object that every worker can import, has
      sources() -> {source_id: host}
      latest(source_id) -> int          how many items the source has; positions below that never change
      fetch(source_id, start, end)      the items of the positions start to end - 1, in order

    Rows: an "item" (JSON) for each position, and a status row for each range that was asked for: "ok", or "error" or
    "blocked" (PermissionError) with a message, position being where the range starts. Each item comes once, also after
    restarts from the checkpoint: a range that failed leaves a note in the state folder and is asked for again by a later
    batch until it has been read. A source whose latest() fails gets a status row (at most one in health_seconds), and its
    position stays where it was.

    Options: pace (least seconds between two calls to a host, 0), retries (2) and backoff (first wait in seconds, 0.5,
    doubled each time) for a call, chunk (positions asked for at once, 1000: what a task holds), health_seconds (60).
    A host's calls go through one task, which is what keeps the pace; hosts go side by side.
    """

    @classmethod
    def name(cls) -> str:
        return "collected"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def _number(options: dict, name: str, default: float) -> float:
    return float(options.get(name, default))


class _Host:
    """Calls to one host, one after the other, with the pace and the retries of the options."""

    def __init__(self, options: dict):
        self.pace, self.backoff = _number(options, "pace", 0), _number(options, "backoff", 0.5)
        self.retries = int(_number(options, "retries", 2))
        self.next = 0.0

    def call(self, what: Callable[[], Any]) -> Any:
        for k in range(self.retries + 1):
            time.sleep(max(0.0, self.next - time.monotonic()))
            try:
                return what()
            except PermissionError:
                raise
            except Exception:
                if k == self.retries:
                    raise
                time.sleep(self.backoff * 2**k)
            finally:
                self.next = time.monotonic() + self.pace


def _status(error: Exception) -> str:
    return "blocked" if isinstance(error, PermissionError) else "error"


def _note(state: str, source: str, start: int, end: int, attempt: int) -> str:
    return f"{state}/missed/{quote(source, safe='')}~{start}~{end}~{attempt}.json"


class _Reader(DataSourceStreamReader):
    """Offsets: at (source: position), again (ranges to ask for once more, with the number of the attempt), down (source:
    time slot, status, message).

    The state folder has positions.json, written before an offset is given out, so a source that is down keeps its
    position; and a note for each range whose last attempt failed. The next attempt asks only where the note still
    stands, and the note goes when a batch with that next attempt is committed: a replayed batch does what it did before.
    """

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.state = self.options["state"].rstrip("/")

    def collector(self):
        module, name = self.options["collector"].split(":")
        return getattr(importlib.import_module(module), name)

    def initialOffset(self) -> dict:
        return {"at": {}, "again": [], "down": {}}

    def latestOffset(self) -> dict:
        collector = self.collector()
        sources = collector.sources()
        known = shared.get_json(f"{self.state}/positions.json", {})
        slot = int(time.time() // max(1.0, _number(self.options, "health_seconds", 60)))
        hosts = defaultdict(list)
        for source, host in sorted(sources.items()):
            hosts[host].append(source)

        def ask(of: list[str]) -> list[tuple[str, int | None, list]]:
            host, out = _Host(self.options), []
            for source in of:
                try:
                    out.append((source, int(host.call(lambda s=source: collector.latest(s))), []))
                except Exception as e:  # noqa: BLE001  one source's failure is a row
                    out.append((source, None, [slot, _status(e), str(e)]))
            return out

        at, down = dict(known), {}
        if hosts:
            with ThreadPoolExecutor(min(32, len(hosts))) as pool:
                for source, latest, why in (r for rows in pool.map(ask, hosts.values()) for r in rows):
                    if latest is None:
                        down[source] = why
                    else:
                        at[source] = max(latest, known.get(source, 0))
        if at != known:
            shared.put_json(f"{self.state}/positions.json", at)
        again = []
        for name in shared.names(f"{self.state}/missed"):
            source, start, end, attempt = name.removesuffix(".json").rsplit("~", 3)
            again.append([unquote(source), int(start), int(end), int(attempt) + 1])
        return {"at": at, "again": sorted(again), "down": down}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        host_of = self.collector().sources()
        step = max(1, int(_number(self.options, "chunk", 1000)))
        jobs = defaultdict(list)
        for source, to in sorted(end["at"].items()):
            first = start["at"].get(source, 0)
            jobs[host_of.get(source, source)] += [("read", source, k, min(k + step, to), 0) for k in range(first, to, step)]
        for job in end["again"]:
            if job not in start["again"]:
                jobs[host_of.get(job[0], job[0])].append(("read", *job))
        for source, why in sorted(end["down"].items()):
            if start["down"].get(source) != why:
                jobs[host_of.get(source, source)].append(("down", source, end["at"].get(source, 0), *why[1:]))
        return [InputPartition(of) for of in jobs.values()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        collector, host = self.collector(), _Host(self.options)
        for kind, source, start, *rest in partition.value:
            if kind == "down":
                yield source, *rest, start, None
                continue
            end, attempt = rest
            if attempt and not shared.exists(_note(self.state, source, start, end, attempt - 1)):
                continue
            note = _note(self.state, source, start, end, attempt)
            try:
                items = [json.dumps(x, sort_keys=True) for x in host.call(lambda s=source, a=start, b=end: list(collector.fetch(s, a, b)))]
                if len(items) != end - start:
                    raise ValueError(f"{len(items)} items for {end - start} positions")
            except Exception as e:  # noqa: BLE001
                shared.put_json(note, str(e))
                yield source, _status(e), str(e), start, None
                continue
            shared.drop(note)
            yield source, "ok", "", start, None
            for k, item in enumerate(items):
                yield source, "item", "", start + k, item

    def commit(self, end: dict) -> None:
        for source, first, last, attempt in end["again"]:
            shared.drop(_note(self.state, source, first, last, attempt - 1))
