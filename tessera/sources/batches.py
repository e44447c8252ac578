"""A transactional table of batches: a data source writer whose commit is one small file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from tessera.sources import shared

ROWS = 100_000


class BatchesSink(DataSource):
    """df.write.format("batches").option("path", folder).option("batch", name).mode("append").save(), and the same for
    writeStream with option("query", name) in place of batch.

    Tasks write Parquet files under names of their own; the driver's commit moves a manifest with the files of the tasks
    that succeeded into _log. What no manifest names, files of killed or speculative attempts among it, is never read,
    and sweep() deletes it. A batch is known by its name (for streams: the query's name and the batch's number), and a name that is
    committed already stays as it is: a batch that is replayed after a restart changes nothing. mode("overwrite") names
    the manifests that it replaces in its own, so readers see the old table or the new one. Columns of any type that
    Arrow has; the table's schema is the reader's to give.
    """

    @classmethod
    def name(cls) -> str:
        return "batches"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(dict(self.options), overwrite)


@dataclass
class Written(WriterCommitMessage):
    """The file of a task (None without rows) and its rows."""

    file: str | None
    rows: int


class _Files:
    def __init__(self, options: dict, overwrite: bool):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.query, self.batch = options.get("query", "stream"), options.get("batch") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = shared.opened(f"{self.root}/data")
        name, out, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        try:
            for b in iterator:
                if b.num_rows and out is None:
                    fs.create_dir(folder, recursive=True)
                    out = pq.ParquetWriter(f"{folder}/{name}", b.schema, filesystem=fs, compression="zstd")
                if b.num_rows:
                    out.write_batch(b, row_group_size=ROWS)
                    rows += b.num_rows
        except BaseException:
            if out is not None:
                out.close()
                shared.drop(f"{self.root}/data/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def put(self, name: str, messages: list[Written | None]) -> None:
        log = f"{self.root}/_log"
        if shared.exists(f"{log}/{name}.json"):
            self.discard(messages)
            return
        done = [m for m in messages if m is not None]
        shared.put_json(f"{log}/{name}.json", {
            "files": sorted(m.file for m in done if m.file), "rows": sum(m.rows for m in done),
            "replaces": [n.removesuffix(".json") for n in shared.names(log)] if self.overwrite else []})

    def discard(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.file:
                shared.drop(f"{self.root}/data/{m.file}")


class _Writer(_Files, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self.put(quote(self.batch, safe=""), messages)

    def abort(self, messages) -> None:
        self.discard(messages)


class _StreamWriter(_Files, DataSourceStreamArrowWriter):
    """Every batch of a stream adds rows (output mode append), or is the whole table (complete)."""

    def commit(self, messages, batchId: int) -> None:
        self.put(f"{quote(self.query, safe='')}-{batchId:012d}", messages)

    def abort(self, messages, batchId: int) -> None:
        self.discard(messages)


def manifests(root: str) -> dict[str, dict]:
    """The table's committed batches that no later one replaces, by name: files, rows."""
    log = f"{root.rstrip('/')}/_log"
    found = {n.removesuffix(".json"): shared.get_json(f"{log}/{n}") for n in shared.names(log)}
    gone = {old for m in found.values() for old in m["replaces"]}
    return {n: m for n, m in found.items() if n not in gone}


def read_batches(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all committed batches. Names of files go through the driver, as for every table of files."""
    root = root.rstrip("/")
    files = [f"{root}/data/{f}" for m in manifests(root).values() for f in m["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def sweep(root: str, older_than: float = 24 * 3600.0) -> int:
    """Deletes files that no batch has, and whose age in seconds says that no running write does; returns how many."""
    import time

    from pyarrow import fs as pafs
    root = root.rstrip("/")
    held = {f for m in manifests(root).values() for f in m["files"]}
    fs, folder = shared.opened(f"{root}/data")
    stray = [i for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
             if i.type == pafs.FileType.File and i.base_name not in held and (i.mtime_ns or 0) / 1e9 <= time.time() - older_than]
    for i in stray:
        fs.delete_file(i.path)
    return len(stray)
