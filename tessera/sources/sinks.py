"""Writers: atomic snapshots, mirrored and staged commits, splits, CSV, TOML and retrieval indexes."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.checks import ContractError, broken_rules, gated


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_snapshot(df: DataFrame, path: str) -> None:
    """Parquet, written beside the target and renamed over it: readers see the old rows or the new ones."""
    staged = f"{path}._staging-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs, target, jvm = _fs(df.sparkSession, path)
    fs.delete(target, True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
        raise OSError(f"could not put {path} in place")


def publish(df: DataFrame, canonical: str, mirror: str) -> None:
    """Two copies of one result, unless both are the same place; the plan runs once."""
    write_snapshot(df, canonical)
    if canonical != mirror:
        write_snapshot(df.sparkSession.read.parquet(canonical), mirror)


def staged_commit(root: str, tables: dict[str, DataFrame], checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], gates: dict[str, tuple] | None = None) -> str:
    """Writes all tables to a new batch folder, with the gates of each (key, rules, refs as of checks.gated) counted by
    the job that writes it, then runs the violation queries on what was written, and only then points _current at it.
    Returns the batch's path; a broken gate or check leaves _current as it was and the batch goes.

    Rows' own rules and references belong into gates, which read nothing again. Checks are for what takes a shuffle of
    its own, as repeated keys: they read the columns they need of the written table.
    """
    spark = next(iter(tables.values())).sparkSession
    batch = f"{root}/batch-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            if name in (gates or {}):
                df, seen = gated(df, *gates[name])
                df.write.parquet(f"{batch}/{name}")
                if broken := broken_rules(seen):
                    raise ContractError(f"{name}: {broken}")
            else:
                df.write.parquet(f"{batch}/{name}")
        written = {name: spark.read.parquet(f"{batch}/{name}") for name in tables}
        for name, check in checks.items():
            if rows := check(written).limit(3).collect():
                raise ContractError(f"{name}: {rows}")
    except BaseException:
        fs, p, _ = _fs(spark, batch)
        fs.delete(p, True)
        raise
    write_snapshot(spark.range(1).select(F.lit(batch).alias("batch")), f"{root}/_current")
    return batch


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{spark.read.parquet(f'{root}/_current').first()[0]}/{table}")


def csv_rows(nodes: DataFrame, arrays: list[str]) -> DataFrame:
    """Arrays joined by ";", nulls empty, all as text."""
    return nodes.select(*[F.coalesce(F.array_join(c, ";") if c in arrays else F.col(c).cast("string"), F.lit("")).alias(c) for c in nodes.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("lineSep", "\n").csv(path)


def write_roster_toml(rows: list[dict], path: str) -> None:
    """A roster sorted by program and names, put in place by rename. A dimension's worth of rows, on the driver."""
    out = []
    for r in sorted(rows, key=lambda x: (x["program"], x["last"], x["first"])):
        out += ["[[trainees]]", *[f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in r.items()], ""]
    staged = f"{path}.tmp"
    with open(staged, "w", encoding="utf-8") as f:
        f.write("\n".join(out))
    os.replace(staged, path)


def write_index(chunks: DataFrame, vectors: DataFrame, folder: str, model: str, dims: int) -> None:
    """chunks.jsonl and vectors.jsonl sorted by id, and a one-row manifest with the count of each kind."""
    chunks.orderBy("id").write.mode("overwrite").json(f"{folder}/chunks.jsonl")
    vectors.select("id", F.base64("vector").alias("v")).orderBy("id").write.mode("overwrite").json(f"{folder}/vectors.jsonl")
    counts = chunks.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))
    counts.select(F.lit(model).alias("model"), F.lit(dims).alias("dimensions"), "counts").write.mode("overwrite").json(f"{folder}/manifest.json")
