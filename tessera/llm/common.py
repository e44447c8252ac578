"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: `[\x20\x09-\x0D]`. bytes.split() without an argument splits at just these.
SPACES = b" \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Keep Arrow batches of whole texts small: whichever limit comes first ends a batch.

    Plans read these settings when they run, so they stay set in the session; smaller ones of the caller's stay as they are.
    """
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most, read in (("maxRecordsPerBatch", rows, int), ("maxBytesPerBatch", size, as_bytes)):
        now = read(spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (id, text): other columns, whatever their names, stay out; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def carried(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """row (all columns as one struct, whatever their names), doc_id and more: decisions then fall on rows, not on ids."""
    return docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), *[c.alias(k) for k, c in more.items()])


def with_computed(rows: DataFrame, text_col: str, name: str, kind: T.DataType, make: Callable[[], Callable[[list[str]], pa.Array]]) -> DataFrame:
    """rows of carried() with one more column, of the texts of a batch. make() gives each task its function.

    Batches go through mapInArrow, which bounds them by bytes too; a column function's are bounded by rows alone.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, of([x or "" for x in b.column(names.index("row")).field(text_col).to_pylist()])], [*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the decimal id, modulo modulus: the folds of the contracts."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def in_fold(id_col: Column, modulus: int, fold: int) -> Column:
    """Whether an id is in that fold; a null id is in none."""
    return F.coalesce(crc_mod(id_col, modulus) == fold, F.lit(False))


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of a stream that is sorted by its first keys columns, many groups at a time, as numpy arrays.

    The last group of a batch waits for the next one; array columns arrive as arrays of arrays. Each piece has
    "_start", where its groups begin.
    """
    held: list[dict[str, np.ndarray]] = []

    def starts(cols: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
        n = len(cols[names[0]])
        new = np.zeros(n, bool)
        new[:1] = True
        for k in names[:keys]:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        return np.flatnonzero(new)

    def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    names: list[str] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        cols = {}
        for k in names:
            c = batch.column(batch.schema.get_field_index(k))
            if pa.types.is_list(c.type):
                cols[k] = np.empty(batch.num_rows, object)
                cols[k][:] = np.split(c.flatten().to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy())[:-1])
            else:
                cols[k] = c.to_numpy(zero_copy_only=False)
        if held and all(held[-1][k][-1] == cols[k][-1] for k in names[:keys]):
            held.append(cols)
            continue
        held.append(cols)
        got = joined(held)
        at = starts(got, names)
        last = at[-1]
        if last:
            piece = {k: v[:last] for k, v in got.items()}
            piece["_start"] = at[:-1]
            yield piece
        held = [{k: v[last:] for k, v in got.items()}]
    if held:
        got = joined(held)
        got["_start"] = starts(got, names)
        yield got


def min_labels(links: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index that each index reaches."""
    n = len(links)
    label = np.arange(n)
    linked = links | np.eye(n, dtype=bool)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low
