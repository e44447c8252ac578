"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters (Spark's range exchange over a bounded prefix of
the bytes, the hash of the whole text, then the doc_id) and sorted by the external sorter with the whole text
as the tie-break, so equal texts are neighbours. Each task compares every text in full with the one before it.
The doc_id among the splitters lets a group of any size spread over several partitions: its rows stay adjacent
in the global order, and the runs that touch a partition's ends (two a partition at most) are stitched.

Results for odd input: a null text is empty; empty texts equal one another; of equal texts the one with the
most code points in its original, then the smallest doc_id stays; very long texts are compared in full; rows
that repeat a doc_id give a row each, of which one at most is kept: of a group the first in the sort; a null doc_id comes after all others; an empty table gives no rows. exact_duplicates() never reads other columns;
drop_duplicates() carries whole rows through, whatever their columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACES, bounded_batches, carried, columns, text_of, texts
from tessera.session import materialize

#: Bytes of a text that a splitter may hold.
PREFIX = 24
RUNS = "doc_id long, sha string, first_id long, first_cp long, n long, edge boolean, head boolean"


def normalized(text: Column) -> Column:
    """The text without the contract's white space."""
    for b in SPACES:
        text = F.replace(text, F.lit(chr(b)), F.lit(""))
    return text


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each input row, with what its run of equal texts in this partition has."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    out: list[list] = [[] for _ in names]
    last: bytes | None = None
    ids: list[int] = []
    head = 0
    first_run = True

    def close(edge: bool) -> None:
        sha = hashlib.sha256(last).hexdigest()
        n = len(ids)
        for col, value in zip(out, (ids, [sha] * n, [ids[0]] * n, [head] * n, [n] * n, [edge] * n, [True] + [False] * (n - 1)), strict=True):
            col.extend(value)

    def full() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
        for c in out:
            c.clear()
        return batch

    for b in batches:
        for doc_id, cp, norm in zip(*columns(b, "doc_id", "cp", "norm"), strict=True):
            if norm != last or last is None:
                if last is not None:
                    close(first_run)
                    first_run = False
                last, head = norm, cp
                ids = []
            ids.append(doc_id)
        if len(out[0]) >= 4096:
            yield full()
    if last is not None:
        close(True)
        yield full()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = texts(docs, id_col, text_col).select("doc_id", F.length("text").alias("cp"), normalized(F.col("text")).alias("norm"))
    keyed = norm.select(F.substring(F.col("norm").cast("binary"), 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("h"), "doc_id", "cp", F.col("norm").cast("binary").alias("norm"))
    last = F.col("doc_id").asc_nulls_last()
    ordered = keyed.repartitionByRange(n, "prefix", "h", last).sortWithinPartitions("prefix", "h", "norm", F.col("cp").desc(), last)
    runs = materialize(ordered.mapInArrow(_runs, RUNS), "runs")
    # At most two runs of a partition touch its ends: a bounded table.
    ends = runs.where("edge").groupBy("sha", "first_id", "first_cp", "n").agg(F.count("*").alias("rows"))
    whole = ends.groupBy("sha").agg(F.sum("rows").alias("whole_n"), F.max(F.struct("first_cp", -F.col("first_id"))).alias("best")).select(
        "sha", "whole_n", (-F.col("best.col2")).alias("whole_id"))
    joined = runs.join(F.broadcast(whole), "sha", "left")
    keep = F.when(F.col("edge"), F.col("whole_id")).otherwise(F.col("first_id"))
    size = F.when(F.col("edge"), F.col("whole_n")).otherwise(F.col("n"))
    # Rows of one text and doc_id have one range key, so one partition: the first of its run is the only one to stay.
    kept = F.col("head") & keep.eqNullSafe(F.col("doc_id"))
    return joined.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal texts of a sorted partition; edge: the run touches an end of the partition."""
    last, held, first = None, None, True
    for b in batches:
        at = []
        for k, norm in enumerate(columns(b, "norm")[0]):
            if norm != last or last is None:
                at.append(k)
                last = norm
        if not at:
            continue
        rows = pa.Table.from_batches([b.drop_columns(["norm"])]).take(pa.array(at))
        if held is not None:
            rows = pa.concat_tables([held, rows])
        held = rows.slice(rows.num_rows - 1)
        done = rows.slice(0, rows.num_rows - 1)
        if done.num_rows:
            yield from done.append_column("edge", pa.array([first, *[False] * (done.num_rows - 1)])).to_batches()
            first = False
    if held is not None:
        yield from held.append_column("edge", pa.array([True])).to_batches()


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with the columns they came with.

    Whole rows go through the content sort, so a decision falls on a row whatever its doc_id: of rows that tie in text
    length and doc_id the first one stays, and a null doc_id comes after the others.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = normalized(text_of(text_col))
    keyed = carried(docs, id_col, prefix=F.substring(norm.cast("binary"), 1, PREFIX), h=F.xxhash64(norm), tie=F.monotonically_increasing_id())
    nulls_last = F.col("doc_id").asc_nulls_last()
    dealt = keyed.repartitionByRange(n, "prefix", "h", nulls_last, "tie")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    ordered = dealt.select("row", "doc_id", "prefix", "h", "tie", F.length(text).alias("cp"), normalized(text).cast("binary").alias("norm")).sortWithinPartitions(
        "prefix", "h", "norm", F.col("cp").desc(), nulls_last, "tie").select("row", "doc_id", "cp", "tie", "norm")
    out = T.StructType([f for f in ordered.schema.fields if f.name != "norm"]).add("edge", "boolean")
    heads = materialize(ordered.mapInArrow(_heads, out), "heads")
    marked = heads.withColumn("sha", F.when(F.col("edge"), F.sha2(normalized(text).cast("binary"), 256)))
    # At most two rows of a partition are at its ends: a bounded table.
    ends = marked.where("edge").select("sha", "tie", F.struct(-F.col("cp"), F.col("doc_id").isNull(), "doc_id", "tie").alias("rank"))
    best = ends.groupBy("sha").agg(F.min("rank").alias("best"))
    lost = ends.join(best, "sha").where(F.col("rank") != F.col("best")).select("sha", "tie")
    return marked.join(F.broadcast(lost), ["sha", "tie"], "left_anti").select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents),
r AS (
  SELECT doc_id, sha, count(*) OVER (PARTITION BY sha) AS group_size,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY cp DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha AS text_sha256 FROM r
"""
