"""The driver's tables in the shape that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.session import dealt, tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks of a shuffle of lineitem, by its rows."""
    return tasks_for(table(spark, sf_dir, "lineitem"))


def works(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """work_id (order), year, person_ids (suppliers): one aggregate of two columns of lineitem. tasks: line_tasks(), where it is known."""
    n = tasks or line_tasks(spark, sf_dir)
    lines = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("person_id")), n, "work_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"), F.year("o_orderdate").alias("year"))
    return lines.groupBy("work_id").agg(F.collect_set("person_id").alias("person_ids")).join(dealt(orders, n, "work_id"), "work_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight, first_year, last_year of the works."""
    n = line_tasks(spark, sf_dir)
    return graph.derive_edges(works(spark, sf_dir, n), tasks=n)


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, person_id, year, title (the order's priority)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("title"))
    n = line_tasks(spark, sf_dir)
    lines = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("person_id")), n, "work_id")
    return lines.distinct().join(dealt(orders, n, "work_id"), "work_id")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, name, nation, groups (the nation's region)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.array("r_name").alias("groups"))


def line_links(spark: SparkSession, sf_dir: str, least: int = 20) -> DataFrame:
    """src, dst: documents that share a line of at least that many characters, each tied to the line's first document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line") >= least)
    keyed = lines.select("doc_id", F.sha2("line", 256).alias("k"))
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("k", "hub")
    return keyed.join(first, "k").select(F.col("hub").alias("src"), F.col("doc_id").alias("dst")).where("src <> dst").distinct()
