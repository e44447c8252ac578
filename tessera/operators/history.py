"""Incremental history: merging batches into retained history, change detection, retention and diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.entity import first_key_match, last_wins


def merge_history(before: DataFrame, fresh: DataFrame, now: Column, key: str = "id", owner: str = "organization_id", time: str = "published_at",
                  title: str = "title", keep_days: int | None = None, per_owner: int | None = None, owners: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """History after a batch: a fresh row replaces the old one but keeps its first_seen_at; last_seen_at is now for
    fresh rows; rows of owners that are gone and rows older than the (inclusive) cutoff go; the newest per_owner stay.

    A row's time is its own, else when it was first seen, else now. Of rows of one key in the batch the last by order (a
    column of fresh) counts, without one that with the latest time. One full outer join and one window over the owner.
    """
    place = F.col(order) if order else F.coalesce(F.col(time), now)
    fresh = last_wins(fresh.withColumn("_place", place), key, "_place").drop("_place").select(*fresh.columns)
    fields = [c for c in fresh.columns if c not in (key, "first_seen_at", "last_seen_at")]
    old = before.select(F.col(key).alias("_k"), F.struct(*fields).alias("_old"), "first_seen_at", "last_seen_at")
    new = fresh.select(key, F.struct(*fields).alias("_new"))
    joined = new.join(old, F.col(key) == F.col("_k"), "full_outer")
    rows = joined.select(F.coalesce(key, "_k").alias(key), F.coalesce("_new", "_old").alias("_r"), F.coalesce("first_seen_at", now).alias("first_seen_at"),
                         F.when(F.col("_new").isNotNull(), now).otherwise(F.col("last_seen_at")).alias("last_seen_at")).select(key, "_r.*", "first_seen_at", "last_seen_at")
    if owners is not None:
        rows = rows.join(owners.select(owner), owner, "left_semi").select(key, *fields, "first_seen_at", "last_seen_at")
    at = F.coalesce(F.col(time), F.col("first_seen_at"), now)
    if keep_days is not None:
        rows = rows.where(at >= now - F.make_dt_interval(F.lit(keep_days)))
    if per_owner is not None:
        w = Window.partitionBy(owner).orderBy(at.desc(), F.coalesce(F.col(title), F.lit("")).desc(), key)
        rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_owner).drop("_rn")
    return rows


def changed_rows(before: DataFrame, now: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of now that are new or differ in a tracked field, with is_new."""
    old = before.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    differs = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_o_{f}")) for f in fields])
    joined = now.join(old, F.col(key) == F.col("_k"), "left")
    return joined.where(F.col("_k").isNull() | differs).select(*now.columns, F.col("_k").isNull().alias("is_new"))


def removed_keys(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    return before.select(key).join(now.select(key), key, "left_anti")


def merge_works(before: DataFrame, fresh: DataFrame, now: Column, enriched: list[str], keep_years: int | None = None) -> DataFrame:
    """Works after a batch: matched by any identity key, in key order; a match keeps its old id and first_seen_at, and
    blank enrichment of the fresh row takes the old value; unmatched old works stay; works before the cutoff year go.

    Both: id, keys, year, first_seen_at, last_seen_at and the enriched texts.
    """
    numbered = before.withColumn("ordinal", F.col("id"))
    match = first_key_match(fresh, numbered, "id", "id").select(F.col("id").alias("_f"), "match")
    old = before.select(F.col("id").alias("_old_id"), F.col("first_seen_at").alias("_seen"), *[F.col(e).alias(f"_old_{e}") for e in enriched])
    f = fresh.join(match, F.col("id") == F.col("_f")).join(old, F.col("match") == F.col("_old_id"), "left")
    merged = f.select(F.coalesce("_old_id", "id").alias("id"), "keys", "year", F.coalesce("_seen", now).alias("first_seen_at"), now.alias("last_seen_at"),
                      *[F.coalesce(F.nullif(F.col(e), F.lit("")), F.col(f"_old_{e}"), F.lit("")).alias(e) for e in enriched])
    rest = before.join(match.select(F.col("match").alias("id")).where("id is not null"), "id", "left_anti").select(*merged.columns)
    out = merged.unionByName(rest)
    return out if keep_years is None else out.where(F.col("year") >= F.year(now) - keep_years)


def outage_ratio(health: DataFrame, unchanged: DataFrame, key: str = "id") -> DataFrame:
    """One row: failing ids among the unchanged ones over all unchanged ones."""
    bad = health.where(F.col("status").isin("blocked", "error")).select(key).distinct().withColumn("_bad", F.lit(1))
    return unchanged.select(key).distinct().join(bad, key, "left").agg(F.count("*").alias("n"), F.count("_bad").alias("failing")).select(
        "n", "failing", F.when(F.col("n") == 0, 0.0).otherwise(F.col("failing") / F.col("n")).alias("ratio"))


def split_index(works: DataFrame, heavy: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """A light index with has_abstract, and details for works that have an abstract or authors."""
    has = F.coalesce(F.col("abstract") != "", F.lit(False))
    return works.select(*[c for c in works.columns if c not in heavy], has.alias("has_abstract")), works.where(
        has | (F.coalesce(F.size("authors"), F.lit(0)) > 0)).select(key, *heavy)


def join_details(index: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """The split's inverse: abstract "" and no authors where a work has no details."""
    kind = dict(details.dtypes)["authors"]
    return index.join(details, key, "left").withColumn("abstract", F.coalesce("abstract", F.lit(""))).withColumn("authors", F.coalesce("authors", F.array().cast(kind))).drop("has_abstract")
