"""Snapshots and refreshes: directory from cards and profiles, targeted refreshes, gates and the staged commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import pubmed_query
from tessera.operators import checks, entity, history, views
from tessera.sources import sinks

TRACKED = ["full_name", "pubmed_query", "orcid", "division_ids"]


def directory_snapshot(cards: DataFrame, profiles: DataFrame, overrides: DataFrame, previous: DataFrame | None, affiliations: list[str], fields: list[str]) -> DataFrame:
    """People from all divisions' cards: one row per id, divisions united in order, the last card's scalars; texts of
    the profile, else of the run before; overrides last; then the query.

    cards: id, ordinal, full_name, title, profile_url, division_ids. profiles: id, bio, academic, orcid.
    """
    people = entity.union_membership(cards, "id", "ordinal", ["full_name", "title", "profile_url"], "division_ids").join(profiles, "id", "left")
    if previous is not None:
        people = entity.carry_forward(people, previous, "id", ["bio", "academic", "orcid"])
    people = people.withColumn("pubmed_query", pubmed_query("full_name", affiliations))
    checks.enforce(entity.unknown_overrides(overrides, people, "id"), "overrides of unknown ids")
    return entity.overlay(people, overrides, "id", fields)


def division_health(cards: DataFrame, divisions: DataFrame) -> DataFrame:
    """division_id, status, count: ok with cards, error without, partial where some card is incomplete.

    cards: division_id, complete.
    """
    counts = cards.groupBy("division_id").agg(F.count("*").alias("n"), F.count_if(~F.col("complete")).alias("bad"))
    return divisions.select("division_id").join(counts, "division_id", "left").select(
        "division_id", F.when(F.coalesce("n", F.lit(0)) == 0, "error").when(F.col("bad") > 0, "partial").otherwise("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("count"))


def health_log(*logs: DataFrame) -> DataFrame:
    """All health rows, with columns that only some have."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def targeted_refresh(people: DataFrame, ids: DataFrame, fresh: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """Refreshed rows of the ids, editorial fields reset to what was read and overlaid again; the others as they were."""
    checks.enforce(ids.join(people.select("id"), "id", "left_anti"), "unknown ids")
    own = entity.overlay(fresh.join(ids.select("id"), "id", "left_semi"), overrides, "id", fields)
    return entity.replace_by_key(people, own, "id")


def refresh_targets(before: DataFrame, now: DataFrame, tracked: list[str] | None = None) -> DataFrame:
    """Ids whose publications must be searched again: new or changed, and eligible."""
    return views.eligible(history.changed_rows(before, now, "id", tracked or TRACKED)).select("id")


def refresh_gates(before: DataFrame, now: DataFrame, targets: DataFrame, health: DataFrame, group: str, most_failing: float = 0.1) -> None:
    """Raises where the directory shrank too much, a target's search failed, or too many others fail."""
    checks.enforce(checks.drop_guard(before, now, group), "the directory shrank")
    checks.enforce(views.needs_attention(health, targets), "searches of changed people failed")
    rest = now.select("id").join(targets, "id", "left_anti")
    checks.enforce(history.outage_ratio(health, rest).where(F.col("ratio") > most_failing), "a source is down")


def refresh(root: str, before: DataFrame, now: DataFrame, health: DataFrame, documents: dict[str, DataFrame], contracts: dict, group: str = "division_ids", gates: dict | None = None) -> str:
    """Gates on the change first, then everything is staged, checked (rules of rows while they are written) and published at once; returns the batch's path."""
    refresh_gates(before, now, refresh_targets(before, now), health, group)
    return sinks.staged_commit(root, {"people": now, **documents}, contracts, gates)


def trainee_directory(roster: DataFrame, faculty: DataFrame, person_id: Column) -> DataFrame:
    """roster with id and the one faculty_id of the same name. roster: name and the columns of person_id."""
    rows = roster.withColumn("id", person_id)
    match = entity.unique_name_match(rows, faculty.select(F.col("id").alias("faculty_id"), F.col("full_name").alias("name")), "id", "faculty_id")
    return rows.join(match.withColumnRenamed("match", "faculty_id"), "id", "left")
