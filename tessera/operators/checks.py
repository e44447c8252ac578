"""Data contracts as violation queries: each check returns the rows that break it; an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.session import dealt


class ContractError(ValueError):
    """A contract is broken."""


def enforce(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raises with a few of the rows if there are any."""
    rows = violations.limit(shown).collect()
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def failing(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule for each rule (a condition that must hold) that a row fails; null fails."""
    checks = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(checks).alias("rule"))


def gated(rows: DataFrame, key: str, rules: dict[str, Column], refs: dict[str, tuple[str, DataFrame, str]] | None = None) -> tuple[DataFrame, Observation]:
    """rows as they are, and an observation that fills while an action runs over them: broken_rules() reads it.

    rules: conditions that must hold; null fails. refs: {rule: (column, dimension, its key)}, values (nulls are none) that
    the dimension must have. The dimension's distinct keys meet the rows in a left join of the same plan, so writing
    the rows is the only job. Metrics come from the tasks that write: a retried stage before them counts nothing twice.
    """
    bad = {name: ~F.coalesce(ok, F.lit(False)) for name, ok in rules.items()}
    out = rows
    for k, (name, (column, dimension, dim_key)) in enumerate((refs or {}).items()):
        keys = dimension.select(F.col(dim_key).alias(f"_ref{k}"), F.lit(True).alias(f"_known{k}")).distinct()
        out = out.join(keys, F.col(column) == F.col(f"_ref{k}"), "left")
        bad[name] = F.col(column).isNotNull() & F.col(f"_known{k}").isNull()
    seen = Observation()
    metrics = [F.count("*").alias("rows")]
    for k, (name, broken) in enumerate(bad.items()):
        metrics += [F.count_if(broken).alias(f"n{k}:{name}"), F.min(F.when(broken, F.col(key).cast("string"))).alias(f"k{k}:{name}")]
    return out.observe(seen, *metrics).select(*[F.col(f"`{c}`") for c in rows.columns]), seen


def broken_rules(seen: Observation) -> dict[str, tuple[int, str | None]]:
    """{rule: (rows that break it, the smallest key of these)} of a finished action."""
    got = seen.get
    return {name[name.index(":") + 1:]: (n, got["k" + name[1:]]) for name, n in got.items() if name[0] == "n" and ":" in name and n}


def repeated(rows: DataFrame, *keys: Column | str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_refs(rows: DataFrame, key: str, dimension: DataFrame, dim_key: str) -> DataFrame:
    """Distinct keys that the dimension doesn't have."""
    return rows.select(F.col(key).alias("key")).where("key is not null").distinct().join(dimension.select(F.col(dim_key).alias("key")), "key", "left_anti")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")


def graph_violations(edges: DataFrame, nodes: DataFrame, ordered_only: bool = False, tasks: int | None = None) -> DataFrame:
    """rule, src, dst: self-loops, pairs that are there twice (in either order unless ordered_only), weight below 1, unknown ends.

    One pass tells all rules of an edge: its ends meet the distinct nodes in left joins that hash the nodes and stream the
    edges. Repeated pairs are an aggregate of their own, of so many tasks (session.tasks_for).
    """
    a, b = ("src", "dst") if ordered_only else (F.least("src", "dst"), F.greatest("src", "dst"))
    twice = dealt(edges.select(F.col(a).alias("src") if ordered_only else a.alias("src"), F.col(b).alias("dst") if ordered_only else b.alias("dst")), tasks, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")
    ids = nodes.select("node").distinct()
    known = lambda end: ids.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}")).hint("shuffle_hash")
    met = edges.join(known("src"), "src", "left").join(known("dst"), "dst", "left")
    rules = {"self_loop": F.expr("src = dst"), "weight": ~(F.coalesce("weight", F.lit(0)) >= 1), "unknown_src": F.col("_src").isNull(), "unknown_dst": F.col("_dst").isNull()}
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return met.select(F.explode(broken).alias("rule"), "src", "dst").unionByName(twice.select(F.lit("duplicate").alias("rule"), "src", "dst"))


def layout_violations(points: DataFrame, bound: float = 1.001) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) <= bound)
    return points.where(~(ok("x") & ok("y")))


def drop_guard(before: DataFrame, now: DataFrame, group: str, most: float = 0.25, least: int = 1) -> DataFrame:
    """grp, n_before, n_now for groups (and "*", all rows) that shrank by more than the share or fell below the least count.

    group: a column, or an array of the groups that a row is in; "*" counts a row once either way.
    """
    def counts(df: DataFrame, name: str) -> DataFrame:
        each = df.select(F.explode(group).alias("g")) if dict(df.dtypes)[group].startswith("array") else df.select(F.col(group).alias("g"))
        return each.groupBy(F.col("g").cast("string").alias("grp")).agg(F.count("*").alias(name)).unionByName(df.agg(F.count("*").alias(name)).select(F.lit("*").alias("grp"), name))
    both = counts(before, "n_before").join(counts(now, "n_now"), "grp", "full_outer").select("grp", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_now", F.lit(0)).alias("n_now"))
    return both.where((F.col("n_now") < F.col("n_before") * (1 - most)) | ((F.col("grp") == "*") & (F.col("n_now") < least)))


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one snapshot that the other doesn't have as often, with side."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("side", F.lit("left")).unionByName(b.select(*cols).exceptAll(a).withColumn("side", F.lit("right")))


def attribution(works: DataFrame, people: DataFrame) -> DataFrame:
    """work_id, extra: divisions of a work that none of its people has. works: work_id, person_ids, division_ids. people: person_id, division_ids."""
    theirs = works.select("work_id", F.explode("person_ids").alias("person_id")).join(people.select("person_id", F.explode("division_ids").alias("d")), "person_id").groupBy("work_id").agg(F.collect_set("d").alias("allowed"))
    extra = F.array_except("division_ids", F.coalesce("allowed", F.array().cast("array<string>")))
    return works.join(theirs, "work_id", "left").select("work_id", F.array_sort(extra).alias("extra")).where(F.size("extra") > 0)


def provenance(meta: DataFrame, sources: DataFrame) -> DataFrame:
    """Derived documents whose recorded source time isn't the source's. meta: document, source, source_time. sources: source, generated_at."""
    return meta.join(sources, "source", "left").where(~F.col("source_time").eqNullSafe(F.col("generated_at"))).select("document", "source", "source_time", "generated_at")


def health_covers(health: DataFrame, divisions: DataFrame, key: str = "division_id") -> DataFrame:
    """Divisions without exactly one health row, rows of unknown divisions, and rows that aren't ok."""
    rows = health.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("bad"))
    return divisions.select(key, F.lit(True).alias("_known")).join(rows, key, "full_outer").where(
        F.col("_known").isNull() | (F.coalesce("n", F.lit(0)) != 1) | (F.coalesce("bad", F.lit(0)) > 0)).select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))


def staleness(searched: DataFrame, published: DataFrame) -> DataFrame:
    """key, stale: the search is older (by date) than the publications. Both: key, at (ISO text)."""
    return searched.select("key", F.col("at").alias("a")).join(published.select("key", F.col("at").alias("b")), "key").select(
        "key", (F.to_date(F.substring("a", 1, 10)) < F.to_date(F.substring("b", 1, 10))).alias("stale"))


def needs_contact(targets: DataFrame, contact: str | None) -> DataFrame:
    """Targets that would query PubMed while no contact address is set."""
    return targets.where(F.lit(not (contact or "").strip()) & (F.coalesce("pubmed_query", F.lit("")) != ""))


def directory_violations(people: DataFrame, divisions: DataFrame, url_prefix: str = "https://") -> DataFrame:
    """key, rule: blank names, repeated ids, unknown or no divisions, profile URLs elsewhere."""
    rows = failing(people, "id", {"id": F.trim("id") != "", "full_name": F.trim("full_name") != "", "divisions": F.size("division_ids") > 0,
                                  "profile_url": F.startswith("profile_url", F.lit(url_prefix))})
    twice = repeated(people, "id").select(F.col("id").alias("key"), F.lit("repeated").alias("rule"))
    unknown = missing_refs(people.select(F.explode("division_ids").alias("d")), "d", divisions, "id").select("key", F.lit("unknown_division").alias("rule"))
    return rows.unionByName(twice).unionByName(unknown)


def publication_violations(works: DataFrame, details: DataFrame, people: DataFrame) -> DataFrame:
    """key, rule: blank titles, repeated works, unknown people, details without a work."""
    rows = failing(works, "id", {"id": F.trim("id") != "", "title": F.trim("title") != ""})
    twice = repeated(works, "id").select(F.col("id").alias("key"), F.lit("repeated").alias("rule"))
    who = missing_refs(works.select(F.explode("person_ids").alias("p")), "p", people, "id").select("key", F.lit("unknown_person").alias("rule"))
    orphan = missing_refs(details, "id", works, "id").select("key", F.lit("details_only").alias("rule"))
    return rows.unionByName(twice).unionByName(who).unionByName(orphan)


def stats_mismatch(stats: DataFrame, actual: DataFrame) -> DataFrame:
    """One-row tables whose common columns differ: the stated and the counted numbers."""
    names = [c for c in stats.columns if c in actual.columns]
    return stats.select(*names).exceptAll(actual.select(*names))
