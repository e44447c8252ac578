"""Entity resolution: ordered identity keys, unique name matches, overlays, carry-forward and record merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import name_key, outer_words
from tessera.operators.graph import connected, number_rows


def first_key_match(probe: DataFrame, build: DataFrame, probe_id: str, build_id: str, keys: str = "keys", ordinal: str = "ordinal") -> DataFrame:
    """probe_id, match: for each probe row the build row of its first key that is known (null without one).

    Keys are ordered arrays. Where build rows share a key, the one with the highest ordinal has it.
    """
    owner = build.select(F.explode(keys).alias("k"), build_id, ordinal).groupBy("k").agg(F.max_by(build_id, ordinal).alias("match"))
    tried = probe.select(probe_id, F.posexplode(keys).alias("pos", "k")).join(owner, "k")
    return probe.select(probe_id).join(tried.groupBy(probe_id).agg(F.min_by("match", "pos").alias("match")), probe_id, "left")


def unique_name_match(probe: DataFrame, people: DataFrame, probe_id: str, person_id: str, name: str = "name") -> DataFrame:
    """probe_id, match: the one person with the same first and last name token; null for none or several.

    The people are aggregated to (count, least id) before the join, so a common name is no large list. Of a long name its
    outer words alone are folded.
    """
    known = people.select(outer_words(name).alias("_name"), person_id).select(name_key("_name").alias("k"), person_id).where(F.col("k").isNotNull()).groupBy("k").agg(
        F.count_distinct(person_id).alias("n"), F.min(person_id).alias("id"))
    one = known.where("n = 1").select("k", F.col("id").alias("match"))
    return probe.select(probe_id, outer_words(name).alias("_name")).select(probe_id, name_key("_name").alias("k")).join(one, "k", "left").select(probe_id, "match")


def overlay(base: DataFrame, changes: DataFrame, key: str, fields: list[str], has: str = "has_") -> DataFrame:
    """base with the fields that changes has: has_<field> says a field is present, so a blank one clears."""
    c = changes.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_new_{f}") for f in fields], *[F.col(has + f).alias(f"_has_{f}") for f in fields])
    cols = [F.when(F.coalesce(f"_has_{f}", F.lit(False)), F.col(f"_new_{f}")).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in base.columns]
    return base.join(c, F.col(key) == F.col("_k"), "left").select(*cols)


def unknown_overrides(changes: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Overrides of ids that the base doesn't have: an error if there are any."""
    return changes.join(base.select(key), key, "left_anti").select(key)


def carry_forward(now: DataFrame, before: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Blank fields take the previous value, else stay empty."""
    p = before.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    return now.join(p, F.col(key) == F.col("_k"), "left").select(
        *[F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_old_{f}"), F.lit("")).alias(f) if f in fields else F.col(f) for f in now.columns])


def replace_by_key(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of fresh replace those of base with their key; the others stay."""
    fields = [c for c in base.columns if c != key]
    f = fresh.select(F.col(key).alias("_k"), F.struct(*fields).alias("_new"))
    row = F.coalesce("_new", F.struct(*fields))
    return base.join(f, F.col(key) == F.col("_k"), "left").select(key, row.alias("_row")).select(key, "_row.*")


def union_membership(cards: DataFrame, key: str, ordinal: str, scalars: list[str], array: str) -> DataFrame:
    """One row for each key: scalars from the last card, the array as union in order of first appearance."""
    union = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, array))), lambda x: x[array])))
    return cards.groupBy(key).agg(*[F.max_by(s, ordinal).alias(s) for s in scalars], union.alias(array))


def last_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), ordinal).alias("_r")).select(key, "_r.*")


def preserve_fields(fresh: DataFrame, old: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Hand-edited fields of the old rows survive a regeneration, matched on several columns."""
    o = old.select(*[F.col(k).alias(f"_k_{k}") for k in on], *[F.col(f).alias(f"_old_{f}") for f in fields])
    cond = None
    for k in on:
        c = F.col(k) == F.col(f"_k_{k}")
        cond = c if cond is None else cond & c
    return fresh.join(o, cond, "left").select(*[F.coalesce(f"_old_{f}", f).alias(f) if f in fields else F.col(f) for f in fresh.columns])


def date_rank(c: Column | str) -> Column:
    """How precise a date is: 2 for a day, 1 for the first of January or of a month that was padded, 0 for none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"-01-01$") | (F.length(c) < 10), 1).otherwise(2)


def merge_records(records: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One record for each identity: the more precise date, the longer author list, non-blank texts, sources in order."""
    def text(f: str) -> Column:
        return F.coalesce(F.min_by(f, F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col(ordinal))), F.lit("")).alias(f)
    sources = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, "sources"))), lambda x: x["sources"])))
    return records.groupBy(key).agg(
        text("title"), text("abstract"), F.max_by("published_at", F.struct(date_rank("published_at"), -F.col(ordinal))).alias("published_at"),
        F.max_by("authors", F.struct(F.size("authors"), -F.col(ordinal))).alias("authors"), sources.alias("sources"))


def identity_classes(works: DataFrame, work_id: str = "work_id", keys: str = "keys") -> DataFrame:
    """work_id, identity (least work_id): works that share a key, directly or over others. Goes beyond the reference."""
    bridge = works.select(F.col(work_id).alias("w"), F.explode(keys).alias("k"))
    hub = bridge.groupBy("k").agg(F.min("w").alias("hub"))
    found = connected(bridge.join(hub, "k").select(F.col("w").alias("src"), F.col("hub").alias("dst")))
    return works.select(work_id).join(found, F.col(work_id) == F.col("node"), "left").select(work_id, F.coalesce("component", work_id).alias("identity"))


def collapse_people(trainees: DataFrame, faculty: DataFrame) -> DataFrame:
    """node, kind (both, faculty, trainee), groups: a trainee with a faculty_id is that person. Groups in order, each once.

    trainees: id, faculty_id, group_id. faculty: id, division_ids.
    """
    t = trainees.select(F.coalesce("faculty_id", "id").alias("node"), F.col("group_id")).groupBy("node").agg(F.array_sort(F.collect_set("group_id")).alias("tg"))
    f = faculty.select(F.col("id").alias("node"), F.col("division_ids").alias("fg"))
    none = F.array().cast("array<string>")
    return f.join(t, "node", "full_outer").select(
        "node", F.when(F.col("fg").isNotNull() & F.col("tg").isNotNull(), "both").when(F.col("fg").isNotNull(), "faculty").otherwise("trainee").alias("kind"),
        F.array_distinct(F.concat(F.coalesce("fg", none), F.coalesce("tg", none))).alias("groups"))


def ordinals(rows: DataFrame, parent: str, array: str) -> DataFrame:
    """One row for each array element with its 1-based ordinal."""
    return rows.select(parent, F.posexplode(array).alias("_p", "item")).select(parent, (F.col("_p") + 1).alias("ordinal"), "item")


def dense_index(items: DataFrame, key: str) -> DataFrame:
    """key, idx (from 0) of the distinct keys in order."""
    return number_rows(items.select(key).distinct(), key, name="idx")
