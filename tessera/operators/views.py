"""Filtered views, lookups, summaries and top lists over people, works and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import both_ways


def keyword_match(search: str, query: str) -> Column:
    """Case-folded substring; a blank query lets all pass."""
    q = query.strip().lower()
    return F.contains(F.col(search), F.lit(q)) if q else F.lit(True)


def people_view(people: DataFrame, division: str = "", query: str = "", divisions: str = "division_ids", search: str = "search_text") -> DataFrame:
    """People of a division (blank: all) whose search text holds the query."""
    kept = people.where(keyword_match(search, query))
    return kept.where(F.array_contains(divisions, division)) if division else kept


def works_view(works: DataFrame, division: str = "", person: str = "", query: str = "") -> DataFrame:
    kept = people_view(works, division, query)
    return kept.where(F.array_contains("person_ids", person)) if person else kept


def cross_search(tables: dict[str, tuple[DataFrame, str, str]], query: str) -> DataFrame:
    """kind, id, label over several tables: {kind: (rows with search_text, id column, label column)}."""
    out = None
    for kind, (rows, key, label) in tables.items():
        part = rows.where(keyword_match("search_text", query)).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(label).cast("string").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def with_label(rows: DataFrame, key: str, dimension: DataFrame, dim_key: str, label: str, fallback: str = "Unknown") -> DataFrame:
    """rows with the dimension's label, the fallback where the key is unknown."""
    dim = dimension.select(F.col(dim_key).alias("_k"), F.col(label).alias("_l"))
    return rows.join(dim, F.col(key) == F.col("_k"), "left").withColumn("label", F.coalesce("_l", F.lit(fallback))).drop("_k", "_l")


def first_of_array(rows: DataFrame, array: str, dimension: DataFrame, dim_key: str) -> DataFrame:
    """Inner join to a dimension on the first array element."""
    return rows.join(dimension, F.try_element_at(F.col(array), F.lit(1)) == dimension[dim_key])


def soft_flags(nodes: DataFrame, division: str = "", query: str = "") -> DataFrame:
    """nodes with dim (outside the division) and found (name holds the query) instead of filtering."""
    dim = ~F.array_contains("groups", division) if division else F.lit(False)
    q = query.strip().lower()
    return nodes.withColumn("dim", dim).withColumn("found", F.contains(F.lower("name"), F.lit(q)) if q else F.lit(False))


def eligible(people: DataFrame, flag: str = "collect_publications") -> DataFrame:
    return people.where(F.coalesce(flag, F.lit(True)))


def needs_attention(health: DataFrame, targets: DataFrame, statuses: tuple[str, ...] = ("blocked", "error"), key: str = "id") -> DataFrame:
    """Health rows of target ids with a bad status."""
    return health.where(F.col("status").isin(*statuses)).join(targets.select(key), key, "left_semi")


def citable(works: DataFrame, fields: tuple[str, ...] = ("doi", "pmid", "arxiv_id", "url")) -> DataFrame:
    return works.where(F.greatest(*[F.when(F.trim(f) != "", 1).otherwise(0) for f in fields]) == 1)


def top_edges(edges: DataFrame, n: int = 25) -> DataFrame:
    """The heaviest edges; ties by endpoints. Takes the top of each partition before it gathers."""
    return edges.orderBy(F.col("weight").desc(), "src", "dst").limit(n)


def ego(edges: DataFrame, node) -> DataFrame:
    """Partners of a node with weight; the filter reaches both branches of the union."""
    return both_ways(edges, "weight", "first_year", "last_year").where(F.col("node") == node).select("other", "weight", "first_year", "last_year")


def works_of(bridge: DataFrame, person, names: DataFrame, limit: int = 100, shown: int = 5) -> DataFrame:
    """work_id, year, title, partners of one person's works, newest first, at most limit (a view's page).

    bridge: work_id, person_id, year, title. names: person_id, name. partners: the first names, "+N more" after.
    """
    mine = bridge.where(F.col("person_id") == person).select("work_id", "year", "title").distinct().orderBy(
        F.coalesce("year", F.lit(0)).desc(), "title", "work_id").limit(limit)
    others = bridge.where(F.col("person_id") != person).select("work_id", "person_id").distinct().join(F.broadcast(mine.select("work_id")), "work_id")
    listed = others.join(names, "person_id").groupBy("work_id").agg(F.array_sort(F.collect_list("name")).alias("n"))
    text = F.concat(F.array_join(F.slice("n", 1, shown), ", "), F.when(F.size("n") > shown, F.concat(F.lit(" +"), (F.size("n") - shown).cast("string"), F.lit(" more"))).otherwise(""))
    return mine.join(listed, "work_id", "left").select("work_id", "year", "title", F.coalesce(text, F.lit("")).alias("partners"))


def names_text(bridge: DataFrame, names: DataFrame) -> DataFrame:
    """work_id, people: the names of a work's people, sorted and joined."""
    return bridge.join(names, "person_id").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("people"))


def zero_filled_counts(dimension: DataFrame, key: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """key, n for every dimension row."""
    counts = facts.groupBy(F.col(fact_key).alias("_k")).agg(F.count("*").alias("n"))
    return dimension.join(counts, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def membership_counts(nodes: DataFrame, groups: str = "groups") -> DataFrame:
    """grp, n: a node counts in each of its groups."""
    return nodes.select(F.explode(F.array_distinct(groups)).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


def program_summary(roster: DataFrame, program: str, has_works: str) -> DataFrame:
    """program, roster, with_works; the largest first, then by name."""
    return roster.groupBy(F.col(program).alias("program")).agg(F.count("*").alias("roster"), F.count_if(has_works).alias("with_works")).orderBy(F.col("roster").desc(), "program")


def graph_stats(nodes: DataFrame, edges: DataFrame, bridge: DataFrame, group_of: DataFrame) -> DataFrame:
    """One row: nodes, edges, cross_group_edges, shared_works (works with more than one surviving person).

    nodes: node. group_of: node, grp. bridge: work_id, person_id.
    """
    g = group_of.select("node", "grp").hint("shuffle_hash")  # the nodes are hashed, so the edges need no sort
    crossed = edges.join(g.toDF("src", "g1"), "src").join(g.toDF("dst", "g2"), "dst").agg(
        F.count("*").alias("edges"), F.count_if(F.col("g1") != F.col("g2")).alias("cross_group_edges"))
    shared = bridge.join(nodes.select(F.col("node").alias("person_id")), "person_id", "left_semi").groupBy("work_id").agg(
        F.count_distinct("person_id").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared_works"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(crossed).crossJoin(shared)  # three one-row tables


def capped_count(counts: DataFrame, cap: int, n: str = "n") -> DataFrame:
    return counts.agg(F.count_if((F.lit(cap) > 0) & (F.col(n) >= cap)).alias("capped"))


def newest_years(works: DataFrame, steps: int = 5) -> DataFrame:
    """One row: newest year (0 without) and the years of the menu, two apart."""
    newest = F.coalesce(F.max("year"), F.lit(0))
    return works.agg(newest.alias("newest")).select("newest", F.sequence(F.col("newest"), F.col("newest") - 2 * steps, F.lit(-2)).alias("menu"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0).otherwise(F.round(F.lit(100.0) * part / whole)).cast("long")


def top_per_group(rows: DataFrame, group: str, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each group; end the order with a unique column."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


#: A person's works are cut down in so many parts first.
PARTS = 16


def newest_per_person(bridge: DataFrame, n: int, tasks: int | None = None) -> DataFrame:
    """work_id of works that some person of theirs has among the newest n.

    With tasks (session.tasks_for) the rows are dealt by person and part of their works to so many, where each part
    keeps its newest n; what is left is PARTS * n rows a person at most.
    """
    order = [F.coalesce("year", F.lit(0)).desc(), "work_id"]
    rows = bridge.select("work_id", "person_id", "year").distinct()
    if tasks:
        parts = rows.withColumn("_part", F.pmod(F.xxhash64("work_id"), F.lit(PARTS))).repartition(tasks, "person_id", "_part")
        rows = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("person_id", "_part").orderBy(*order))).where(F.col("_rn") <= n).select(*rows.columns)
    w = Window.partitionBy("person_id").orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).select("work_id").distinct()


def palette(items: DataFrame, key: str, colours: list[str]) -> DataFrame:
    """key, colour by the ordinal of the sorted keys of a dimension, round and round."""
    n = F.row_number().over(Window.orderBy(key))
    return items.select(key).distinct().select(key, F.element_at(F.array(*map(F.lit, colours)), F.pmod(n - 1, F.lit(len(colours))) + 1).alias("colour"))


def citation_numbers(answer: Column, markers: Column) -> Column:
    """array of (marker, number) in order of first appearance in the answer; markers that don't appear are left out."""
    places = F.array_sort(F.filter(F.transform(markers, lambda m: F.struct(F.instr(answer, m).alias("at"), m.alias("marker"))), lambda p: p["at"] > 0))
    return F.transform(places, lambda p, i: F.struct(p["marker"].alias("marker"), (i + 1).alias("number")))


def budgeted_take(items: Column, budget: int, stop_at_first: bool = False) -> Column:
    """Greedy take of texts, in order, within a total length: too long ones are skipped, or end the take."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["done"] & (acc["used"] + F.length(x) <= budget)
        return F.struct(F.when(fits, acc["used"] + F.length(x)).otherwise(acc["used"]).alias("used"),
                        F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
                        (acc["done"] | (~fits & F.lit(stop_at_first))).alias("done"))
    return F.aggregate(items, start, step)["kept"]


def fixed_projection(rows: DataFrame, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """A fixed schema with defaults: {column: (type, default)}; columns that the rows lack are all default."""
    def one(name: str, kind: str, default: object) -> Column:
        value = F.lit(default).cast(kind) if not isinstance(default, list) else F.array(*map(F.lit, default)).cast(kind)
        return (F.coalesce(F.col(name).cast(kind), value) if name in rows.columns else value).alias(name)
    return rows.select(*[one(n, *f) for n, f in fields.items()])


def fill_nested(array: Column, defaults: dict[str, str]) -> Column:
    """An array of structs with these text fields, blank or missing ones filled."""
    return F.transform(array, lambda x: F.struct(*[F.coalesce(F.nullif(x[f], F.lit("")), F.lit(d)).alias(f) for f, d in defaults.items()]))


def nested_totals(organizations: DataFrame, arrays: list[str]) -> DataFrame:
    """One row: how many elements each nested array has over all rows."""
    return organizations.agg(*[F.coalesce(F.sum(F.greatest(F.size(F.coalesce(a, F.array().cast(dict(organizations.dtypes)[a]))), F.lit(0))), F.lit(0)).alias(a) for a in arrays])


def work_stats(works: DataFrame, health: DataFrame) -> DataFrame:
    """One row: works, preprints, with_abstract, people_with_works, sources_attention."""
    base = works.agg(F.count("*").alias("works"), F.count_if(F.col("type") == "preprint").alias("preprints"), F.count_if("has_abstract").alias("with_abstract"))
    who = works.select(F.explode("person_ids").alias("p")).agg(F.count_distinct("p").alias("people_with_works"))
    return base.crossJoin(who).crossJoin(health.agg(F.count_if(F.col("status") != "ok").alias("sources_attention")))  # one-row tables


def view_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: people by kind, edges, and the share of trainees in whole per cent."""
    n = nodes.agg(F.count("*").alias("people"), F.count_if(F.col("kind") == "faculty").alias("faculty"), F.count_if(F.col("kind") == "trainee").alias("trainees"), F.count_if(F.col("kind") == "both").alias("both"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges"))).withColumn("trainee_share", share(F.col("trainees"), F.col("people")))
