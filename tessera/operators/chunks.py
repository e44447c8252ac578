"""The retrieval documents: works, researchers, tools and organizations composed into one text each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keywords import top_keywords
from tessera.functions.text import content_hash, sanitize, strip_bio_note

#: Characters of an abstract and of a whole document, authors, topics and newest titles that a document names.
SNIPPET, LIMIT, AUTHORS, TOPICS, NEWEST = 480, 8000, 6, 15, 8


def _line(label: str, value: Column) -> Column:
    """A labelled line; null, which concat_ws leaves out, where there is nothing to say."""
    clean = sanitize(value, LIMIT)
    return F.when(F.coalesce(clean, F.lit("")) != "", F.concat(F.lit(label), clean))


def _list(label: str, values: Column | str, sep: str = ", ") -> Column:
    return _line(label, F.array_join(values, sep))


def _document(rows: DataFrame, kind: str, key: str, title: Column, lines: list[Column], owners: Column, groups: Column) -> DataFrame:
    text = F.left(F.concat_ws("\n", _line("", title), *lines), F.lit(LIMIT))
    none = F.array().cast("array<string>")
    return rows.select(F.concat(F.lit(kind[0] + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), sanitize(title, LIMIT).alias("title"), text.alias("body"),
                       content_hash(text).alias("hash"), F.coalesce(owners, none).alias("owner_ids"), F.coalesce(groups, none).alias("group_ids"))


def work_documents(works: DataFrame) -> DataFrame:
    """works: id, title, venue, year, keywords, abstract, authors, person_ids, group_ids."""
    when = F.concat_ws(", ", F.nullif("venue", F.lit("")), F.col("year").cast("string"))
    return _document(works, "work", "id", F.col("title"), [
        _line("", when), _list("Keywords: ", "keywords"), _line("", F.left(sanitize("abstract", LIMIT), F.lit(SNIPPET))), _list("Authors: ", F.slice("authors", 1, AUTHORS))],
        F.col("person_ids"), F.col("group_ids"))


def researcher_documents(people: DataFrame, works: DataFrame) -> DataFrame:
    """A person's profile, and what their works say of them: the most frequent topics and the newest titles.

    people: id, full_name, role, center, bio, expertise, group_ids. A bio's closing note that it was generated stays out.
    Of a person only the newest titles reach the list: the window's rank is filtered before anything is collected.
    """
    mine = works.select(F.explode("person_ids").alias("_p"), "title", "year", F.concat_ws(" ", "title", F.array_join("keywords", " ")).alias("said"), F.col("id").alias("_w"))
    topics = top_keywords(mine, "_p", "said", TOPICS).select(F.col("_p").alias("_t"), F.col("keywords").alias("_topics"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.coalesce("year", F.lit(0)).desc(), "title", "_w"))
    newest = mine.withColumn("_n", place).where(F.col("_n") <= NEWEST).groupBy(F.col("_p").alias("_r")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda x: x["title"]).alias("_titles"))
    rows = people.join(topics, F.col("id") == F.col("_t"), "left").join(newest, F.col("id") == F.col("_r"), "left")
    return _document(rows, "researcher", "id", F.col("full_name"), [
        _line("", F.concat_ws(", ", F.nullif("role", F.lit("")), F.nullif("center", F.lit("")))), _line("", strip_bio_note("bio")), _list("Expertise: ", "expertise"),
        _list("Topics: ", "_topics"), _list("Recent work: ", "_titles", "; ")], F.array(F.col("id").cast("string")), F.col("group_ids"))


def tool_documents(tools: DataFrame) -> DataFrame:
    """tools: id, name, category, status, center, summary, keywords, person_ids, group_ids."""
    return _document(tools, "tool", "id", F.col("name"), [
        _line("", F.concat_ws(", ", F.nullif("category", F.lit("")), F.nullif("status", F.lit("")))), _line("", F.col("center")), _line("", F.col("summary")), _list("Keywords: ", "keywords")],
        F.col("person_ids"), F.col("group_ids"))


def organization_documents(organizations: DataFrame) -> DataFrame:
    """organizations: id, name, acronym, summary, focus_areas, keywords."""
    name = F.concat(F.col("name"), F.when(F.coalesce("acronym", F.lit("")) != "", F.concat(F.lit(" ("), "acronym", F.lit(")"))).otherwise(""))
    return _document(organizations, "organization", "id", name, [_line("", F.col("summary")), _list("Focus: ", "focus_areas"), _list("Keywords: ", "keywords")],
                     F.array().cast("array<string>"), F.array(F.col("id").cast("string")))


def build_chunks(organizations: DataFrame, people: DataFrame, tools: DataFrame, works: DataFrame) -> DataFrame:
    """id, kind, title, body, hash, owner_ids, group_ids of all four kinds, by id."""
    return reduce(DataFrame.unionByName, [organization_documents(organizations), researcher_documents(people, works), tool_documents(tools), work_documents(works)]).orderBy("id")
