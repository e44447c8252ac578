"""Records from the answers of public publication services and from feeds, parsed by Spark's JSON and XML functions.

Each parser takes a table with one answer a row and gives one row a record; an answer that can't be parsed, or holds
nothing, gives none. Fetching is the caller's (see documents.collect): these are pure functions of what was fetched.
Formats are the services' public ones: Europe PMC search (JSON), Crossref works (JSON), ORCID works (JSON), PubMed
summaries (JSON), arXiv queries (Atom), and RSS 2.0 and Atom feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import arxiv_id, doi, preprint_server, sanitize, work_type

#: Columns of a record, in order.
RECORD = ["title", "abstract", "published_at", "authors", "doi", "pmid", "arxiv_id", "venue", "preprint_server", "type", "url", "source"]


def _text(c: Column) -> Column:
    return F.coalesce(sanitize(c, None), F.lit(""))


def _date(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """An ISO date; months and days that aren't known are 01; empty without a year."""
    part = lambda c: F.lpad(F.coalesce(c.cast("int").cast("string"), F.lit("1")), 2, "0") if c is not None else F.lit("01")
    return F.when(year.cast("int").isNull(), "").otherwise(F.concat_ws("-", year.cast("int").cast("string"), part(month), part(day)))


def _record(rows: DataFrame, source: str, keep: list[str], title: Column, abstract: Column, published: Column, authors: Column, doi_: Column, pmid: Column, arxiv: Column, venue: Column,
            kind: Column, url: Column) -> DataFrame:
    own = F.coalesce(F.nullif(arxiv_id(arxiv), F.lit("")), arxiv_id(doi_))
    place = _text(venue)
    server = F.when(F.coalesce(own, F.lit("")) != "", "arxiv").otherwise(preprint_server(place))
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    names = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), _text), lambda a: a != "")
    return rows.select(*keep, _text(title).alias("title"), _text(abstract).alias("abstract"), blank(published).alias("published_at"), names.alias("authors"), doi(doi_).alias("doi"), blank(pmid).alias("pmid"),
                       F.coalesce(own, F.lit("")).alias("arxiv_id"), F.when(preprint_server(place) != "", "").otherwise(place).alias("venue"), server.alias("preprint_server"),
                       F.when((server != "") & ((place == "") | (preprint_server(place) != "")), "preprint").otherwise(work_type(kind, place)).alias("type"), blank(url).alias("url"), F.lit(source).alias("source")).where(F.col("title") != "")


def _each(answers: DataFrame, body: str, schema: str, items: str, keep: list[str]) -> DataFrame:
    """keep, x: one row for each element of an array in the JSON answers."""
    return answers.select(*keep, F.from_json(body, schema).alias("_a")).select(*keep, F.explode(f"_a.{items}").alias("x"))


def europe_pmc(answers: DataFrame, body: str = "body", keep: list[str] = ()) -> DataFrame:
    keep = list(keep)
    item = "title:string,abstractText:string,firstPublicationDate:string,pubYear:string,authorString:string,doi:string,pmid:string,journalTitle:string,pubType:string,source:string"
    rows = _each(answers, body, f"resultList struct<result:array<struct<{item}>>>", "resultList.result", keep)
    x = lambda f: F.col(f"x.{f}")
    when = F.coalesce(x("firstPublicationDate"), _date(x("pubYear")))
    authors = F.split(F.regexp_replace(F.coalesce(x("authorString"), F.lit("")), r"\.\s*$", ""), r",\s*")
    kind = F.when((x("source") == "PPR") | F.contains(F.lower(x("pubType")), F.lit("preprint")), "preprint").otherwise("article")
    return _record(rows, "europepmc", keep, F.regexp_replace(x("title"), r"\.$", ""), x("abstractText"), when, authors, x("doi"), x("pmid"), F.lit(""), F.coalesce(x("journalTitle"), F.lit("")), kind,
                   F.when(x("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), x("doi"))))


def crossref(answers: DataFrame, body: str = "body", keep: list[str] = ()) -> DataFrame:
    keep = list(keep)
    item = "DOI:string,title:array<string>,`container-title`:array<string>,abstract:string,type:string,URL:string,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string>>"
    rows = _each(answers, body, f"message struct<items:array<struct<{item}>>>", "message.items", keep)
    parts = F.get(F.col("x.issued.`date-parts`"), F.lit(0))
    names = F.transform("x.author", lambda a: F.concat_ws(" ", a["given"], a["family"]))
    return _record(rows, "crossref", keep, F.get("x.title", F.lit(0)), F.col("x.abstract"), _date(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))), names, F.col("x.DOI"), F.lit(""), F.lit(""),
                   F.coalesce(F.get("x.`container-title`", F.lit(0)), F.lit("")), F.when(F.col("x.type") == "posted-content", "preprint").otherwise("article"), F.col("x.URL"))


def orcid(answers: DataFrame, body: str = "body", keep: list[str] = ()) -> DataFrame:
    """The first summary of each group of a person's works."""
    keep = list(keep)
    value = "struct<value:string>"
    item = (f"title:struct<title:{value}>,`journal-title`:{value},type:string,url:{value},`publication-date`:struct<year:{value},month:{value},day:{value}>,"
            "`external-ids`:struct<`external-id`:array<struct<`external-id-type`:string,`external-id-value`:string>>>")
    rows = _each(answers, body, f"group array<struct<`work-summary`:array<struct<{item}>>>>", "group", keep).select(*keep, F.get("x.`work-summary`", F.lit(0)).alias("x")).where("x is not null")
    ids = F.col("x.`external-ids`.`external-id`")
    one = lambda kind: F.coalesce(F.get(F.filter(ids, lambda e: e["external-id-type"] == kind), F.lit(0))["external-id-value"], F.lit(""))
    when = F.col("x.`publication-date`")
    return _record(rows, "orcid", keep, F.col("x.title.title.value"), F.lit(""), _date(when["year"]["value"], when["month"]["value"], when["day"]["value"]), F.array().cast("array<string>"), one("doi"), one("pmid"), one("arxiv"),
                   F.coalesce(F.col("x.`journal-title`.value"), F.lit("")), F.col("x.type"), F.col("x.url.value"))


def pubmed(answers: DataFrame, body: str = "body", keep: list[str] = ()) -> DataFrame:
    """Summaries: {result: {uids: [...], "<uid>": {...}}}; a map of the entries' own text, so any number of uids fits."""
    keep = list(keep)
    entries = answers.select(*keep, F.from_json(F.get_json_object(body, "$.result"), "map<string,string>").alias("m")).select(*keep, F.explode("m").alias("uid", "text")).where("uid <> 'uids'")
    item = "title string, fulljournalname string, pubdate string, sortpubdate string, authors array<struct<name:string>>, articleids array<struct<idtype:string,value:string>>, pubtype array<string>"
    rows = entries.select(*keep, "uid", F.from_json("text", item).alias("x"))
    found = F.coalesce(F.get(F.filter("x.articleids", lambda e: e["idtype"] == "doi"), F.lit(0))["value"], F.lit(""))
    day = F.regexp_replace(F.substring("x.sortpubdate", 1, 10), "/", "-")
    kind = F.when(F.exists("x.pubtype", lambda t: F.lower(t) == "preprint"), "preprint").otherwise("article")
    return _record(rows, "pubmed", keep, F.regexp_replace("x.title", r"\.$", ""), F.lit(""), day, F.transform("x.authors", lambda a: a["name"]), found, F.col("uid"), F.lit(""), F.coalesce("x.fulljournalname", F.lit("")), kind,
                   F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "uid", F.lit("/")))


_LINK = "array<struct<_href:string,_rel:string>>"


def _xml(answers: DataFrame, body: str, schema: str, items: str, keep: list[str]) -> DataFrame:
    return answers.select(*keep, F.from_xml(F.col(body), schema, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("_a")).select(*keep, F.explode(f"_a.{items}").alias("x"))


def arxiv(answers: DataFrame, body: str = "body", keep: list[str] = ()) -> DataFrame:
    keep = list(keep)
    rows = _xml(answers, body, "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,doi:string,journal_ref:string>>", "entry", keep)
    return _record(rows, "arxiv", keep, F.col("x.title"), F.col("x.summary"), F.substring("x.published", 1, 10), F.transform("x.author", lambda a: a["name"]), F.coalesce("x.doi", F.lit("")), F.lit(""), F.col("x.id"),
                   F.coalesce("x.journal_ref", F.lit("")), F.lit("preprint"), F.col("x.id"))


def feed_items(answers: DataFrame, body: str = "body", keep: list[str] = ()) -> DataFrame:
    """title, url, published_at (the feed's own text), summary of RSS 2.0 items and Atom entries."""
    keep = list(keep)
    rss = _xml(answers, body, "channel struct<item:array<struct<title:string,link:string,pubDate:string,description:string>>>", "channel.item", keep).select(
        *keep, _text(F.col("x.title")).alias("title"), F.trim("x.link").alias("url"), F.col("x.pubDate").alias("published_at"), _text(F.col("x.description")).alias("summary"))
    entries = _xml(answers, body, f"entry array<struct<title:string,link:{_LINK},published:string,updated:string,summary:string>>", "entry", keep)
    link = F.get(F.filter("x.link", lambda a: F.coalesce(a["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    atom = entries.select(*keep, _text(F.col("x.title")).alias("title"), link.alias("url"), F.coalesce("x.published", "x.updated").alias("published_at"), _text(F.col("x.summary")).alias("summary"))
    return rss.unionByName(atom).where(F.coalesce("title", F.lit("")) != "")
