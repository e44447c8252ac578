"""Parsers of the publication services' answers and of feeds."""

import json

from pyspark.sql import functions as F

from tessera.sources import feeds


def answers(spark, *bodies):
    return spark.createDataFrame([(f"p{k}", b) for k, b in enumerate(bodies)], "person string, body string")


def rows(df):
    return [r.asDict() for r in df.orderBy("title").collect()]


def test_europe_pmc(spark):
    found = {"resultList": {"result": [
        {"title": "Snow and <i>ice</i>.", "abstractText": "Cold", "firstPublicationDate": "2021-03-04", "authorString": "Low I, Poe A.", "doi": "10.5555/Ab", "pmid": "11", "journalTitle": "Annals of Snow", "source": "MED"},
        {"title": "Thaw", "pubYear": "2020", "source": "PPR", "doi": "10.5555/t"}]}}
    got = rows(feeds.europe_pmc(answers(spark, json.dumps(found), "not json", None, json.dumps({"resultList": {}})), keep=["person"]))
    assert [r["title"] for r in got] == ["Snow and ice", "Thaw"] and list(got[0]) == ["person", *feeds.RECORD]
    assert (got[0]["published_at"], got[0]["authors"], got[0]["doi"], got[0]["type"], got[0]["person"]) == ("2021-03-04", ["Low I", "Poe A"], "10.5555/ab", "article", "p0")
    assert (got[1]["published_at"], got[1]["type"], got[1]["authors"], got[1]["venue"]) == ("2020-01-01", "preprint", [], "")


def test_crossref(spark):
    found = {"message": {"items": [{"DOI": "10.5555/C", "title": ["Wind"], "container-title": ["bioRxiv"], "type": "posted-content", "issued": {"date-parts": [[2019, 7]]}, "author": [{"given": "Ida", "family": "Low"}, {"family": "Poe"}]},
                                   {"DOI": "10.5555/d", "title": [], "type": "journal-article"}]}}
    got = rows(feeds.crossref(answers(spark, json.dumps(found))))
    assert len(got) == 1 and got[0]["authors"] == ["Ida Low", "Poe"] and got[0]["published_at"] == "2019-07-01"
    assert (got[0]["venue"], got[0]["preprint_server"], got[0]["type"]) == ("", "biorxiv", "preprint")


def test_orcid(spark):
    summary = {"title": {"title": {"value": "Rain"}}, "journal-title": {"value": "Journal of Rain"}, "type": "journal-article", "publication-date": {"year": {"value": "2018"}, "month": {"value": "4"}, "day": None},
               "external-ids": {"external-id": [{"external-id-type": "pmid", "external-id-value": "77"}, {"external-id-type": "doi", "external-id-value": "https://doi.org/10.5555/R"}]}}
    got = rows(feeds.orcid(answers(spark, json.dumps({"group": [{"work-summary": [summary, {**summary, "title": {"title": {"value": "Other"}}}]}, {"work-summary": []}]}))))
    assert len(got) == 1 and (got[0]["title"], got[0]["doi"], got[0]["pmid"], got[0]["published_at"], got[0]["venue"], got[0]["type"]) == ("Rain", "10.5555/r", "77", "2018-04-01", "Journal of Rain", "article")


def test_pubmed(spark):
    found = {"result": {"uids": ["5", "6"], "5": {"title": "Fog.", "fulljournalname": "Mist", "sortpubdate": "2017/02/03 00:00", "authors": [{"name": "Low I"}], "articleids": [{"idtype": "doi", "value": "10.5555/f"}], "pubtype": ["Preprint"]},
                        "6": {"title": "Hail", "fulljournalname": "Mist", "sortpubdate": "2016/01/01 00:00"}}}
    got = rows(feeds.pubmed(answers(spark, json.dumps(found))))
    assert [(r["title"], r["pmid"], r["doi"], r["published_at"], r["url"]) for r in got] == [
        ("Fog", "5", "10.5555/f", "2017-02-03", "https://pubmed.ncbi.nlm.nih.gov/5/"), ("Hail", "6", "", "2016-01-01", "https://pubmed.ncbi.nlm.nih.gov/6/")]


def test_arxiv_and_feeds(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>t</title><entry><id>http://arxiv.org/abs/1902.00077v2</id><title>Dew
 point</title><summary>Wet &amp; cold</summary><published>2019-02-01T00:00:00Z</published><author><name>Ida Low</name></author><author><name>Al Poe</name></author>
<link href="http://arxiv.org/abs/1902.00077v2" rel="alternate"/><link href="http://arxiv.org/pdf/1902.00077v2" rel="related"/></entry></feed>"""
    got = rows(feeds.arxiv(answers(spark, atom)))
    assert len(got) == 1 and (got[0]["title"], got[0]["arxiv_id"], got[0]["type"], got[0]["preprint_server"], got[0]["authors"], got[0]["published_at"]) == (
        "Dew point", "1902.00077", "preprint", "arxiv", ["Ida Low", "Al Poe"], "2019-02-01")
    rss = "<rss version='2.0'><channel><title>News</title><item><title>One</title><link>https://n.example.org/1</link><pubDate>Mon, 01 Jan 2024</pubDate><description>a &lt;b&gt;c&lt;/b&gt;</description></item><item><title>Two</title></item></channel></rss>"
    items = rows(feeds.feed_items(answers(spark, rss, atom, "<broken"), keep=["person"]))
    assert [(r["title"], r["url"], r["summary"], r["person"]) for r in items] == [("Dew point", "http://arxiv.org/abs/1902.00077v2", "Wet & cold", "p1"), ("One", "https://n.example.org/1", "a c", "p0"), ("Two", None, "", "p0")]


def test_long_texts_stay_whole(spark):
    from tessera.sources.feeds import _text

    assert len(spark.range(1).select(_text(F.repeat(F.lit("word "), 2000)).alias("t")).first().t) == 9999
