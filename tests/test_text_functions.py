"""Names, identifiers, keys, hashes and vectors."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("f", "value", "want"), [
    (T.norm_name, "  José  Núñez-Ortiz, MD ", "jose nunez ortiz md"),
    (T.slug, "Ärzte & Pflege 24!", "arzte-pflege"),
    (T.slug, "24", "unassigned"),
    (T.given_name, "J. Ann", "Ann"),
    (T.given_name, "J.", ""),
    (T.given_name, "M. Jo-Lou O'Hara", "Jo-Lou"),
    (T.doi, "HTTPS://DX.DOI.ORG/10.5555/Some.Name", "10.5555/some.name"),
    (T.doi, "  doi:10.7777/x(1)y ", "10.7777/x(1)y"),
    (T.doi, "11.5555/z", ""),
    (T.doi, None, ""),
    (T.arxiv_id, "ARXIV: 1312.00042v11", "1312.00042"),
    (T.arxiv_id, "http://www.arxiv.org/pdf/0905.1234v1.pdf", "0905.1234"),
    (T.arxiv_id, "https://doi.org/10.48550/ARXIV.2210.11111", "2210.11111"),
    (T.arxiv_id, "math.GT/0309136v2", "math.GT/0309136"),
    (T.arxiv_id, "10.5555/2210.11111", ""),
    (T.orcid_id, "https://orcid.org/0000-0002-1825-009x", "0000-0002-1825-009X"),
    (T.person_id_from_url, "https://h.example.edu/fad/mddetail/U0012345/", "u0012345"),
    (T.person_id_from_url, "https://h.example.edu/find?physicianID=u77&x=1", "u77"),
    (T.person_id_from_url, "https://h.example.edu/other", ""),
    (T.search_name, "Mei (Mimi) Tan, MD, PhD", "Mei Tan"),
    (T.search_name, "Ortiz, Paula, RN.", "Ortiz, Paula"),
    (T.author_term, "Grace B Hopper, PhD", "Hopper GB"),
    (T.author_term, "", ""),
    (T.strip_bio_note, "A life.\nNote: This bio was AI-generated.", "A life."),
    (T.sanitize, "<b>a</b>  b\u0000c <script", "a bc script"),
    (T.preprint_server, "bioRxiv (Cold Spring)", "biorxiv"),
])
def test_strings(spark, f, value, want):
    assert one(spark, value, f) == want


def test_queries(spark):
    q = one(spark, "Grace B Hopper", lambda c: T.pubmed_query(c, ["Example Clinic ", " "]))
    assert q == '"Hopper GB"[Author] AND ("Example Clinic"[Affiliation])'
    assert one(spark, "Grace B Hopper", lambda c: T.pubmed_query(c, [])) == '"Hopper GB"[Author]'
    assert one(spark, "", lambda c: T.pubmed_query(c, ["X"])) == ""
    full = one(spark, ["K. Zoë Ann", "ZOE", "Sam"], lambda c: T.full_name_query(F.lit("Van Äke"), c, ["C"]), "array<string>")
    assert full == '("Van Ake, Zoe"[Full Author Name] OR "Van Ake, Zoe *"[Full Author Name] OR "Van Ake, Sam"[Full Author Name] OR "Van Ake, Sam *"[Full Author Name]) AND ("C"[Affiliation])'
    assert one(spark, ["K."], lambda c: T.full_name_query(F.lit("Poe"), c, []), "array<string>") == '("Poe"[Full Author Name] OR "Poe *"[Full Author Name])'


@pytest.mark.parametrize(("a", "b", "want"), [("Ida M. Wells", "ida wells", True), ("Wells", "wells", True), ("J Li", "Jo Li", False), ("Li", "Jo Li", False), ("", "", False), (None, "a b", False), ("Zoë Kay", "Zo Kay", True)])
def test_names_match(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.names_match("a", "b").alias("y")).first()["y"] is want


def test_work_keys(spark):
    df = spark.createDataFrame([("10.1/AB", "12", "arXiv:2401.12345v2", "T"), ("", None, "", "A Title: here!"), (None, " 7 ", None, "x")], "doi string, pmid string, arxiv_id string, title string")
    assert [r["k"] for r in df.select(T.work_keys().alias("k")).collect()] == [["doi:10.1/ab", "pmid:12", "arxiv:2401.12345"], ["title:a title here"], ["pmid:7"]]


def test_types_ids_and_terms(spark):
    assert one(spark, "U0012345, u0076543 u0012345", T.parse_ids) == ["u0012345", "u0076543"]
    df = spark.createDataFrame([("preprint", "medRxiv"), ("preprint", "Nature"), ("article", "")], "t string, v string")
    assert [r["k"] for r in df.select(T.work_type("t", "v").alias("k")).collect()] == ["preprint", "article", "article"]
    assert one(spark, "Studies of GLASSES, boxes; virus is bus outbreaks outbreak", T.query_terms) == ["study", "of", "glass", "box", "virus", "is", "bus", "outbreak"]
    url = T.profile_url("https://dept.example.edu/a/", "example.edu")
    df = spark.createDataFrame([("../p/x?y=1#z",), ("http://dept.example.edu/",), ("https://evil.test/",), ("https://m.example.edu/q;s=1",)], "u string")
    assert [r["o"] for r in df.select(url("u").alias("o")).collect()] == ["https://dept.example.edu/p/x?y=1", "", "", "https://m.example.edu/q"]


def test_hashes(spark):
    assert one(spark, "b", lambda c: T.item_id(F.lit("a"), c, F.lit(None).cast("string"))) == hashlib.sha256(b"a|b|").hexdigest()[:20]
    assert one(spark, "192.0.2.7", lambda c: T.hash_address(c, "salt")) == hashlib.sha256(b"salt:192.0.2.7").hexdigest()[:32]
    assert one(spark, "  What  IS it ", lambda c: T.question_key(c, "v1")) == hashlib.sha256(b"what is it|v1").hexdigest()[:40]


def test_vectors(spark):
    assert one(spark, [0.0, 0.0], T.l2_normalize, "array<float>") == [0.0, 0.0]
    assert one(spark, [3.0, -4.0], T.quantize, "array<float>") == [76, -102]
    back = one(spark, [0.6, 0.8], lambda c: T.dequantize(T.quantize(c)), "array<double>")
    assert abs(sum(a * b for a, b in zip(back, [0.6, 0.8], strict=True)) - 1) < 0.01


def test_addresses_and_events(spark):
    pick = T.client_address(["10.0.0.0/8", "2001:db8::/32"])
    df = spark.createDataFrame([("1.2.3.4, 10.0.0.1",), ("10.0.0.2, 10.0.0.1",), ("9.9.9.9, 1.2.3.4",), ("",)], "x string")
    assert [r["o"] for r in df.select(pick("x").alias("o")).collect()] == ["1.2.3.4", "10.0.0.2", "1.2.3.4", None]
    frames = spark.range(1).select(F.concat(T.sse_frame("meta", F.struct(F.lit(1).alias("a"))), T.sse_frame("done", F.struct(F.lit("x").alias("b"))), F.lit("event: cut\nda")).alias("s"))
    assert [(e["event"], e["data"]) for e in frames.select(T.parse_sse("s").alias("e")).first()["e"]] == [("meta", '{"a":1}'), ("done", '{"b":"x"}')]


def test_outer_words_have_the_key_of_the_text(spark):
    """The ends of a text that go to the folding function give the whole text's key, and are short for a long text."""
    import random
    some = random.Random(5)
    signs = ["a", "B", "é", "ﬁ", "½", "中", " ", "  ", "-", "'", "3", "\n", "́", " ", "Å", "😀", "Ω", "o'b", "x y"]
    texts = [None, "", " ", "ab", "ab ", " ab", "a b", "é b", "中 文", "½ab½", "Ana\nde la Cruz", "éa b", "a bé", "中a b中", " a "] + ["".join(some.choices(signs, k=some.randrange(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.outer_words("t").alias("o"))
    got = df.select("t", "o", T.name_key("t").alias("a"), T.name_key("o").alias("b")).collect()
    assert [r["t"] for r in got if r["a"] != r["b"]] == [] and sum(r["a"] is not None for r in got) > 500
    long = spark.createDataFrame([("José " + "ñandú word " * 50_000 + "Núñez",)], "t string").select(T.outer_words("t").alias("o")).first()["o"]
    assert len(long) < 40
