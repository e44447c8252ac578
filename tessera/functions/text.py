"""Scalar functions over names, identifiers, URLs, search texts and vectors, as Column expressions.

Only what Spark's functions can't say (Unicode decomposition, URL resolution, IP networks) is a pandas UDF.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- names

@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, then only ASCII is left."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def norm_name(c: Column | str) -> Column:
    """Folded to ASCII, lower case, letters and single spaces only. Texts that are ASCII already don't go to Python."""
    folded = F.coalesce(ascii_fold(F.when(_col(c).rlike(r"[^\x00-\x7F]"), _col(c))), _col(c))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded), "[^a-z ]+", " "), " +", " "))


#: A text up to the first ASCII character after an ASCII letter that is no letter itself: folding can't join a word across it.
_FIRST_WORD = r"^[^A-Za-z]*+[A-Za-z][A-Za-z[^\x00-\x7F]]*+[\x00-\x7F&&[^A-Za-z]]"


def outer_words(c: Column | str) -> Column:
    """What the first and the last word of a text's normalised name come from: name_key() of it is that of the text.

    Folding takes each character for itself, so both ends may be cut where a word surely ends. A text whose two ends
    overlap, or that has no such place, stays whole.
    """
    text = _col(c)
    head, tail = F.regexp_extract(text, _FIRST_WORD, 0), F.reverse(F.regexp_extract(F.reverse(text), _FIRST_WORD, 0))
    apart = (head != "") & (tail != "") & (F.length(head) + F.length(tail) <= F.length(text) + 1)
    return F.when(apart, F.concat(head, tail)).otherwise(text)


def slug(c: Column | str, default: str = "unassigned") -> Column:
    """The words of the normalised name joined by hyphens; digits and signs go. default where nothing is left."""
    made = F.replace(norm_name(c), F.lit(" "), F.lit("-"))
    return F.when(F.coalesce(made, F.lit("")) == "", F.lit(default)).otherwise(made)


def person_slug(last: Column | str, first: Column | str, prefix: str = "t") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.replace(F.concat(norm_name(last), F.lit(" "), norm_name(first)), F.lit(" "), F.lit("-")))


#: Words of a name in ASCII letters, apostrophes and hyphens.
_NAME_WORD = "([A-Za-z'-]+)"


def given_name(c: Column | str) -> Column:
    """The first word of two characters or more, hyphens and apostrophes inside: no initial. Empty without one."""
    return _given(ascii_fold(_col(c)))


def _given(folded: Column) -> Column:
    words = F.regexp_extract_all(folded, F.lit(_NAME_WORD), 1)
    return F.coalesce(F.try_element_at(F.filter(words, lambda x: F.length(x) >= 2), F.lit(1)), F.lit(""))


def name_key(c: Column | str) -> Column:
    """struct(first, last): the outer tokens of the normalised name; null where there are fewer than two."""
    parts = F.split(norm_name(c), " ")
    return F.when(F.size(parts) >= 2, F.struct(F.element_at(parts, 1).alias("first"), F.element_at(parts, -1).alias("last")))


def names_match(a: Column | str, b: Column | str) -> Column:
    """The first and the last word agree, initials left out. Letters outside a-z don't count; one word may be both."""
    def ends(c: Column | str) -> Column:
        words = F.filter(F.split(F.regexp_replace(F.lower(_col(c)), "[^a-z ]", ""), " "), lambda w: F.length(w) > 1)
        return F.when(F.size(words) > 0, F.struct(F.get(words, F.lit(0)).alias("first"), F.element_at(words, -1).alias("last")))
    return F.coalesce(ends(a) == ends(b), F.lit(False))


# Degrees that a search leaves out where they follow a comma.
DEGREES = ("PhD", "MD", "MBA", "MPH", "MS", "DPhil", "BDS", "DrPH", "ScD", "PharmD", "RN")


def search_name(c: Column | str) -> Column:
    """A name without the degrees that follow a comma and without what is in parentheses. "Smith, John" stays."""
    bare = F.regexp_replace(_col(c), rf",\s*(?:{'|'.join(DEGREES)})\b\.?", "")
    return F.btrim(F.trim(F.regexp_replace(F.regexp_replace(bare, r"\([^)]*\)", ""), r"\s+", " ")), F.lit(","))


def author_term(c: Column | str) -> Column:
    """Surname and initials of the part before the first comma: "Hopper GB"; "" for an empty name."""
    words = F.regexp_extract_all(F.substring_index(_col(c), ",", 1), F.lit(r"(?U)([\w'-]+)"), 1)
    initials = F.array_join(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.size(words) == 0, "").otherwise(F.trim(F.concat_ws(" ", F.element_at(words, -1), initials)))


def _scoped(author: Column, affiliations: list[str]) -> Column:
    """author AND (affiliation OR ...); the author alone where there is no affiliation."""
    places = " OR ".join(f'"{a.strip()}"[Affiliation]' for a in affiliations if a.strip())
    return F.concat(author, F.lit(f" AND ({places})")) if places else author


def pubmed_query(name: Column | str, affiliations: list[str]) -> Column:
    """The author's term, scoped to the affiliations; empty for an empty name."""
    who = author_term(name)
    return F.when(who == "", "").otherwise(_scoped(F.concat(F.lit('"'), who, F.lit('"[Author]')), affiliations))


def full_name_query(last: Column | str, names: Column | str, affiliations: list[str]) -> Column:
    """Full-author terms for the given name of each element of an array (the first name, then others that a person
    publishes under), with and without more after it; repeats in other case go; the surname alone without a given name."""
    surname = F.array_join(F.regexp_extract_all(ascii_fold(_col(last)), F.lit(_NAME_WORD), 1), " ")
    # The names go through the folding function as one text.
    folded = F.split(ascii_fold(F.array_join(F.transform(_col(names), lambda n: F.regexp_replace(n, "\n", " ")), "\n")), "\n")
    given = F.filter(F.transform(folded, _given), lambda n: n != "")
    kept = F.aggregate(given, F.array().cast("array<string>"), lambda acc, n: F.when(F.exists(acc, lambda m: F.lower(m) == F.lower(n)), acc).otherwise(F.concat(acc, F.array(n))))
    whole = F.when(F.size(kept) > 0, F.zip_with(F.array_repeat(surname, F.size(kept)), kept, lambda s, n: F.concat(s, F.lit(", "), n))).otherwise(F.array(surname))
    terms = F.transform(whole, lambda n: F.concat(F.lit('"'), n, F.lit('"[Full Author Name] OR "'), n, F.lit(' *"[Full Author Name]')))
    return _scoped(F.concat(F.lit("("), F.array_join(terms, " OR "), F.lit(")")), affiliations)


# -- URLs and identifiers

def profile_url(base: str, host: str):
    """A UDF: an https URL on the host or below, resolved against base, without parameters and fragment; else ""."""
    @F.pandas_udf(T.StringType())
    def resolve(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str:
            u = urlsplit(urljoin(base, x or ""))
            name = (u.hostname or "").lower()
            if u.scheme != "https" or not (name == host or name.endswith("." + host)):
                return ""
            return urlunsplit((u.scheme, u.netloc, u.path.split(";")[0], u.query, ""))
        return s.map(one)
    return resolve


def person_id_from_url(url: Column | str) -> Column:
    """u-number from the profile path, else from the physicianID parameter, in lower case; empty without one."""
    path = F.regexp_extract(F.try_parse_url(_col(url), F.lit("PATH")), r"(?i)/mddetail/(u\d+)/?$", 1)
    query = F.regexp_extract(F.try_parse_url(_col(url), F.lit("QUERY"), F.lit("physicianID")), r"(?i)^(u\d+)$", 1)
    return F.lower(F.coalesce(F.nullif(path, F.lit("")), query, F.lit("")))


def orcid_id(c: Column | str) -> Column:
    return F.nullif(F.upper(F.regexp_extract(_col(c), r"(?i)(\d{4}-\d{4}-\d{4}-\d{3}[\dx])", 1)), F.lit(""))


def doi(c: Column | str) -> Column:
    """Bare lower-case DOI, "" for what isn't one."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(_col(c))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d+/\S+)$", 1), F.lit(""))


def arxiv_id(c: Column | str) -> Column:
    """Bare arXiv id without version, from an id, URL or DOI form, legacy ids too; "" for the rest."""
    x = F.regexp_replace(F.trim(_col(c)), r"(?i)^(?:https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/|(?:https?://doi\.org/)?10\.48550/arxiv\.|arxiv:\s*)", "")
    return F.coalesce(F.regexp_extract(x, r"^(\d{4}\.\d{4,5}|[a-zA-Z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?$", 1), F.lit(""))


# Venues that are preprint servers.
PREPRINT_SERVERS = ("arxiv", "biorxiv", "medrxiv", "research square", "ssrn", "preprints.org", "chemrxiv", "psyarxiv")


def preprint_server(venue: Column | str) -> Column:
    """The server that a venue names, in lower case, else ""."""
    low = F.lower(_col(venue))
    found = F.filter(F.array(*map(F.lit, PREPRINT_SERVERS)), lambda s: F.contains(low, s))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def work_type(kind: Column | str, venue: Column | str) -> Column:
    """A journal venue makes a record an article even where its type says preprint."""
    server = preprint_server(venue)
    return F.when((F.coalesce(_col(venue), F.lit("")) != "") & (server == ""), "article").when((server != "") | (F.lower(_col(kind)) == "preprint"), "preprint").otherwise("article")


#: Letters and numbers of Unicode 14 and 15. Java 17 takes them for unassigned; a JVM that knows them finds none here.
_NEW_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3 A7D5-A7D9 A7F2-A7F4 10570-1057A 1057C-1058A "
    "1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 10780-10785 10787-107B0 107B2-107BA 10F70-10F81 11071-11072 11075 "
    "1123F-11240 11740-11746 11AB0-11ABF 11F02 11F04-11F10 11F12-11F33 11F50-11F59 12F90-12FF0 1342F 13441-13446 16A70-16ABE 16AC0-16AC9 "
    "1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1D2C0-1D2D3 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB "
    "1E4F0-1E4F9 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 31350-323AF"
)
_BETWEEN_WORDS = r"[^\p{L}\p{N}[\p{Cn}&&[" + "".join("-".join(rf"\x{{{x}}}" for x in span.split("-")) for span in _NEW_LETTERS.split()) + "]]]+"


def title_key(c: Column | str) -> Column:
    """Letters and numbers of a title in lower case, single spaces for the rest; "" where there are none.

    Each character is lowered for itself, so that a word's key doesn't hang on what follows: lower() makes a final sigma of
    its own and two characters of a dotted I. Two capitals newer than Unicode 15 whose small letters are older count as no letters.
    """
    text = _col(c)
    alone = F.when(text.rlike("[\u0130\u03a3\ua7cb\ua7dc]"), F.translate(text, "\u0130\u03a3\ua7cb\ua7dc", "i\u03c3  ")).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(alone), _BETWEEN_WORDS, " "))


def work_keys(doi_col: str = "doi", pmid: str = "pmid", arxiv: str = "arxiv_id", title: str = "title") -> Column:
    """Identity keys in order: DOI, PMID, arXiv id; the folded title only where there is none of them. An empty title is no key."""
    def key(prefix: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), value))
    ids = F.filter(F.array(key("doi:", doi(doi_col)), key("pmid:", F.trim(_col(pmid))), key("arxiv:", arxiv_id(arxiv))), lambda x: x.isNotNull())
    return F.when(F.size(ids) > 0, ids).otherwise(F.filter(F.array(F.concat(F.lit("title:"), title_key(title))), lambda x: x != "title:"))


def parse_ids(c: Column | str) -> Column:
    """Ids from a list with commas or spaces: lower case, in order, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(c)), r"[\s,]+"), lambda x: x != ""))


def expand_handle(c: Column | str, prefix: str) -> Column:
    """A bare id or handle as a URL; URLs stay."""
    bare = F.regexp_replace(F.trim(_col(c)), "^@", "")
    return F.when(bare == "", "").when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit(prefix), bare))


# -- hashes

def item_id(*parts: Column | str, length: int = 20) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by |; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def content_hash(c: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha2(_col(c), 256), 1, length)


def question_key(question: Column | str, version: str) -> Column:
    """Cache key of a question: case and spacing don't matter, the index version does."""
    squeezed = F.lower(F.trim(F.regexp_replace(_col(question), r"\s+", " ")))
    return F.substring(F.sha2(F.concat(squeezed, F.lit("|" + version)), 256), 1, 40)


# -- times and texts

def record_time(*fields: Column | str, fallback: Column | None = None) -> Column:
    """The first field that parses as a timestamp (without zone: session zone), else the fallback."""
    return F.coalesce(*[F.try_to_timestamp(_col(f)) for f in fields], *([fallback] if fallback is not None else []))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9][a-z0-9-]*)"), 1)


def fold_plural(t: Column) -> Column:
    """Our rule: -ies to -y, -sses/-shes/-ches/-xes lose es, other -s goes unless after s, u or i; short words stay."""
    return (F.when(F.length(t) <= 3, t)
            .when(t.rlike("ies$") & (F.length(t) > 4), F.concat(F.regexp_replace(t, "ies$", ""), F.lit("y")))
            .when(t.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(t, "es$", ""))
            .when(t.rlike("[^sui]s$"), F.regexp_replace(t, "s$", "")).otherwise(t))


def query_terms(c: Column | str) -> Column:
    return F.array_distinct(F.transform(tokens(c), fold_plural))


# English stop words of the keyword extractor.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def sanitize(c: Column | str, limit: int | None = 2000) -> Column:
    """No tags, angle brackets, control or format characters; single spaces; at most limit characters (None: all)."""
    plain = F.regexp_replace(F.regexp_replace(_col(c), "<[^>]*>", " "), r"[<>]|[\p{Cc}\p{Cf}&&[^\s]]", "")
    clean = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return clean if limit is None else F.left(clean, F.lit(limit))


def attribute(c: Column | str, limit: int = 200) -> Column:
    return F.replace(sanitize(c, limit), F.lit('"'), F.lit("'"))


def strip_bio_note(c: Column | str) -> Column:
    """Without a closing note that the text was generated."""
    return F.regexp_replace(_col(c), r"(?is)\s*note: this bio was ai-generated\.?\s*$", "")


def search_text(*parts: Column | str) -> Column:
    """Non-blank parts in lower case, one space between."""
    return F.lower(F.concat_ws(" ", *[F.when(F.trim(_col(p)) != "", _col(p)) for p in parts]))


def non_blank(c: Column | str) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def is_https(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"^https://[A-Za-z0-9.-]+(?:[/?#].*)?$"), F.lit(False))


def is_colour(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"^#[0-9a-fA-F]{6}$"), F.lit(False))


def is_slug(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.lit(False))


def sse_frame(event: str, payload: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(payload), F.lit("\n\n"))


def parse_sse(stream: Column | str) -> Column:
    """array of (event, data) of the complete frames of a stream."""
    frames = F.filter(F.slice(F.split(_col(stream), "\n\n"), 1, F.greatest(F.size(F.split(_col(stream), "\n\n")) - 1, F.lit(0))), lambda f: f != "")
    return F.transform(frames, lambda f: F.struct(F.regexp_extract(f, r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract(f, r"(?m)^data: (.*)$", 1).alias("data")))


def hint_hits(blob: Column | str, hints: list[str]) -> Column:
    """The hints that a text contains."""
    low = F.lower(_col(blob))
    return F.filter(F.array(*map(F.lit, hints)), lambda h: F.contains(low, F.lower(h)))


# -- numbers

def l2_normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    x = _col(v)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")))
    # The norm as a variable of an outer lambda: inside the inner one it would be summed again for each component.
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(x, lambda a: F.when(n == 0, F.lit(0.0)).otherwise(a.cast("double") / n))), 1)


def quantize(v: Column | str, scale: int = 127) -> Column:
    """Unit vector as int8 steps."""
    return F.transform(l2_normalize(v), lambda a: F.greatest(F.lit(-scale), F.least(F.lit(scale), F.round(a * scale).cast("int"))).cast("tinyint"))


def dequantize(v: Column | str, scale: int = 127) -> Column:
    return F.transform(_col(v), lambda a: a.cast("double") / scale)


def node_size(n: Column, low: Column, high: Column, smallest: float = 3.0, largest: float = 12.0) -> Column:
    """Cube-root scale between the least (at most 1) and the most."""
    lo, hi = F.cbrt(F.least(F.lit(1.0), low)), F.cbrt(high)
    return F.lit(smallest) + F.lit(largest - smallest) * (F.cbrt(n) - lo) / F.greatest(hi - lo, F.lit(1e-9))


def edge_width(weight: Column | str) -> Column:
    return F.least(F.lit(7.0), F.lit(1.0) + F.lit(0.9) * F.sqrt(_col(weight)))


# -- addresses

def client_address(trusted: list[str]):
    """A UDF on X-Forwarded-For chains: from the right, the first hop outside the trusted networks; all trusted: the leftmost."""
    nets = [ipaddress.ip_network(n) for n in trusted]

    def inside(hop: str) -> bool:
        try:
            return any(ipaddress.ip_address(hop) in n for n in nets)
        except ValueError:
            return False

    @F.pandas_udf(T.StringType())
    def pick(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            hops = [h for h in re.split(r"[\s,]+", x or "") if h]
            return next((h for h in reversed(hops) if not inside(h)), hops[0] if hops else None)
        return s.map(one)
    return pick


def hash_address(c: Column | str, salt: str) -> Column:
    """Salted: the address itself is never stored."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), _col(c)), 256), 1, 32)
