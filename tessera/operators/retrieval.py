"""Hybrid retrieval: chunks, index reuse, BM25, exact dense search, rank fusion and roll-ups to owners and groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, query_terms
from tessera.session import materialize

K1, B = 1.2, 0.75
BRANCH, POOL = 300, 60
RRF = 60


def make_chunks(parts: dict[str, DataFrame], limit: int = 8000) -> DataFrame:
    """id, kind, hash, title, body, owner_ids, group_ids of {kind: rows with key, title, body, owner_ids, group_ids}.

    The id is the kind's first letter and the key; a body has at most limit characters.
    """
    made = [rows.select(F.concat(F.lit(kind[0] + ":"), F.col("key").cast("string")).alias("id"), F.lit(kind).alias("kind"), content_hash(F.left("body", F.lit(limit))).alias("hash"),
                        "title", F.left("body", F.lit(limit)).alias("body"), "owner_ids", "group_ids") for kind, rows in parts.items()]
    return reduce(DataFrame.unionByName, made)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").agg(F.count("*").alias("n"))


def reuse(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """chunks with vector (null where the chunk is new or its hash changed) and reused. previous: id, hash, vector."""
    p = previous.select(F.col("id").alias("_i"), F.col("hash").alias("_h"), "vector")
    return chunks.join(p, (F.col("id") == F.col("_i")) & (F.col("hash") == F.col("_h")), "left").drop("_i", "_h").withColumn("reused", F.col("vector").isNotNull())


def dry_run(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: stale (missing or changed), reused, dropped (no longer there)."""
    now = reuse(chunks.select("id", "hash"), previous.withColumn("vector", F.lit(1))).agg(F.count_if(~F.col("reused")).alias("stale"), F.count_if("reused").alias("reused"))
    gone = previous.select("id").join(chunks.select("id"), "id", "left_anti").agg(F.count("*").alias("dropped"))
    return now.crossJoin(gone)  # two one-row tables


def embed(chunks: DataFrame, embedder: Callable[[list[str], str], list[list[float]]], dims: int, task: str = "RETRIEVAL_DOCUMENT", batch: int = 100, text: str = "body") -> DataFrame:
    """id, vector for chunks without one; wrong dimensions are an error of the job."""
    def run(parts):
        for pdf in parts:
            for k in range(0, len(pdf), batch):
                some = pdf.iloc[k:k + batch]
                got = embedder(some[text].fillna("").tolist(), task)
                if any(len(v) != dims for v in got):
                    raise ValueError("the embedder's vectors have the wrong dimensions")
                yield pd.DataFrame({"id": some["id"].to_numpy(), "vector": got})
    return chunks.select("id", text).mapInPandas(run, "id string, vector array<double>")


def build_index(chunks: DataFrame, previous: DataFrame, embedder, dims: int) -> DataFrame:
    """chunks with vectors: kept where id and hash are unchanged, embedded otherwise; chunks that are gone are dropped."""
    held = reuse(chunks, previous)
    fresh = embed(held.where("vector is null"), embedder, dims).withColumnRenamed("vector", "_v")
    return held.join(fresh, "id", "left").withColumn("vector", F.coalesce("vector", "_v")).drop("_v")


def postings(chunks: DataFrame, key: str = "id", text: str = "body", fold: bool = True, only: DataFrame | None = None) -> DataFrame:
    """key, term, tf, length; with only (column term), of these terms."""
    from tessera.functions.text import fold_plural, tokens
    terms = F.transform(tokens(text), fold_plural) if fold else tokens(text)
    lists = chunks.select(key, terms.alias("_t")).withColumn("length", F.size("_t").cast("long"))
    each = lists.select(key, "length", F.explode("_t").alias("term"))
    if only is not None:
        each = each.join(only.select("term").distinct(), "term", "left_semi")
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def corpus_stats(chunks: DataFrame, text: str = "body", fold: bool = True) -> DataFrame:
    """One row: n, avg_length."""
    from tessera.functions.text import tokens
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(tokens(text)).cast("double")).alias("avg_length"))


def term_frequencies(chunks: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """term, df, cf."""
    return postings(chunks, key, text, fold=False).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass
class LexicalIndex:
    """Stored postings (key, term, tf, length) and statistics (one row), so that a question reads only its terms' rows."""

    postings: DataFrame
    stats: DataFrame


def lexical_index(chunks: DataFrame, key: str = "id", text: str = "body", fold: bool = True) -> LexicalIndex:
    """Tokenises the corpus once and writes what every question needs. Rows are ordered by term, so a question's filter skips files and row groups."""
    lists = postings(chunks, key, text, fold)
    return LexicalIndex(materialize(lists.repartitionByRange("term", key).sortWithinPartitions("term"), "postings"), materialize(corpus_stats(chunks, text, fold), "stats"))


def bm25(chunks: DataFrame | None, terms: list[str], key: str = "id", text: str = "body", top: int = BRANCH, fold: bool = True, index: LexicalIndex | None = None) -> DataFrame:
    """key, score: the best chunks for the distinct terms; terms in more than max(8, 0.15 n) chunks are dropped.

    With a stored index nothing is tokenised. Without one, the query's postings alone are kept, before any shuffle; the
    statistics are one row either way.
    """
    from tessera.functions.text import fold_plural, tokens
    if index is not None:
        stats = index.stats
        hits = index.postings.where(F.col("term").isin(sorted(set(terms)))).select(key, "term", "length", "tf")
    else:
        wanted = F.array(*map(F.lit, sorted(set(terms)))) if terms else F.array().cast("array<string>")
        all_terms = F.transform(tokens(text), fold_plural) if fold else tokens(text)
        lists = chunks.select(key, all_terms.alias("_t"))
        stats = lists.agg(F.count("*").alias("n"), F.avg(F.size("_t").cast("double")).alias("avg_length"))
        hits = lists.select(key, F.size("_t").alias("length"), F.explode(F.filter("_t", lambda t: F.array_contains(wanted, t))).alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).where(F.col("df") <= F.greatest(F.lit(8.0), F.col("n") * 0.15))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return rows.groupBy(key).agg(F.sum(idf * tf).alias("score")).orderBy(F.round("score", 9).desc(), key).limit(top)


def dense(index: DataFrame, query: DataFrame, key: str = "id", vector: str = "vector", top: int | None = BRANCH) -> DataFrame:
    """key, score: exact inner products with a one-row query (column q). top None: all."""
    dot = F.aggregate(F.zip_with(F.col(vector), F.col("q"), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = index.crossJoin(F.broadcast(query.select("q"))).select(key, dot.alias("score"))
    return scored if top is None else scored.orderBy(F.round("score", 9).desc(), key).limit(top)


def spread(scores: DataFrame) -> DataFrame:
    """One row: top, mean, deviation (population), gap, z. Diagnostics only: no score gates an answer."""
    s = scores.agg(F.max("score").alias("top"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))
    return s.select("top", "mean", "deviation", (F.col("top") - F.col("mean")).alias("gap"), F.when(F.col("deviation") > 0, (F.col("top") - F.col("mean")) / F.col("deviation")).otherwise(0.0).alias("z"))


def ranked(scores: DataFrame, key: str) -> DataFrame:
    """key, rank of one branch's (bounded) result."""
    return scores.select(key, F.row_number().over(Window.orderBy(F.round("score", 9).desc(), key)).alias("rank"))


def fuse(branches: list[DataFrame], key: str = "id", k: int = RRF, pool: int = POOL) -> DataFrame:
    """key, score: reciprocal-rank fusion of the branches' results; without a query vector one branch is enough."""
    ranks = reduce(DataFrame.unionByName, [ranked(b, key) for b in branches])
    return ranks.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score")).orderBy(F.round("score", 9).desc(), key).limit(pool)


def roll_up(scored: DataFrame, owner: str, own: DataFrame | None = None, best: int = 3, weight: Column | None = None, key: str = "id") -> DataFrame:
    """owner, score, evidence (ids, best first): the owner's own score and the sum of its best weighted scores over sqrt(rank).

    scored: key, owner, score; every owner of a chunk gets full credit. own: owner, score.
    """
    value = F.col("score") * (weight if weight is not None else F.lit(1.0))
    w = Window.partitionBy(owner).orderBy(F.round("_v", 9).desc(), key)
    top = scored.withColumn("_v", value).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= best)
    sums = top.groupBy(owner).agg(F.sum(F.col("_v") / F.sqrt(F.col("_r").cast("double"))).alias("_s"), F.transform(F.array_sort(F.collect_list(F.struct("_r", key))), lambda x: x[key]).alias("evidence"))
    if own is None:
        return sums.select(owner, F.col("_s").alias("score"), "evidence")
    none = F.array().cast(dict(sums.dtypes)["evidence"])
    return sums.join(own.select(owner, F.col("score").alias("_o")), owner, "full_outer").select(
        owner, (F.coalesce("_s", F.lit(0.0)) + F.coalesce("_o", F.lit(0.0))).alias("score"), F.coalesce("evidence", none).alias("evidence"))


def best_owners(rolled: DataFrame, owner: str, n: int = 5, evidence: int = 2) -> DataFrame:
    """The n best owners with their first pieces of evidence."""
    return rolled.orderBy(F.round("score", 9).desc(), owner).limit(n).withColumn("evidence", F.slice("evidence", 1, evidence))


def citable_documents(parts: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """kind, id, title, url over {kind: (rows, id, title, url)}."""
    return reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), F.col(t).alias("title"), F.col(u).alias("url")) for kind, (rows, i, t, u) in parts.items()])


def search_terms(question: Column) -> Column:
    return query_terms(question)


def prompt_block(kind: str, title: Column, body: Column, limit: int = 1200) -> Column:
    from tessera.functions.text import attribute, sanitize
    return F.concat(F.lit(f'<{kind} title="'), attribute(title), F.lit('">\n'), sanitize(body, limit), F.lit(f"\n</{kind}>"))


def search(chunks: DataFrame, question_terms: list[str], query: DataFrame | None = None, people: int = 5, groups: int = 3, tools: int = 3, index: LexicalIndex | None = None) -> dict[str, DataFrame]:
    """The whole retrieval: both branches (the lexical one alone without a query vector), fusion, people with evidence,
    tools and groups. chunks: id, kind, title, body, owner_ids, group_ids and, for the dense branch, vector."""
    branches = [bm25(chunks, question_terms, index=index)]
    if query is not None:
        branches.append(dense(chunks.where("vector is not null"), query))
    pool = materialize(fuse(branches).join(chunks.drop("vector") if "vector" in chunks.columns else chunks, "id"), "pool")  # at most POOL rows
    credit = pool.select("id", "kind", "score", F.explode("owner_ids").alias("owner"))
    own = credit.where("kind = 'researcher'").groupBy("owner").agg(F.max("score").alias("score"))
    who = roll_up(credit.where("kind = 'work'"), "owner", own)
    by_group = pool.where("kind in ('work', 'tool')").select("id", "kind", "score", F.explode("group_ids").alias("grp"))
    centres = roll_up(by_group, "grp", weight=F.when(F.col("kind") == "tool", 2.0).otherwise(1.0))
    return {"pool": pool.select("id", "kind", "title", "score"), "people": best_owners(who, "owner", people), "groups": best_owners(centres, "grp", groups),
            "tools": pool.where("kind = 'tool'").orderBy(F.round("score", 9).desc(), "id").limit(tools).select("id", "title", "score", "owner_ids")}


def answer_reason(pool: DataFrame) -> DataFrame:
    """One row: confident is false, with reason no_match, only where nothing was found."""
    return pool.agg((F.count("*") > 0).alias("confident")).select("confident", F.when(~F.col("confident"), "no_match").alias("reason"))
