"""Line dedup over overlapping windows of three lines, in DataFrame functions alone.

Every three consecutive lines are hashed (two independent 64-bit hashes of the trimmed lines). A window that
occurs more than once keeps its first occurrence, by doc_id and then line number; the later ones cover their
three lines, overlapping covers merge, and covered lines go.

First occurrences come from an aggregate that combines before the shuffle, so a window in every document is
no hot key there; occurrences meet the repeated windows in an inner equi-join that AQE can split.

Results for odd input: a null text is empty; texts of fewer than three lines have no window and stay whole;
windows without a letter or digit (blank lines, rules) don't count; a window that repeats inside one document
goes there too, unless it overlaps its own first occurrence, whose lines stay; rows that repeat a doc_id are
told apart by their text, equal rows (same doc_id, same text) are one; rows without a doc_id stay whole and count
nowhere; very long texts are read whole; of windows that tie in doc_id and line the one with the smaller hash of its
text is first; an empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import texts
from tessera.session import materialize

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), pos (from 0), h1, h2: a row for each window that counts."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("l")).where(F.size("l") >= size)
    at = lines.select("doc_id", "th", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("l") - (size - 1)), lambda i: F.slice("l", i, size))).alias("pos", "w"))
    return at.where(F.exists("w", lambda x: x.rlike(r"[\p{L}\p{N}]"))).select(
        "doc_id", "th", "pos", F.xxhash64("w").alias("h1"), F.xxhash64(F.reverse("w"), F.lit(size)).alias("h2"))


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, th, spans: for documents that lose lines, the merged [from, to) line ranges that later occurrences cover."""
    found = materialize(windows(docs.where(F.col("doc_id").isNotNull()), size), "windows")
    where = F.struct("doc_id", "th", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = found.join(first, ["h1", "h2"]).where(F.struct("doc_id", "th", "pos") != F.col("first"))
    # Lines of a first occurrence that stand in the same document stay.
    start = F.when((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.th") == F.col("th")), F.greatest("pos", F.col("first.pos") + size)).otherwise(F.col("pos"))
    ranges = later.select("doc_id", "th", start.cast("int").alias("s"), (F.col("pos") + size).cast("int").alias("e")).where("s < e").distinct()
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("s", "e"))),
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(x))))
    return ranges.groupBy("doc_id", "th").agg(merged.alias("spans"))


def dedup_lines(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what stays), n_lines, n_removed for every document."""
    body = texts(docs, id_col, text_col)
    cut = covered(body, size)
    with_text = body.withColumn("th", F.xxhash64("text")).join(cut, ["doc_id", "th"], "left")
    lines = F.split("text", "\n")
    # What stays between the spans: from the end of one (or 0) to the start of the next (or the last line).
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["e"]))
    ends = F.concat(F.transform("spans", lambda x: x["s"]), F.array(F.col("n_lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(F.col("lines"), s + 1, F.greatest(e - s, F.lit(0)))))
    counted = with_text.withColumn("lines", lines).withColumn("n_lines", F.size("lines"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, x: n + x["e"] - x["s"]), F.lit(0))
    return counted.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept)).alias("text"), "n_lines", removed.alias("n_removed"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
l AS (SELECT doc_id, raw, list_transform(raw, lambda x: trim(x, ' ')) AS l FROM d),
w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS pos, l FROM l WHERE len(l) >= 3),
k AS (SELECT doc_id, pos, list_slice(l, pos + 1, pos + 3) AS w FROM w),
g AS (SELECT * FROM k WHERE regexp_matches(list_aggregate(w, 'string_agg', chr(10)), '[\p{L}\p{N}]')),
r AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp, row_number() OVER o AS rn
      FROM g WINDOW o AS (PARTITION BY w ORDER BY doc_id, pos)),
c AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN fd = doc_id THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS n FROM r WHERE rn > 1),
ln AS (SELECT doc_id, unnest(raw) AS line, unnest(range(0, len(raw))) AS n FROM l),
o AS (SELECT ln.doc_id, string_agg(line, chr(10) ORDER BY ln.n) FILTER (WHERE c.n IS NULL) AS text,
             count(*) AS n_lines, count(c.n) AS n_removed
      FROM ln LEFT JOIN c ON c.doc_id = ln.doc_id AND c.n = ln.n GROUP BY ln.doc_id)
SELECT doc_id, coalesce(text, '') AS text, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed FROM o
"""
