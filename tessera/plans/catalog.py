"""The named queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.keywords import top_keywords
from tessera.operators import checks, entity, graph, history, retrieval, views
from tessera.plans.adapters import bridge, edges, line_links, line_tasks, people, table, works
from tessera.sources import html
from tessera.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _longs(df: DataFrame) -> DataFrame:
    """All whole numbers as longs, so that both engines have one type."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that checks it."""
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: _longs(f(spark, sf_dir))
        if sql:
            _ORACLES[f.__name__] = sql
        return f
    return put


def _all() -> None:
    """The other module of queries registers its own when it is imported."""
    from tessera.plans import catalog_more  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_ORACLES)


B = "b AS (SELECT DISTINCT l_orderkey AS w, l_suppkey AS p FROM lineitem)"
E = f"""{B},
e AS (SELECT x.p AS src, y.p AS dst, count(*) AS weight, CAST(min(year(o_orderdate)) AS BIGINT) AS first_year, CAST(max(year(o_orderdate)) AS BIGINT) AS last_year
      FROM b x JOIN b y ON x.w = y.w AND x.p < y.p JOIN orders ON o_orderkey = x.w GROUP BY 1, 2)"""
P = "p AS (SELECT s_suppkey AS node, s_name AS name, n_name AS nation, r_name AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
D = """h AS (SELECT DISTINCT doc_id, sha256(line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 20),
f AS (SELECT k, min(doc_id) AS hub FROM h GROUP BY k HAVING count(*) > 1),
l AS (SELECT DISTINCT hub AS src, doc_id AS dst FROM h JOIN f USING (k) WHERE hub <> doc_id),
s AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l)"""
#: The components by propagation of the least label.
C = f"""{D},
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT s.dst, r.root FROM r JOIN s ON s.src = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node),
z AS (SELECT component, count(*) AS size FROM c GROUP BY component),
k AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) - 1 AS label FROM z)"""


# -- graph

@query(f"WITH {E} SELECT * FROM e")
def edge_derivation(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"""WITH {E}, {P} SELECT src, dst, a.name AS src_name, b2.name AS dst_name, weight, first_year, last_year
FROM e JOIN p a ON a.node = src JOIN p b2 ON b2.node = dst ORDER BY weight DESC, src, dst LIMIT 25""")
def strongest_pairs(spark, sf_dir):
    top = views.top_edges(edges(spark, sf_dir), 25)
    names = people(spark, sf_dir).select("node", "name")
    return top.join(names.toDF("src", "src_name"), "src").join(names.toDF("dst", "dst_name"), "dst").select("src", "dst", "src_name", "dst_name", "weight", "first_year", "last_year")


@query(f"""WITH {E} SELECT node, count(*) AS collaborators, CAST(sum(weight) AS BIGINT) AS shared_works
FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY node""")
def node_degree_strength(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query(f"WITH {E} SELECT * FROM e WHERE weight >= 28 AND coalesce(last_year, 0) >= 1999")
def edge_filter_since(spark, sf_dir):
    return graph.filter_edges(edges(spark, sf_dir), 28, 1999)


@query(f"""WITH {E}, {P} SELECT e.* FROM e JOIN p a ON a.node = src JOIN p b2 ON b2.node = dst
WHERE a.grp IN ('ASIA', 'EUROPE') AND b2.grp IN ('ASIA', 'EUROPE') AND weight >= 20""")
def group_subgraph(spark, sf_dir):
    return graph.visible_subgraph(edges(spark, sf_dir), people(spark, sf_dir), ["ASIA", "EUROPE"], 20)


@query(f"""WITH {E}, {P}, v AS (SELECT src, dst FROM e WHERE weight >= 28)
SELECT node, count(*) AS collaborators FROM (SELECT src AS node FROM v UNION ALL SELECT dst FROM v) GROUP BY node""")
def visible_degrees(spark, sf_dir):
    return graph.degrees(graph.filter_edges(edges(spark, sf_dir), 28)).select("node", "collaborators")


@query(f"""WITH {E}, {P},
x AS (SELECT count(*) AS edges, count(*) FILTER (WHERE a.nation <> b2.nation) AS cross_group_edges FROM e JOIN p a ON a.node = src JOIN p b2 ON b2.node = dst),
w AS (SELECT count(*) AS shared_works FROM (SELECT w FROM b GROUP BY w HAVING count(*) > 1))
SELECT (SELECT count(*) FROM p) AS nodes, edges, cross_group_edges, shared_works FROM x, w""")
def graph_stats(spark, sf_dir):
    p = people(spark, sf_dir)
    return views.graph_stats(p.select("node"), edges(spark, sf_dir), bridge(spark, sf_dir), p.select("node", F.col("nation").alias("grp")))


@query(f"""WITH {E} SELECT other, weight, first_year, last_year FROM (
SELECT src AS node, dst AS other, * EXCLUDE (src, dst) FROM e UNION ALL SELECT dst, src, * EXCLUDE (src, dst) FROM e) WHERE node = 7""")
def ego_partners(spark, sf_dir):
    return views.ego(edges(spark, sf_dir), 7)


@query(f"""WITH {B}, m AS (SELECT w, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS title FROM b JOIN orders ON o_orderkey = w WHERE p = 7 ORDER BY year DESC, title, w LIMIT 100),
n AS (SELECT m.w, list(s_name ORDER BY s_name) AS n FROM m JOIN b ON b.w = m.w AND b.p <> 7 JOIN supplier ON s_suppkey = b.p GROUP BY m.w)
SELECT m.w AS work_id, year, title, coalesce(array_to_string(list_slice(n, 1, 5), ', ') || CASE WHEN len(n) > 5 THEN ' +' || (len(n) - 5) || ' more' ELSE '' END, '') AS partners
FROM m LEFT JOIN n ON n.w = m.w""")
def works_of_person(spark, sf_dir):
    return views.works_of(bridge(spark, sf_dir), 7, people(spark, sf_dir).select(F.col("node").alias("person_id"), "name"))


@query(f"WITH RECURSIVE {C} SELECT node, component, label, size FROM c JOIN k USING (component)")
def connected_components(spark, sf_dir):
    return graph.components(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node")), line_links(spark, sf_dir)).select("node", "component", "label", "size")


@query(f"""WITH RECURSIVE {C} SELECT l.src, l.dst FROM l JOIN c ON c.node = l.src JOIN k ON k.component = c.component WHERE size >= 5""")
def prune_small(spark, sf_dir):
    return graph.prune_small(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node")), line_links(spark, sf_dir), 5)[1].select("src", "dst")


def _ring_sql(points: str) -> str:
    """x, y of points (node, grp, degree): a ring of radius 2.6, spirals of radius 0.34 * sqrt(members), then the unit box."""
    return f"""rr AS (SELECT node, grp, row_number() OVER (PARTITION BY grp ORDER BY degree DESC, node) - 1 AS rk, count(*) OVER (PARTITION BY grp) AS members FROM {points}),
ri AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS g, count(*) OVER () AS ng FROM (SELECT DISTINCT grp FROM rr)),
rx AS (SELECT node, rr.grp, cos(2 * pi() * g / ng) * 2.6 + cos(pi() * (3 - sqrt(5)) * rk) * sqrt((rk + 0.5) / members) * 0.34 * sqrt(members) AS x,
             sin(2 * pi() * g / ng) * 2.6 + sin(pi() * (3 - sqrt(5)) * rk) * sqrt((rk + 0.5) / members) * 0.34 * sqrt(members) AS y FROM rr JOIN ri ON ri.grp = rr.grp),
rh AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, greatest(max(x) - (min(x) + max(x)) / 2, max(y) - (min(y) + max(y)) / 2, 1e-9) AS extent FROM rx),
lay AS (SELECT node, grp, round((x - mx) / extent, 3) + 0.0 AS x, round((y - my) / extent, 3) + 0.0 AS y FROM rx, rh)"""


@query(f"""WITH s AS (SELECT s_suppkey AS node, s_nationkey AS grp, s_acctbal AS degree FROM supplier), {_ring_sql('s')} SELECT node, CAST(grp AS BIGINT) AS grp, x, y FROM lay""")
def division_layout(spark, sf_dir):
    return graph.ring_layout(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("degree")))


@query(f"""WITH RECURSIVE {C}, t AS (SELECT node, label, size, row_number() OVER (PARTITION BY label ORDER BY node) - 1 AS ord FROM c JOIN k USING (component)),
big AS (SELECT node, lang AS grp, size AS degree FROM t JOIN documents ON doc_id = node WHERE size >= 5), {_ring_sql('big')},
sat AS (SELECT node, label, size, ord, dense_rank() OVER (ORDER BY label) - 1 AS ci FROM t WHERE size < 5),
n AS (SELECT count(DISTINCT label) AS n FROM sat),
u AS (SELECT node, x, y FROM lay UNION ALL
      SELECT node, cos(2 * pi() * (ci + 0.5) / n) + 0.05 * size * cos(2 * pi() * ord / size), sin(2 * pi() * (ci + 0.5) / n) + 0.05 * size * sin(2 * pi() * ord / size) FROM sat, n),
m AS (SELECT greatest(max(abs(x)), max(abs(y))) AS m FROM u)
SELECT u.node, label, round(x / m, 3) + 0.0 AS x, round(y / m, 3) + 0.0 AS y FROM u JOIN t ON t.node = u.node, m""")
def satellites(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "lang")
    labelled = graph.components(docs.select("node"), line_links(spark, sf_dir))
    main = labelled.where("size >= 5").join(docs, "node").select("node", F.col("lang").alias("grp"), F.col("size").alias("degree"))
    return graph.with_satellites(labelled, graph.ring_layout(main).select("node", "x", "y"))


# -- views and aggregates

@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 20")
def topn_per_group(spark, sf_dir):
    return views.top_per_group(table(spark, sf_dir, "events"), "event_type", 20, F.col("ts").desc(), "event_id").select("event_id", "user_id", "event_type")


@query("""SELECT DISTINCT w AS work_id FROM (SELECT w, row_number() OVER (PARTITION BY p ORDER BY y DESC, w) AS rn FROM (
SELECT DISTINCT l_orderkey AS w, l_suppkey AS p, year(o_orderdate) AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) WHERE rn <= 5""")
def newest_per_person_union(spark, sf_dir):
    return views.newest_per_person(bridge(spark, sf_dir), 5, line_tasks(spark, sf_dir))


@query("""SELECT c_mktsegment AS program, count(*) AS roster, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_works FROM customer GROUP BY 1""")
def program_summary(spark, sf_dir):
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return views.program_summary(table(spark, sf_dir, "customer").join(have, "c_custkey", "left").withColumn("has", F.coalesce("has", F.lit(False))), "c_mktsegment", "has")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def zero_filled_counts(spark, sf_dir):
    return views.zero_filled_counts(table(spark, sf_dir, "nation"), "n_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey")


@query("""SELECT grp, count(*) AS n FROM (SELECT DISTINCT s_suppkey, r_name AS grp FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_suppkey = l_suppkey) GROUP BY grp""")
def membership_counts(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    region = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    served = table(spark, sf_dir, "lineitem").join(region, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(F.collect_set("r_name").alias("groups"))
    return views.membership_counts(served)


@query("SELECT count(*) FILTER (WHERE n >= 12) AS capped FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def capped_count(spark, sf_dir):
    return views.capped_count(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), 12)


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND contains(lower(coalesce(text, '') || ' ' || source), 'that the')")
def keyword_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.array("lang").alias("division_ids"), T.search_text("text", "source").alias("search_text"))
    return views.people_view(docs, "en", "That The").select("doc_id", "lang", "source")


@query("""SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS label FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring')
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), 'ring')
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), source FROM documents WHERE contains(lower(text), 'ring')""")
def cross_entity_search(spark, sf_dir):
    return views.cross_search({
        "part": (table(spark, sf_dir, "part").withColumn("search_text", T.search_text("p_name", "p_brand")), "p_partkey", "p_name"),
        "supplier": (table(spark, sf_dir, "supplier").withColumn("search_text", T.search_text("s_name")), "s_suppkey", "s_name"),
        "document": (table(spark, sf_dir, "documents").withColumn("search_text", T.search_text("text")), "doc_id", "source")}, "Ring")


@query("""SELECT s_suppkey AS node, n_name AS nation, n_name <> 'FRANCE' AS dim, contains(lower(s_name), '00007') AS found FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def soft_flags(spark, sf_dir):
    nodes = people(spark, sf_dir).withColumn("groups", F.array("nation"))
    return views.soft_flags(nodes, "FRANCE", "00007").select("node", "nation", "dim", "found")


@query("""SELECT n_name, ['#1b6ca8', '#d1495b', '#66a182', '#edae49'][(row_number() OVER (ORDER BY n_name) - 1) % 4 + 1] AS colour FROM nation""")
def palette(spark, sf_dir):
    return views.palette(table(spark, sf_dir, "nation"), "n_name", ["#1b6ca8", "#d1495b", "#66a182", "#edae49"])


@query("""SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*)) AS BIGINT) AS share FROM customer GROUP BY 1""")
def share_summary(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count_if(F.col("c_acctbal") < 0).alias("a"), F.count("*").alias("n")).select("nation", views.share(F.col("a"), F.col("n")).alias("share"))


@query(r"""SELECT source, array_to_string(list(term ORDER BY n DESC, term), ' ') AS keywords FROM (
  SELECT source, term, n FROM (SELECT source, term, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term) AS rn FROM (
    SELECT DISTINCT doc_id, source, CASE WHEN length(t) <= 3 THEN t WHEN regexp_matches(t, 'ies$') AND length(t) > 4 THEN regexp_replace(t, 'ies$', '') || 'y'
      WHEN regexp_matches(t, '(ss|sh|ch|x|z)es$') THEN regexp_replace(t, 'es$', '') WHEN regexp_matches(t, '[^sui]s$') THEN regexp_replace(t, 's$', '') ELSE t END AS term
    FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*')) AS t FROM documents))
  WHERE length(term) > 2 AND term NOT IN ('and','are','for','from','that','the','this','was','were','with') GROUP BY source, term) WHERE rn <= 15) GROUP BY source""")
def top_keywords_per_owner(spark, sf_dir):
    got = top_keywords(table(spark, sf_dir, "documents").select("source", "text"), "source", "text", 15)
    return got.select("source", F.array_join("keywords", " ").alias("keywords"))


# -- entity resolution and history

@query("""WITH o AS (SELECT user_id || ':' || event_type AS id, event_type, max(ts) AS ts FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2),
n AS (SELECT user_id || ':' || event_type AS id, event_type, max(ts) AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2),
m AS (SELECT coalesce(n.id, o.id) AS id, coalesce(n.event_type, o.event_type) AS organization_id, coalesce(n.ts, o.ts) AS ts, o.id IS NULL AS fresh, n.id IS NOT NULL AS seen FROM n FULL JOIN o ON n.id = o.id),
k AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY ts DESC, id DESC, id) AS rn FROM m WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 20 DAY)
SELECT id, organization_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published, CASE WHEN fresh THEN '2024-01-30' ELSE '2024-01-16' END AS first_seen_at, CASE WHEN seen THEN '2024-01-30' ELSE '2024-01-16' END AS last_seen_at FROM k WHERE rn <= 100""")
def history_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("event_type").alias("organization_id"), "ts")

    def latest(part: DataFrame) -> DataFrame:
        return part.groupBy("id", "organization_id").agg(F.max("ts").alias("published_at")).withColumn("title", F.col("id"))
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    before = latest(rows.where(F.col("ts") < at("2024-01-16"))).withColumn("first_seen_at", at("2024-01-16")).withColumn("last_seen_at", at("2024-01-16"))
    got = history.merge_history(before, latest(rows.where(F.col("ts") >= at("2024-01-16"))), at("2024-01-30"), keep_days=20, per_owner=100)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return got.select("id", "organization_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), day("first_seen_at"), day("last_seen_at"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
z AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT z.k, z.n, z.p, a.k IS NULL AS is_new FROM z LEFT JOIN a ON a.k = z.k WHERE a.k IS NULL OR a.n IS DISTINCT FROM z.n OR a.p IS DISTINCT FROM z.p""")
def changed_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    per = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    return history.changed_rows(per(o.where(F.col("o_orderdate") < cut)), per(o.where(F.col("o_orderdate") >= cut)), "k", ["n", "p"])


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'OVERRIDE' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def sparse_overlay(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", F.lit("").alias("c_name"), F.lit("OVERRIDE").alias("c_mktsegment"),
                                                                            F.lit(True).alias("has_c_name"), (F.col("c_mktsegment") == "BUILDING").alias("has_c_mktsegment"))
    return entity.overlay(base, changes, "c_custkey", ["c_name", "c_mktsegment"])


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def replace_by_key(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    fresh = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return entity.replace_by_key(base, fresh, "c_custkey")


@query("""WITH k AS (SELECT o_orderkey AS id, o_orderstatus AS st, ['a:' || o_custkey || ':' || strftime(o_orderdate, '%Y-%m-%d'), 'b:' || o_custkey || ':' || o_orderpriority, 'c:' || o_custkey] AS keys FROM orders),
u AS (SELECT unnest(keys) AS k, id FROM k WHERE st <> 'P'), own AS (SELECT k, max(id) AS m FROM u GROUP BY k),
q AS (SELECT id, unnest(keys) AS k, unnest([0, 1, 2]) AS pos FROM k WHERE st = 'P'),
t AS (SELECT q.id, arg_min(m, pos) AS match FROM q JOIN own USING (k) GROUP BY q.id)
SELECT k.id AS probe, match FROM k LEFT JOIN t ON t.id = k.id WHERE st = 'P'""")
def ordered_key_match(spark, sf_dir):
    c = F.col("o_custkey").cast("string")
    keys = F.array(F.concat(F.lit("a:"), c, F.lit(":"), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("b:"), c, F.lit(":"), "o_orderpriority"), F.concat(F.lit("c:"), c))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", keys.alias("keys"), F.col("o_orderkey").alias("ordinal"))
    return entity.first_key_match(o.where("o_orderstatus = 'P'").withColumnRenamed("id", "probe"), o.where("o_orderstatus <> 'P'"), "probe", "id")


@query(r"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')), ' ') AS w FROM documents),
k AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[-1] END AS k FROM t),
n AS (SELECT k, count(*) AS n, min(doc_id) AS id FROM k WHERE k IS NOT NULL GROUP BY k)
SELECT k.doc_id AS probe, CASE WHEN n.n = 1 THEN n.id END AS match FROM k LEFT JOIN n ON n.k = k.k""")
def unique_name_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"))
    return entity.unique_name_match(docs.withColumnRenamed("doc_id", "probe"), docs, "probe", "doc_id")


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1, 2),
p AS (SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY f), '|') AS priorities FROM f GROUP BY 1),
l AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1)
SELECT o_custkey AS cust, status, priorities FROM p JOIN l USING (o_custkey)""")
def union_membership(spark, sf_dir):
    cards = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.array("o_orderpriority").alias("priorities"))
    return entity.union_membership(cards, "cust", "o_orderkey", ["status"], "priorities").select("cust", "status", F.array_join("priorities", "|").alias("priorities"))


@query(f"WITH RECURSIVE {C} SELECT node AS work_id, component AS identity FROM c")
def identity_classes(spark, sf_dir):
    keys = F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 20), lambda x: F.sha2(x, 256))
    return entity.identity_classes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"), keys.alias("keys")))


# -- contracts

@query("""WITH a AS (SELECT o_orderpriority AS grp, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-05-01' GROUP BY 1), z AS (SELECT o_orderpriority AS grp, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-05-01' AND o_orderstatus <> 'F' GROUP BY 1),
u AS (SELECT coalesce(a.grp, z.grp) AS grp, coalesce(a.n, 0) AS n_before, coalesce(z.n, 0) AS n_now FROM a FULL JOIN z ON a.grp = z.grp UNION ALL SELECT '*', (SELECT sum(n) FROM a), (SELECT sum(n) FROM z))
SELECT grp, CAST(n_before AS BIGINT) AS n_before, CAST(n_now AS BIGINT) AS n_now FROM u WHERE n_now < n_before * 0.75 OR (grp = '*' AND n_now < 1)""")
def drop_guard(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cut = F.lit("1998-05-01").cast("timestamp_ntz")
    return checks.drop_guard(o.where(F.col("o_orderdate") < cut), o.where((F.col("o_orderdate") >= cut) & (F.col("o_orderstatus") != "F")), "o_orderpriority")


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def fk_violations(spark, sf_dir):
    return checks.missing_refs(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal >= 0"), "c_custkey")


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_pairs(spark, sf_dir):
    return checks.repeated(table(spark, sf_dir, "lineitem"), F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"))


@query(f"""WITH {E}, {P} SELECT rule, src, dst FROM (SELECT 'weight' AS rule, src, dst FROM e WHERE weight < 1 UNION ALL
SELECT 'unknown_src', src, dst FROM e WHERE src NOT IN (SELECT node FROM p WHERE grp = 'ASIA') UNION ALL SELECT 'unknown_dst', src, dst FROM e WHERE dst NOT IN (SELECT node FROM p WHERE grp = 'ASIA'))""")
def graph_violations(spark, sf_dir):
    return checks.graph_violations(edges(spark, sf_dir), people(spark, sf_dir).where(F.array_contains("groups", "ASIA")), tasks=line_tasks(spark, sf_dir))


@query("""SELECT k, p, side FROM (SELECT o_custkey AS k, o_orderpriority AS p, 'left' AS side FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey, o_orderpriority, 'left' FROM orders WHERE o_orderstatus = 'O')
UNION ALL (SELECT o_custkey, o_orderpriority, 'right' FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey, o_orderpriority, 'right' FROM orders WHERE o_orderstatus = 'F')""")
def snapshot_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), "o_orderstatus")
    return checks.snapshot_diff(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"))


@query("""WITH w AS (SELECT l_orderkey AS w, list(DISTINCT n_name) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
a AS (SELECT l_orderkey AS w, list(DISTINCT n_name) AS d FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT w.w AS work_id, array_to_string(list_sort(list_filter(w.d, lambda x: NOT list_contains(a.d, x))), ',') AS extra FROM w JOIN a ON a.w = w.w WHERE NOT list_has_all(a.d, w.d)""")
def attribution_subset(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nation = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("work_id"), F.array("n_name").alias("division_ids"))
    who = people(spark, sf_dir).select(F.col("node").alias("person_id"), F.array("nation").alias("division_ids"))
    got = checks.attribution(works(spark, sf_dir).join(nation, "work_id"), who)
    return got.select("work_id", F.array_join("extra", ",").alias("extra"))


@query("""SELECT key, rule FROM (SELECT CAST(c_custkey AS VARCHAR) AS key, 'balance' AS rule FROM customer WHERE NOT c_acctbal >= 0 UNION ALL
SELECT CAST(c_custkey AS VARCHAR), 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))""")
def row_contract(spark, sf_dir):
    return checks.failing(table(spark, sf_dir, "customer"), "c_custkey", {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")})


# -- text and retrieval

@query(r"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*')) AS term FROM documents) GROUP BY term""")
def tokenize_df(spark, sf_dir):
    return retrieval.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@query("SELECT page_id, substr(sha256('web|' || url || '|'), 1, 20) AS id FROM pages")
def item_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.item_id(F.lit("web"), "url", F.lit(None).cast("string")).alias("id"))


_TOK = r"t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*') AS ts FROM documents)"
BM = rf"""{_TOK}, st AS (SELECT count(*) AS n, avg(CAST(len(ts) AS DOUBLE)) AS al FROM t),
hit AS (SELECT doc_id, len AS l, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM t) WHERE term IN ('achach', 'achlich', 'inblehe') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))) AS score FROM hit JOIN df USING (term), st WHERE df <= greatest(8.0, n * 0.15) GROUP BY doc_id)"""
QUESTION = ["achach", "achlich", "inblehe"]


@query(f"WITH {BM} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 300")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), QUESTION, "doc_id", "text", fold=False).select("doc_id", F.round("score", 6).alias("score"))


DN = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
dn AS (SELECT vec_id AS doc_id, list_dot_product(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q)"""


def _dense(spark, sf_dir, top):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return retrieval.dense(e, e.where("doc_id = 0").select(F.col("vector").alias("q")), "doc_id", top=top)


@query(f"WITH {DN} SELECT doc_id, round(score, 5) AS score FROM dn ORDER BY round(score, 9) DESC, doc_id LIMIT 300")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 300).select("doc_id", F.round("score", 5).alias("score"))


@query(f"WITH {DN} SELECT round(max(score), 5) AS top, round(avg(score), 5) AS mean, round(stddev_pop(score), 5) AS deviation FROM dn")
def score_spread(spark, sf_dir):
    s = retrieval.spread(_dense(spark, sf_dir, None))
    return s.select(*[F.round(c, 5).alias(c) for c in ("top", "mean", "deviation")])


FUSED = f"""{BM}, {DN}, b1 AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rk FROM bm QUALIFY rk <= 300),
b2 AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rk FROM dn QUALIFY rk <= 300),
fu AS (SELECT doc_id, sum(1.0 / (60 + rk)) AS score FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY doc_id ORDER BY round(sum(1.0 / (60 + rk)), 9) DESC, doc_id LIMIT 60)"""


def _fused(spark, sf_dir):
    return retrieval.fuse([retrieval.bm25(table(spark, sf_dir, "documents"), QUESTION, "doc_id", "text", fold=False), _dense(spark, sf_dir, 300)], "doc_id")


@query(f"WITH {FUSED} SELECT doc_id, round(score, 6) AS score FROM fu")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {FUSED}, v AS (SELECT source, fu.doc_id, score, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, fu.doc_id) AS r FROM fu JOIN documents d ON d.doc_id = fu.doc_id)
SELECT source, round(sum(score / sqrt(r)), 6) AS score, array_to_string(list(doc_id ORDER BY r), ',') AS evidence FROM v WHERE r <= 3 GROUP BY source""")
def rollup_owner(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    got = retrieval.roll_up(_fused(spark, sf_dir).join(d, "doc_id"), "source", key="doc_id")
    return got.select("source", F.round("score", 6).alias("score"), F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


@query(f"""WITH {FUSED}, v AS (SELECT lang, doc_id, s, row_number() OVER (PARTITION BY lang ORDER BY round(s, 9) DESC, doc_id) AS r FROM (
SELECT lang, fu.doc_id, score * CASE WHEN source = 'src1' THEN 2.0 ELSE 1.0 END AS s FROM fu JOIN documents d ON d.doc_id = fu.doc_id))
SELECT lang, round(sum(s / sqrt(r)), 6) AS score FROM v WHERE r <= 3 GROUP BY lang""")
def rollup_group(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    got = retrieval.roll_up(_fused(spark, sf_dir).join(d, "doc_id"), "lang", key="doc_id", weight=F.when(F.col("source") == "src1", 2.0).otherwise(1.0))
    return got.select("lang", F.round("score", 6).alias("score"))


@query("""WITH n AS (SELECT doc_id, sha256(text) AS h FROM documents), p AS (SELECT doc_id, sha256(CASE WHEN source = 'src3' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'fr')
SELECT count(*) FILTER (WHERE p.doc_id IS NULL OR n.h <> p.h) AS stale, count(*) FILTER (WHERE n.h = p.h) AS reused, CAST(0 AS BIGINT) AS dropped FROM n LEFT JOIN p ON p.doc_id = n.doc_id""")
def chunk_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    now = d.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    before = d.where("lang <> 'fr'").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return retrieval.dry_run(now, before)


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link, contains(html, '<nav>') AS has_nav FROM pages""")
def html_extract(spark, sf_dir):
    return html.page_summary(table(spark, sf_dir, "pages"))


@query()
def html_profiles(spark, sf_dir):
    return html.scan_profiles(table(spark, sf_dir, "pages"))


@query("""WITH RECURSIVE n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, length(text) AS l FROM conversations),
r AS (SELECT conv_id, i, turn, CASE WHEN l <= 2000 THEN l ELSE 0 END AS used, l <= 2000 AS taken FROM n WHERE i = 1
UNION ALL SELECT n.conv_id, n.i, n.turn, CASE WHEN r.used + l <= 2000 THEN r.used + l ELSE r.used END, r.used + l <= 2000 FROM r JOIN n ON n.conv_id = r.conv_id AND n.i = r.i + 1)
SELECT conv_id, count(*) FILTER (WHERE taken) AS kept, CAST(max(used) AS BIGINT) AS used FROM r GROUP BY conv_id""")
def budgeted_take(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    kept = turns.select("conv_id", views.budgeted_take(F.col("texts"), 2000).alias("kept"))
    return kept.select("conv_id", F.size("kept").alias("kept"), F.aggregate("kept", F.lit(0), lambda s, x: s + F.length(x)).alias("used"))


@query("""SELECT conv_id, starts_with(ltrim(string_agg(text, '' ORDER BY turn)), 'The') AS refused FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def sentinel_prefix(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return said.select("conv_id", limits.refused(F.col("parts"), "The").alias("refused"))


# -- limits and budgets

def _limit_sql(unit: str, n: int) -> str:
    return f"""SELECT event_id, seq, seq > {n} AS denied FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('{unit}', ts) ORDER BY ts, event_id) AS seq FROM events)"""


@query(_limit_sql("hour", 2))
def rate_limit_hour(spark, sf_dir):
    return limits.over_limit(table(spark, sf_dir, "events"), "user_id", 2, "hour").select("event_id", "seq", "denied")


@query(_limit_sql("day", 3))
def rate_limit_day(spark, sf_dir):
    return limits.over_limit(table(spark, sf_dir, "events"), "user_id", 3, "day").select("event_id", "seq", "denied")


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return limits.tumbling_counts(table(spark, sf_dir, "events"), "event_type", "hour").select("event_type", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n")


@query("""SELECT event_id, CAST(sum(c) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent,
sum(c) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - c >= 60000000000 AS denied FROM (SELECT *, CAST(round(value * 1e6) AS BIGINT) AS c FROM events)""")
def cumulative_spend(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cost", F.round(F.col("value") * 1e6).cast("long"))
    return limits.cumulative_spend(e, "cost", 60_000_000_000).select("event_id", "spent", "denied")


@query("""
WITH r AS (SELECT event_id, user_id, ts, CAST(round(value * 1e6) AS BIGINT) AS cost FROM events WHERE ts IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS nth FROM r),
d AS (SELECT *, sum(CASE WHEN nth <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS today FROM m),
o AS (SELECT *, CASE WHEN nth > 5 THEN 'ip_minute' WHEN today > 3 THEN 'ip_day' ELSE 'admit' END AS own FROM d),
a AS (SELECT *, coalesce(sum(CASE WHEN own = 'admit' THEN 1 ELSE 0 END) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS admitted FROM o),
p AS (SELECT *, coalesce(sum(CASE WHEN own = 'admit' AND admitted < 300 THEN greatest(coalesce(cost, 0), 0) ELSE 0 END) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM a)
SELECT CAST(event_id AS BIGINT) AS event, CASE WHEN spent >= 200000000000 THEN 'month_budget' WHEN admitted >= 300 THEN 'global_day' ELSE own END AS decision FROM p
""")
def admission_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cost", F.round(F.col("value") * 1e6).cast("long"))
    return limits.admission(e, 5, 3, 300, 200_000_000_000)


@query()
def cache_hits_ttl(spark, sf_dir):
    return limits.cache_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], 7)


@query("""SELECT CAST(user_id AS VARCHAR) || '@' || event_type AS k, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY user_id, event_type""")
def last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("@"), "event_type").alias("k"), "event_id")
    last = entity.last_wins(e.withColumn("last_event", F.col("event_id")), "k", "event_id").select("k", "last_event")
    first = e.groupBy("k").agg(F.min("event_id").alias("first_event"))
    return first.join(last, "k")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, dense_rank() OVER (ORDER BY n_nationkey) - 1 AS idx FROM nation")
def dense_index(spark, sf_dir):
    return entity.dense_index(table(spark, sf_dir, "nation"), "n_nationkey")


@query("""SELECT vec_id, array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(greatest(-127, least(127, round(127 * v / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))))) AS INTEGER)), ',') AS q FROM embeddings""")
def quantize_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(T.quantize("embedding"), lambda v: v.cast("string")), ",").alias("q"))


