"""Queries: one-hop, diff, search, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as g
from tessera.operators import census, graph_query as q
from tessera.registry import graph_sql, query

_ENV = "n.id, n.kind, n.repo, n.qualified_name, n.short_name, n.file"


@query(
    "graph_callers",
    graph_sql(f""" SELECT e.kind AS edge_kind, 'in' AS direction, {_ENV} FROM g_edges e JOIN g_nodes n ON n.id = e.src_id
    WHERE e.dst_id = 'P:1' AND e.kind IN ('CALLS', 'REFERENCES') ORDER BY e.kind, n.id LIMIT 500"""),
)
def graph_callers(spark, d):
    return q.callers(g.nodes(spark, d, g.beside("P:1")), g.edges(spark, d, touching="P:1"), "P:1")


@query(
    "graph_implementers",
    graph_sql(f""", s AS (SELECT min(id) AS id FROM g_nodes WHERE qualified_name = 'Brand#1::Brand#11' OR id = 'B:Brand#11')
    SELECT e.kind AS edge_kind, 'in' AS direction, {_ENV} FROM g_edges e JOIN s ON e.dst_id = s.id JOIN g_nodes n ON n.id = e.src_id
    WHERE e.kind IN ('IMPLEMENTS', 'EXTENDS') ORDER BY n.id LIMIT 500"""),
)
def graph_implementers(spark, d):
    return q.implementers(g.nodes(spark, d, g.beside("B:Brand#11")), g.edges(spark, d, touching="B:Brand#11"), "B:Brand#11")


@query(
    "graph_neighbors_both",
    graph_sql(f""", m AS (
      SELECT kind, 'out' AS direction, dst_id AS other FROM g_edges WHERE src_id = 'U:1' AND kind IN ('CONTAINS', 'READS_FIELD', 'CONSTRUCTS')
      UNION ALL SELECT kind, 'in', src_id FROM g_edges WHERE dst_id = 'U:1' AND kind IN ('CONTAINS', 'READS_FIELD', 'CONSTRUCTS')
    ), r AS (
      SELECT m.kind AS edge_kind, direction, {_ENV}, row_number() OVER (PARTITION BY m.kind, direction ORDER BY n.id) AS rn,
        CASE m.kind WHEN 'CONTAINS' THEN 1 WHEN 'READS_FIELD' THEN 2 ELSE 3 END AS place FROM m JOIN g_nodes n ON n.id = m.other)
    SELECT edge_kind, direction, id, kind, repo, qualified_name, short_name, file FROM r WHERE rn <= 20 ORDER BY place, direction DESC, id LIMIT 20"""),
)
def graph_neighbors_both(spark, d):
    return q.neighbors(g.nodes(spark, d, g.beside("U:1")), g.edges(spark, d, touching="U:1"), "U:1", "both", ("CONTAINS", "READS_FIELD", "CONSTRUCTS"), 20)


def _snapshots(spark, d):
    """Orders of two overlapping periods; a status that is not final yet counts as changed in the later one."""
    o = g.table(spark, d, "orders").select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").cast("string").alias("qualified_name"), "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"))
    a = o.where("y <= 1996").select("id", "qualified_name", F.col("o_orderstatus").alias("ast_hash"))
    b = o.where("y >= 1994").select("id", "qualified_name", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")).alias("ast_hash"))
    return a, b


_DIFF = """WITH o AS (SELECT o_orderkey::VARCHAR AS qualified_name, o_orderstatus, o_orderpriority, year(o_orderdate) AS y FROM orders),
a AS (SELECT qualified_name, o_orderstatus AS h FROM o WHERE y <= 1996),
b AS (SELECT qualified_name, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS h FROM o WHERE y >= 1994),
r AS (SELECT coalesce(a.qualified_name, b.qualified_name) AS qualified_name, CASE WHEN a.qualified_name IS NULL THEN 'added' WHEN b.qualified_name IS NULL THEN 'removed'
  WHEN a.h IS DISTINCT FROM b.h THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL OUTER JOIN b ON a.qualified_name = b.qualified_name)
"""


@query("graph_diff", _DIFF + "SELECT qualified_name, status FROM r")
def graph_diff(spark, d):
    return q.snapshot_diff(*_snapshots(spark, d))


@query("graph_diff_counts", _DIFF + "SELECT status, count(*) AS n FROM r GROUP BY status")
def graph_diff_counts(spark, d):
    return q.snapshot_diff(*_snapshots(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("store_summary", graph_sql(" SELECT repo, count(*) AS n_symbols, max(id) AS last_id FROM g_nodes GROUP BY repo"))
def store_summary(spark, d):
    return census.store_summary(g.nodes(spark, d))


@query(
    "graph_stats",
    graph_sql(""" SELECT 'total' AS section, 'nodes' AS name, count(*) AS n FROM g_nodes UNION ALL SELECT 'total', 'edges', count(*) FROM g_edges
    UNION ALL SELECT 'edges_by_kind', kind, count(*) FROM g_edges GROUP BY kind UNION ALL SELECT 'nodes_by_repo', repo, count(*) FROM g_nodes GROUP BY repo"""),
)
def graph_stats(spark, d):
    return census.graph_stats(g.nodes(spark, d), g.edges(spark, d))


@query("edge_census", graph_sql(" SELECT n.repo, e.kind, count(*) AS n, e.kind <> 'CONTAINS' AS relational FROM g_edges e JOIN g_nodes n ON n.id = e.src_id GROUP BY n.repo, e.kind"))
def edge_census(spark, d):
    return census.edge_census(g.nodes(spark, d), g.edges(spark, d))


@query("slices", graph_sql(" SELECT DISTINCT repo, kind FROM g_nodes WHERE file <> ''"))
def slices(spark, d):
    return census.slices(g.nodes(spark, d))


@query("code_search", graph_sql(" SELECT symbol_id, repo, kind, pos, text FROM g_tokens WHERE contains(text, 'able') AND kind = 'literal' ORDER BY symbol_id, pos LIMIT 50"))
def code_search(spark, d):
    return q.code_search(g.tokens(spark, d), "able", kind="literal").select("symbol_id", "repo", "kind", "pos", "text")


@query(
    "load_graph_filtered",
    graph_sql(""", n AS (SELECT id FROM g_nodes WHERE repo IN ('ASIA', 'EUROPE')) SELECT kind, count(*) AS n_edges, sum(coalesce("count", 0))::BIGINT AS total FROM (
      SELECT src_id, dst_id, kind, max("count") AS "count" FROM g_edges WHERE src_id IN (FROM n) AND dst_id IN (FROM n) GROUP BY ALL) GROUP BY kind"""),
)
def load_graph_filtered(spark, d):
    _, e = q.load_graph(g.nodes(spark, d), g.edges(spark, d), ["ASIA", "EUROPE"])
    return e.groupBy("kind").agg(F.count("*").alias("n_edges"), F.sum(F.coalesce("count", F.lit(0))).alias("total"))


@query(
    "dangling_edges",
    graph_sql(""", n AS (SELECT id FROM g_nodes WHERE repo <> 'ASIA') SELECT kind, count(*) AS dropped FROM g_edges
    WHERE NOT (src_id IN (FROM n) AND dst_id IN (FROM n)) GROUP BY kind"""),
)
def dangling_edges(spark, d):
    return q.dangling_edges(g.nodes(spark, d).where("repo <> 'ASIA'"), g.edges(spark, d))


def _lanes(spark, d):
    n = g.nodes(spark, d).where("kind = 'method'")
    return [n.withColumn("visibility", F.lit(None).cast("string")), n.select("id", "kind", F.concat("repo", F.lit("/2")).alias("repo"), "qualified_name", "short_name", "file", F.lit("zz").alias("ast_hash"), F.lit("public").alias("visibility")).where("id like '%1'")]


@query(
    "upsert_symbols",
    graph_sql(""" SELECT id, ast_hash, CASE WHEN id LIKE '%1' THEN repo || '/2' ELSE repo END AS repo, CASE WHEN id LIKE '%1' THEN 'public' END AS visibility FROM g_nodes WHERE kind = 'method'"""),
)
def upsert_symbols(spark, d):
    return q.upsert_symbols(_lanes(spark, d)).select("id", "ast_hash", "repo", "visibility")


@query("merge_append", graph_sql(" SELECT id, CASE WHEN id LIKE '%1' THEN repo || '/2' ELSE repo END AS repo FROM g_nodes WHERE kind = 'method'"))
def merge_append(spark, d):
    old, new = _lanes(spark, d)
    return q.merge_append(old.select("id", "repo"), new.select("id", "repo"), "id")


@query("centrality_top_k", graph_sql(" SELECT dst_id AS id, count(*) AS in_degree FROM g_edges GROUP BY dst_id ORDER BY in_degree DESC, id LIMIT 25"))
def centrality_top_k(spark, d):
    return q.top_k(g.edges(spark, d).groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("in_degree")), "in_degree", 25)


@query(
    "correspondence",
    """WITH s AS (SELECT DISTINCT source || '/' || lang || '.txt' AS path FROM documents), gph AS (SELECT DISTINCT CASE WHEN lang = 'fr' THEN 'x/' || source || '/fr.txt' WHEN lang = 'de' THEN 'y/de.txt' ELSE source || '/' || lang || '.txt' END AS path FROM documents WHERE lang <> 'es')
    SELECT level, count(*) AS n FROM (SELECT path, CASE WHEN path IN (FROM gph) THEN 'exact' WHEN EXISTS (SELECT 1 FROM gph WHERE ends_with(gph.path, '/' || s.path)) THEN 'suffix'
      WHEN EXISTS (SELECT 1 FROM gph WHERE split_part(gph.path, '/', -1) = split_part(s.path, '/', -1)) THEN 'basename' ELSE 'none' END AS level FROM s) GROUP BY level""",
)
def correspondence(spark, d):
    docs = g.table(spark, d, "documents").select("source", "lang")
    plain = F.concat("source", F.lit("/"), "lang", F.lit(".txt"))
    moved = F.when(F.col("lang") == "fr", F.concat(F.lit("x/"), "source", F.lit("/fr.txt"))).when(F.col("lang") == "de", "y/de.txt").otherwise(plain)
    return census.correspondence(docs.where("lang <> 'es'").select(moved.alias("path")), docs.select(plain.alias("path")))


@query("graph_cypher", graph_sql(""" SELECT n.repo AS "a.repo", e.kind, count(*) AS n FROM g_edges e JOIN g_nodes n ON n.id = e.src_id JOIN g_nodes b ON b.id = e.dst_id WHERE e.kind IN ('READS_FIELD', 'RAISES') AND b.repo <> 'Brand#1' GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 10"""))
def graph_cypher(spark, d):
    from tessera.plans.cypher import cypher

    text = "MATCH (a:function)-[r:READS_FIELD|RAISES]->(b) WHERE b.repo <> $repo RETURN a.repo, r.kind AS kind, count(b) AS n ORDER BY n DESC, a.repo, kind LIMIT 10"
    return cypher(g.nodes(spark, d), g.edges(spark, d), text, {"repo": "Brand#1"})
