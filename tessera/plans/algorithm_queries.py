"""Queries: iterative and local graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as g
from tessera.operators import graph_algorithms as a, local_graphs as lg
from tessera.plans.mining_queries import r6
from tessera.registry import graph_sql, query



@query("collapse_multigraph", graph_sql(' SELECT src_id, dst_id, sum(1 + coalesce("count", 0))::BIGINT AS weight FROM g_edges GROUP BY ALL'))
def collapse_multigraph(spark, d):
    return a.collapse(g.edge_sets(spark, d))


def _rank_sql(rounds: int) -> str:
    parts = [
        "w AS (SELECT src_id, dst_id, sum(1 + coalesce(\"count\", 0))::DOUBLE AS weight FROM g_edges GROUP BY ALL)",
        "sh AS (SELECT src_id, dst_id, weight / sum(weight) OVER (PARTITION BY src_id) AS share FROM w)",
        "ids AS (SELECT id, count(*) OVER () AS n, id IN (SELECT src_id FROM w) AS has_out FROM g_nodes)",
        "r0 AS (SELECT id, has_out, n, 1.0::DOUBLE / n AS rank FROM ids)",
    ]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT i.id, i.has_out, i.n, 0.15::DOUBLE / i.n + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT coalesce(sum(rank) FILTER (NOT has_out), 0) FROM {p}) / i.n) AS rank FROM ids i LEFT JOIN (SELECT dst_id, sum(rank * share) AS got FROM {p} JOIN sh ON src_id = {p}.id GROUP BY dst_id) ON dst_id = i.id)"
        )
    return graph_sql(", " + ", ".join(parts) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}")


@query("pagerank", _rank_sql(20))
def pagerank(spark, d):
    return a.pagerank(g.nodes(spark, d), a.collapse(g.edge_sets(spark, d))).select("id", F.round("rank", 9).alias("rank"))


@query("reach", graph_sql(", r AS (SELECT 'R:1' AS id UNION SELECT dst_id FROM r JOIN g_edges ON src_id = r.id WHERE kind IN ('CONTAINS', 'CALLS')) SELECT id FROM r"))
def reach(spark, d):
    return a.reach(g.edges(spark, d).where("kind in ('CONTAINS', 'CALLS')"), spark.createDataFrame([("R:1",)], "id string")).select("id")


@query(
    "blast_radius",
    graph_sql(""", r AS (SELECT 'P:1' AS id UNION SELECT src_id FROM r JOIN g_edges ON dst_id = r.id WHERE kind <> 'EXTENDS'), s AS (SELECT count(*) AS size, count(DISTINCT repo) AS modules FROM r JOIN g_nodes USING (id))
    SELECT size, modules, size + 4 * greatest(0, modules - 1) AS blast FROM s"""),
)
def blast_radius(spark, d):
    up = a.reach(g.edges(spark, d).where("kind <> 'EXTENDS'"), spark.createDataFrame([("P:1",)], "id string"), reverse=True)
    s = up.join(g.nodes(spark, d), "id").agg(F.count("*").alias("size"), F.count_distinct("repo").alias("modules"))
    return s.withColumn("blast", F.col("size") + 4 * F.greatest(F.lit(0), F.col("modules") - 1))


@query("containment_components", graph_sql(", b AS (SELECT src_id AS a, dst_id AS b FROM g_edges WHERE kind = 'CONTAINS' UNION SELECT dst_id, src_id FROM g_edges WHERE kind = 'CONTAINS'), r AS (SELECT a, a AS b FROM b UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a WHERE b.b LIKE 'R:%' OR b.b LIKE 'N:%') SELECT a AS id, min(b) FILTER (b LIKE 'N:%' OR b LIKE 'R:%') AS nearest FROM r GROUP BY a"))
def containment_components(spark, d):
    """Components of the containment forest, named by the smallest namespace in them."""
    e = g.edges(spark, d).where("kind = 'CONTAINS'")
    c = a.components(e)
    named = c.where("id like 'N:%' or id like 'R:%'").groupBy("component").agg(F.min("id").alias("nearest"))
    return c.join(named, "component").select("id", "nearest")


@query("orbit_signature", graph_sql(""", bo AS (SELECT src_id AS id, dst_id AS other, 'o:' || kind AS arm FROM g_edges UNION ALL SELECT dst_id, src_id, 'i:' || kind FROM g_edges), s AS (SELECT b.id, arm || ':' || n.kind || '=' || count(*) AS x FROM bo b JOIN g_nodes n ON n.id = b.other GROUP BY b.id, arm, n.kind)
SELECT n.id, substr(sha256(n.kind || '|' || coalesce((SELECT string_agg(x, ';' ORDER BY x) FROM s WHERE s.id = n.id), '')), 1, 16) AS signature FROM g_nodes n"""))
def orbit_signature(spark, d):
    return a.orbit_signature(g.edges(spark, d), g.nodes(spark, d).select("id", F.col("kind").alias("label")))


@query("name_bridges", """WITH n AS (SELECT p_partkey AS id, p_brand AS repo, lower(p_name) AS short_name FROM part), m AS (SELECT a.id AS src_id, b.id AS dst_id, row_number() OVER (PARTITION BY a.id, b.repo ORDER BY b.id) AS rn FROM n a JOIN n b USING (short_name) WHERE a.repo < b.repo AND length(short_name) > 2) SELECT src_id, dst_id FROM m WHERE rn <= 3""")
def name_bridges(spark, d):
    return a.name_bridges(g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.lower("p_name").alias("short_name")))


def _sides(spark, d):
    """Two copies of the graph, the second with other ids, and candidates by position."""
    e = g.edges(spark, d)
    new = lambda c: F.concat(F.lit("x"), c)
    t = e.select(new("src_id").alias("src_id"), new("dst_id").alias("dst_id"), "kind")
    ids = e.select(F.col("src_id").alias("s")).unionByName(e.select(F.col("dst_id").alias("s"))).distinct()
    same = F.struct(new("s").alias("t"), F.lit(0.9).alias("sigma"))
    near = F.when(F.col("s").startswith("C:"), F.struct(F.concat(F.lit("xC:"), (F.substring("s", 3, 20).cast("long") + 1).cast("string")).alias("t"), F.lit(0.88).alias("sigma")))
    return e, t, ids.select("s", F.explode(F.array_compact(F.array(same, near))).alias("c")).select("s", "c.t", "c.sigma")


@query("functor_map", None)
def functor_map(spark, d):
    """Flooding, matching, fidelity between a graph and its renamed copy."""
    s, t, cand = _sides(spark, d)
    m = a.greedy_matching(a.flood_similarity(s, t, cand))
    return a.map_fidelity(s, t, m)


def _repo_edges(spark, d):
    """The whole collapsed graph; an edge is in its source's repo."""
    n = g.nodes(spark, d).select(F.col("id").alias("src_id"), "repo")
    return a.collapse(g.edge_sets(spark, d)).join(n, "src_id").select("repo", "src_id", "dst_id", F.col("weight").cast("double").alias("weight"))


@query("louvain_subsystems", None)
def louvain_subsystems(spark, d):
    return lg.subsystems(_repo_edges(spark, d))


@query("articulation_points", None)
def articulation_points(spark, d):
    return lg.articulation_points(_repo_edges(spark, d))


@query("betweenness", None)
def betweenness(spark, d):
    return lg.betweenness(_repo_edges(spark, d), directed=True)


@query("persistence", None)
def persistence(spark, d):
    return lg.persistence_h0(_repo_edges(spark, d))


def _eigen_sql(rounds: int) -> str:
    parts = ["w AS (SELECT src_id, dst_id, sum(1 + coalesce(\"count\", 0))::DOUBLE AS weight FROM g_edges GROUP BY ALL)", "r0 AS (SELECT src_id AS id, 1.0::DOUBLE AS score FROM w UNION SELECT dst_id, 1.0::DOUBLE FROM w)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        parts.append(f"s{k} AS MATERIALIZED (SELECT id, score + coalesce(got, 0) AS score FROM {p} LEFT JOIN (SELECT dst_id, sum(score * weight) AS got FROM {p} JOIN w ON src_id = id GROUP BY dst_id) ON dst_id = id)")
        parts.append(f"r{k} AS MATERIALIZED (SELECT id, score / (SELECT sqrt(sum(score * score)) FROM s{k}) AS score FROM s{k})")
    return graph_sql(", " + ", ".join(parts) + f" SELECT id, round(score, 6) AS score FROM r{rounds}")


@query("eigenvector", _eigen_sql(50))
def eigenvector(spark, d):
    return a.eigenvector(a.collapse(g.edge_sets(spark, d))).select("id", *r6("score"))


_MOVES = "SELECT 'u' || user_id % 60 AS src_id, 'u' || event_id * 7 % 60 AS dst_id FROM events WHERE event_type = 'error' AND user_id % 60 < 45 AND (event_id * 7 % 60 < 30) = (user_id % 60 < 30)"


def _moves(spark, d):
    a_, b_ = F.col("user_id") % 60, F.col("event_id") * 7 % 60
    e = g.table(spark, d, "events").where(F.col("event_type") == "error").where((a_ < 45) & ((b_ < 30) == (a_ < 30)))
    return e.select(F.concat(F.lit("u"), a_.cast("string")).alias("src_id"), F.concat(F.lit("u"), b_.cast("string")).alias("dst_id"))


@query("strong_components", f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_MOVES}) WHERE src_id <> dst_id), r AS (SELECT src_id AS a, dst_id AS b FROM e UNION SELECT r.a, e.dst_id FROM r JOIN e ON e.src_id = r.b) SELECT x.a AS id, max(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a IN (SELECT a FROM r WHERE a = b) GROUP BY x.a")
def strong_components(spark, d):
    return a.scc(_moves(spark, d))


@query("group_closure", """WITH RECURSIVE n AS (SELECT member, last(parent ORDER BY moment) AS parent FROM (SELECT user_id AS member, CASE WHEN event_id % 9 <> 0 THEN event_id * 13 % 150 END AS parent, event_id AS moment FROM events) GROUP BY member),
l AS (SELECT * FROM n WHERE parent IS NOT NULL AND parent <> member), r AS (SELECT member, parent AS ancestor FROM l UNION SELECT r.member, l.parent FROM r JOIN l ON l.member = r.ancestor) SELECT * FROM r""")
def group_closure(spark, d):
    e = g.table(spark, d, "events").select(F.col("user_id").alias("member"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") * 13 % 150).alias("parent"), F.col("event_id").alias("at"))
    return a.upward_closure(e)


@query("arc_consistency", graph_sql(""", ids AS (SELECT src_id AS s FROM g_edges UNION SELECT dst_id FROM g_edges), c AS (SELECT s, 'x' || s AS t, 0.9::DOUBLE AS sigma FROM ids UNION ALL SELECT s, 'xC:' || (substr(s, 3)::BIGINT + 1), 0.88 FROM ids WHERE s LIKE 'C:%'),
sa AS (SELECT src_id AS s, dst_id AS sn, 'o:' || kind AS arm FROM g_edges UNION SELECT dst_id, src_id, 'i:' || kind FROM g_edges), ta AS (SELECT 'x' || s AS t, 'x' || sn AS tn, arm FROM sa),
h AS (SELECT s, t, count(*) AS held FROM (SELECT DISTINCT c.s, c.t, sa.arm, sa.sn FROM c JOIN sa ON sa.s = c.s JOIN c d ON d.s = sa.sn JOIN ta ON ta.t = c.t AND ta.arm = sa.arm AND ta.tn = d.t) GROUP BY s, t), dg AS (SELECT s, count(*) AS deg FROM sa GROUP BY s),
j AS (SELECT c.*, coalesce(held, 0) >= ceil(0.25 * coalesce(deg, 0)) AS ok FROM c LEFT JOIN h ON h.s = c.s AND h.t = c.t LEFT JOIN dg ON dg.s = c.s)
SELECT s, count(*) AS n, min(t) AS first_t FROM (SELECT s, t FROM j WHERE ok UNION ALL SELECT s, arg_min(t, (-sigma, t)) FROM j WHERE s NOT IN (SELECT s FROM j WHERE ok) GROUP BY s) GROUP BY s"""))
def arc_consistency(spark, d):
    s, t, cand = _sides(spark, d)
    return a.arc_consistent(s, t, cand).groupBy("s").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


_USES = "SELECT DISTINCT 'f' || user_id % 40 AS feature, 'k' || event_id % 97 AS kind FROM events WHERE event_id % 97 % 20 = user_id % 40 % 20"


@query("wave_schedule", f"""WITH RECURSIVE u AS ({_USES}), l AS (SELECT * FROM u WHERE kind NOT IN ('k0', 'k20', 'k40')), e AS (SELECT x.feature AS a, y.feature AS b FROM l x JOIN l y USING (kind)), f AS (SELECT DISTINCT feature FROM u),
r AS (SELECT feature AS a, feature AS b FROM f UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS feature, min(b) AS comp FROM r GROUP BY a), k AS (SELECT comp, count(*) AS n_shared FROM (SELECT kind, any_value(comp) AS comp FROM l JOIN c USING (feature) GROUP BY kind HAVING count(*) > 1) GROUP BY comp)
SELECT row_number() OVER (ORDER BY count(*) DESC, comp) AS wave, comp AS first_feature, count(*) AS n_features, coalesce(any_value(n_shared), 0) AS n_shared FROM c LEFT JOIN k USING (comp) GROUP BY comp""")
def wave_schedule(spark, d):
    uses = g.table(spark, d, "events").where("event_id % 97 % 20 = user_id % 40 % 20").select(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("feature"), F.concat(F.lit("k"), (F.col("event_id") % 97).cast("string")).alias("kind"))
    frozen = spark.createDataFrame([("k0",), ("k20",), ("k40",)], "kind string")
    return a.wave_clusters(uses, frozen).withColumn("wave", F.col("wave").cast("long"))
