"""Queries: module boundaries and role composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as g
from tessera.operators import modules as m, roles as r
from tessera.plans.mining_queries import r6
from tessera.registry import graph_sql, query

#: The given partition: a node's repo; part types are in none.
MEM = ", mem AS (SELECT id, repo AS module FROM g_nodes WHERE kind <> 'type_alias')"
CROSS = MEM + """, cr AS (SELECT e.*, a.module AS su, b.module AS sv, coalesce(nullif("count", 0), 1) AS weight FROM g_edges e LEFT JOIN mem a ON a.id = e.src_id LEFT JOIN mem b ON b.id = e.dst_id
  WHERE e.kind <> 'CONTAINS' AND src_id <> dst_id AND a.module IS DISTINCT FROM b.module)"""


def members(spark, d):
    return g.nodes(spark, d).where("kind <> 'type_alias'").select("id", F.col("repo").alias("module"))


@query(
    "interfaces",
    graph_sql(CROSS + """ SELECT module, direction, edge_kind, internal_id, external_module, sum(weight)::BIGINT AS edge_count FROM (
      SELECT sv AS module, 'provides' AS direction, kind AS edge_kind, dst_id AS internal_id, su AS external_module, weight FROM cr WHERE sv IS NOT NULL
      UNION ALL SELECT su, 'consumes', kind, src_id, sv, weight FROM cr WHERE su IS NOT NULL) GROUP BY ALL"""),
)
def interfaces(spark, d):
    return m.interfaces(g.edges(spark, d), members(spark, d))


@query(
    "data_shapes",
    graph_sql(MEM + """, u AS (SELECT n.id, f.module, e.src_id, e.kind, coalesce(f.module = x.module, false) AS inside FROM g_nodes n LEFT JOIN mem f ON f.id = n.id
      LEFT JOIN (SELECT * FROM g_edges WHERE kind IN ('READS_FIELD', 'WRITES_FIELD', 'CONSTRUCTS')) e ON e.dst_id = n.id LEFT JOIN mem x ON x.id = e.src_id WHERE n.kind = 'field'),
    s AS (SELECT id, module, count(DISTINCT src_id) FILTER (kind = 'CONSTRUCTS') AS constructed_by, coalesce(bool_or(kind = 'READS_FIELD' AND inside), false) AS read_inside, coalesce(bool_or(kind = 'READS_FIELD' AND NOT inside), false) AS read_outside,
      coalesce(bool_or(kind = 'WRITES_FIELD' AND inside), false) AS written_inside, coalesce(bool_or(kind = 'WRITES_FIELD' AND NOT inside), false) AS written_outside FROM u GROUP BY id, module)
    SELECT *, read_outside OR written_outside AS boundary FROM s"""),
)
def data_shapes(spark, d):
    return m.data_shapes(g.nodes(spark, d), g.edges(spark, d), members(spark, d))


@query(
    "alphabet_coverage",
    graph_sql(""", c AS (SELECT repo, count(*) FILTER (e.kind = 'TYPE_OF') AS type_of, count(*) FILTER (e.kind = 'RETURNS_TYPE') AS returns_type, count(*) FILTER (e.kind = 'CONSTRUCTS') AS constructs,
      count(*) FILTER (e.kind = 'READS_FIELD') AS reads_field, count(*) FILTER (e.kind = 'WRITES_FIELD') AS writes_field FROM g_edges e JOIN g_nodes n ON n.id = e.src_id GROUP BY repo),
    k AS (SELECT *, (type_of > 0)::BIGINT + (returns_type > 0)::BIGINT + (constructs > 0)::BIGINT + (reads_field > 0)::BIGINT + (writes_field > 0)::BIGINT AS n_kinds FROM c) SELECT *, n_kinds < 3 AS thin FROM k"""),
)
def alphabet_coverage(spark, d):
    return m.alphabet_coverage(g.nodes(spark, d), g.edges(spark, d))


@query(
    "boundary_quality",
    graph_sql(MEM + """, p AS (SELECT a.module AS su, b.module AS sv, count(*) AS n FROM g_edges e JOIN mem a ON a.id = e.src_id JOIN mem b ON b.id = e.dst_id WHERE e.kind <> 'CONTAINS' GROUP BY ALL),
    s AS (SELECT su AS module, sv AS other, n FROM p UNION ALL SELECT sv, su, n FROM p WHERE su <> sv),
    q AS (SELECT module, coalesce(sum(n) FILTER (module <> other), 0)::BIGINT AS crossing, coalesce(sum(n) FILTER (module = other), 0)::BIGINT AS internal, count(DISTINCT other) FILTER (module <> other) AS n_neighbours FROM s GROUP BY module)
    SELECT *, round(crossing / (crossing + internal), 6) AS share FROM q"""),
)
def boundary_quality(spark, d):
    return m.boundary_quality(g.nodes(spark, d), g.edges(spark, d), members(spark, d)).select("module", "crossing", "internal", "n_neighbours", *r6("share"))


@query(
    "ari",
    """WITH l AS (SELECT label AS a, CASE WHEN vec_id % 3 = 0 THEN label ELSE vec_id % 10 END AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL),
    x AS (SELECT sum(n * (n - 1) / 2) AS both_n, sum(n) * (sum(n) - 1) / 2 AS total FROM c), y AS (SELECT sum(n * (n - 1) / 2) AS l FROM (SELECT sum(n) AS n FROM c GROUP BY a)), z AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY b))
    SELECT round((both_n - l * r / total) / ((l + r) / 2 - l * r / total), 6) AS ari FROM x, y, z""",
)
def ari(spark, d):
    v = g.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("a"), F.when(F.col("vec_id") % 3 == 0, F.col("label").cast("long")).otherwise(F.col("vec_id") % 10).alias("b"))
    return m.adjusted_rand_index(v).select(*r6("ari"))


@query(
    "partition_stability",
    """WITH l AS (SELECT label AS before, CASE WHEN vec_id % 3 = 0 THEN label ELSE vec_id % 10 END AS after FROM embeddings), c AS (SELECT before, after, count(*) AS n FROM l GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY before) AS total, row_number() OVER (PARTITION BY before ORDER BY n DESC, after) AS rn FROM c)
    SELECT before, after AS image, total::BIGINT AS n, (total - n)::BIGINT AS moved FROM r WHERE rn = 1""",
)
def partition_stability(spark, d):
    return m.partition_stability(g.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("before"), F.when(F.col("vec_id") % 3 == 0, F.col("label").cast("long")).otherwise(F.col("vec_id") % 10).alias("after")))


@query(
    "restructure_moves",
    graph_sql(MEM + """, b AS (SELECT src_id AS id, dst_id AS other FROM g_edges UNION ALL SELECT dst_id, src_id FROM g_edges), lk AS (SELECT b.id, x.module AS target, count(*) AS n FROM b JOIN mem x ON x.id = b.other GROUP BY ALL),
    j AS (SELECT mem.id, mem.module, target, n, coalesce(sum(n) FILTER (target = mem.module) OVER (PARTITION BY mem.id), 0)::BIGINT AS own_links, row_number() OVER (PARTITION BY mem.id ORDER BY target = mem.module, n DESC, target) AS rn FROM mem JOIN lk ON lk.id = mem.id)
    SELECT id, module, target, own_links, n AS target_links FROM j WHERE rn = 1 AND target <> module AND n > own_links"""),
)
def restructure_moves(spark, d):
    return m.realign_moves(g.edges(spark, d), members(spark, d))


@query(
    "split_merge",
    graph_sql(""", c AS (SELECT repo AS island, kind AS module, count(*) AS n FROM g_nodes GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY island) AS share, row_number() OVER (PARTITION BY island ORDER BY n DESC, module) AS rn FROM c),
    p AS (SELECT island, max(module) FILTER (rn = 1) AS dominant, count(*) FILTER (share >= 0.2) AS large FROM s GROUP BY island)
    SELECT island, CASE WHEN large >= 2 THEN 'SPLIT' WHEN count(*) OVER (PARTITION BY dominant) >= 2 THEN 'MERGE' ELSE 'KEEP' END AS verdict, dominant FROM p"""),
)
def split_merge(spark, d):
    return m.split_merge(g.nodes(spark, d).select("id", F.col("repo").alias("island"), F.col("kind").alias("module")))


@query(
    "longest_prefix_home",
    "SELECT path AS file, max_by(m, length(m)) AS module FROM (SELECT DISTINCT source || '/' || lang || '/' || (doc_id % 5) AS path FROM documents) p JOIN (SELECT DISTINCT source AS m FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents WHERE lang <> 'en') x ON starts_with(path || '/', m || '/') GROUP BY path",
)
def longest_prefix_home(spark, d):
    docs = g.table(spark, d, "documents")
    two = F.concat_ws("/", "source", "lang")
    files = docs.select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 5).cast("string")).alias("file")).distinct()
    homes = docs.select(F.col("source").alias("prefix")).unionByName(docs.where("lang <> 'en'").select(two.alias("prefix"))).distinct()
    return m.longest_prefix(files, homes.withColumn("module", F.col("prefix")))


#: Consecutive turns of a conversation as edges between roles; the module is the conversation's id modulo 7.
TYPED = """WITH t AS (SELECT conv_id, turn, role, lead(turn) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ed AS (SELECT DISTINCT conv_id || ':' || turn AS src_id, conv_id || ':' || nt AS dst_id, 'CALLS' AS kind, conv_id AS module, role || (turn % 3) AS src_role, nr || (nt % 3) AS dst_role FROM t WHERE nt IS NOT NULL
  UNION SELECT DISTINCT c.conv_id || ':' || c.turn, c.conv_id || ':0', 'REFERENCES', c.conv_id, c.role || (c.turn % 3), z.role || '0' FROM conversations c JOIN conversations z ON z.conv_id = c.conv_id AND z.turn = 0 WHERE c.turn > 0)"""


def typed(spark, d):
    c = g.table(spark, d, "conversations").select("conv_id", "turn", "role")
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    node = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    roles = c.select(node(F.col("turn")).alias("id"), F.col("conv_id").alias("module"), F.concat("role", (F.col("turn") % 3).cast("string")).alias("role"))
    calls = c.withColumn("nt", F.lead("turn").over(w)).where("nt is not null").select(node(F.col("turn")).alias("src_id"), node(F.col("nt")).alias("dst_id"), F.lit("CALLS").alias("kind"))
    refs = c.where("turn > 0").select(node(F.col("turn")).alias("src_id"), node(F.lit(0)).alias("dst_id"), F.lit("REFERENCES").alias("kind"))
    return r.typed_edges(calls.unionByName(refs), roles)


@query(
    "operad_paths",
    TYPED + """, one AS (SELECT src_role || '>' || dst_role AS roles, kind AS kinds, count(*) AS support, 1 AS length FROM ed GROUP BY ALL),
    two AS (SELECT a.src_role || '>' || a.dst_role || '>' || b.dst_role AS roles, a.kind || '>' || b.kind AS kinds, count(*) AS support, 2 AS length FROM ed a JOIN ed b ON a.dst_id = b.src_id AND a.module = b.module AND a.src_id <> b.dst_id GROUP BY ALL)
    SELECT * FROM (FROM one UNION ALL FROM two) WHERE support >= 2""",
)
def operad_paths(spark, d):
    return r.path_ops(typed(spark, d))


@query(
    "operad_fan_in",
    TYPED + """, p AS (SELECT dst_id, dst_role, string_agg(DISTINCT src_role, ',' ORDER BY src_role) AS ins, string_agg(DISTINCT kind, ',' ORDER BY kind) AS ks, count(DISTINCT src_role) AS k FROM ed WHERE src_role <> dst_role GROUP BY ALL)
    SELECT dst_role AS output_role, ins AS input_roles, ks AS kinds, count(*) AS support FROM p WHERE k >= 2 GROUP BY ALL HAVING count(*) >= 2""",
)
def operad_fan_in(spark, d):
    return r.fan_in_ops(typed(spark, d))


_GEN = TYPED + ", gen AS (SELECT src_role AS i, dst_role AS j, count(*) AS support FROM ed GROUP BY ALL HAVING count(*) >= 2)"


@query(
    "operad_violations",
    _GEN + """ SELECT 'missing_composite' AS kind, x.i || '>' || x.j || '>' || y.j AS roles, least(x.support, y.support) AS support FROM gen x JOIN gen y ON x.j = y.i WHERE x.i <> x.j AND y.i <> y.j AND x.i <> y.j
      AND NOT EXISTS (SELECT 1 FROM gen z WHERE z.i = x.i AND z.j = y.j) UNION ALL SELECT 'back_call_cycle', x.i || '>' || x.j, least(x.support, y.support) FROM gen x JOIN gen y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j""",
)
def operad_violations(spark, d):
    return r.violations(r.generators(typed(spark, d)))


@query("unit_like_roles", _GEN + " SELECT x.j AS role, count(DISTINCT (x.i, y.j)) AS n FROM gen x JOIN gen y ON x.j = y.i JOIN gen z ON z.i = x.i AND z.j = y.j WHERE x.i <> x.j AND y.i <> y.j AND x.i <> y.j GROUP BY x.j")
def unit_like_roles(spark, d):
    return r.unit_like(r.generators(typed(spark, d)))
