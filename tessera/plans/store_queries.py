"""Queries: identifiers, paths, clocks, sinks, profile neighbours and summaries of modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as g
from tessera.functions import text as t
from tessera.operators import sinks as k, similarity as s
from tessera.plans.mining_queries import r6
from tessera.plans.structure_queries import MEM, members
from tessera.registry import graph_sql, query

_NAME = "p_name || 'HTTPServer' || p_partkey || '_of_' || p_type"


def _names(spark, d):
    part = g.table(spark, d, "part")
    return part.select("p_partkey", F.concat("p_name", F.lit("HTTPServer"), F.col("p_partkey").cast("string"), F.lit("_of_"), "p_type").alias("name"))


_TOK = "[x FOR x IN regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')), '[^a-z0-9]+') IF x <> '']"


@query("identifier_tokens", f"SELECT p_partkey, array_to_string({_TOK}, ' ') AS tokens, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS folded FROM (SELECT p_partkey, {_NAME} AS name FROM part)")
def identifier_tokens(spark, d):
    return _names(spark, d).select("p_partkey", F.array_join(t.identifier_tokens(F.col("name")), " ").alias("tokens"), t.folded(F.col("name")).alias("folded"))


@query("name_tokens", f"SELECT token, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest({_TOK}) AS token FROM (SELECT p_partkey, {_NAME} AS name FROM part)) WHERE length(token) >= 2 AND token NOT IN ('a', 'an', 'and', 'for', 'of', 'on', 'or', 'the', 'to', 'with') GROUP BY token")
def name_tokens(spark, d):
    return _names(spark, d).select(F.explode(t.name_tokens(F.col("name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("paths", graph_sql(r""" SELECT split_part(qualified_name, '::', -1) AS last_part, split_part(file, '/', 1) AS folder, regexp_replace(regexp_replace(regexp_replace(replace('.\x\\' || file || '/', '\', '/'), '/+', '/', 'g'), '^(\./)+', ''), '(.)/$', '\1') AS path, count(*) AS n FROM g_nodes WHERE kind IN ('namespace', 'class', 'type_alias') GROUP BY ALL"""))
def paths(spark, d):
    n = g.nodes(spark, d).where("kind in ('namespace', 'class', 'type_alias')")
    rows = n.select(t.last_segment(F.col("qualified_name")).alias("last_part"), t.folder(F.col("file"), 1).alias("folder"), t.normal_path(F.concat(F.lit(".\\x\\\\"), "file", F.lit("/"))).alias("path"))
    return rows.groupBy("last_part", "folder", "path").agg(F.count("*").alias("n"))


@query("hlc_clocks", """WITH e AS (SELECT event_id AS i, epoch_us(ts) // 1000000 AS p, event_id % 5 AS l, epoch_us(ts) // 1000000 + event_id % 7 - 3 AS now, epoch_us(ts) // 1000000 + event_id % 3 - 1 AS op, event_id % 4 AS ol FROM events)
SELECT i AS event_id, p AS physical, greatest(p, now) AS ticked, CASE WHEN now > p THEN 0 ELSE l + 1 END AS ticked_logical, greatest(p, now, op) AS received,
CASE WHEN p = greatest(p, now, op) AND op = greatest(p, now, op) THEN greatest(l, ol) + 1 WHEN p = greatest(p, now, op) THEN l + 1 WHEN op = greatest(p, now, op) THEN ol + 1 ELSE 0 END AS received_logical FROM e""")
def hlc_clocks(spark, d):
    p = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    i = F.col("event_id")
    text = lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"), F.lit("r:1"))
    e = g.table(spark, d, "events").select("event_id", t.hlc_parse(text(p, i % 5)).alias("c"), t.hlc_parse(text(p + i % 3 - 1, i % 4)).alias("o"), (p + i % 7 - 3).alias("now"))
    tick, got = t.hlc_tick(F.col("c"), F.col("now")), t.hlc_receive(F.col("c"), F.col("o"), F.col("now"))
    return e.select("event_id", F.col("c.physical").alias("physical"), tick["physical"].alias("ticked"), tick["logical"].alias("ticked_logical"), got["physical"].alias("received"), got["logical"].alias("received_logical"))


@query("file_delete", graph_sql(""", gone AS (SELECT id FROM g_nodes WHERE file = 'ASIA/function'), e AS (SELECT kind, count(*) AS n FROM g_edges WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone) GROUP BY kind)
SELECT 'edge ' || kind AS what, n FROM e UNION ALL SELECT 'node ' || kind, count(*) FROM g_nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY kind"""))
def file_delete(spark, d):
    files = spark.createDataFrame([("ASIA", "ASIA/function")], "repo string, file string")
    n, e = k.delete_files(g.nodes(spark, d), g.edges(spark, d), files)
    count = lambda df, name: df.groupBy(F.concat(F.lit(name), "kind").alias("what")).agg(F.count("*").alias("n"))
    return count(e, "edge ").unionByName(count(n, "node "))


@query("slice_replace", "SELECT n_nationkey AS nation, count(*) AS n, round(sum(bal), 2) AS balance FROM (SELECT c_nationkey AS n_nationkey, c_acctbal AS bal FROM customer WHERE c_nationkey % 2 = 1 UNION ALL SELECT s_nationkey, s_acctbal FROM supplier WHERE s_nationkey % 2 = 0 UNION ALL SELECT c_nationkey, c_acctbal FROM customer WHERE c_nationkey % 2 = 0 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) GROUP BY 1")
def slice_replace(spark, d):
    stored = g.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    new = g.table(spark, d, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return k.replace_slice(stored, new, ["nation"]).groupBy("nation").agg(F.count("*").alias("n"), F.round(F.sum("bal"), 2).alias("balance"))


@query("append_once", "SELECT o_custkey AS row_id, min(o_orderkey) AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey % 2 = 0")
def append_once(spark, d):
    stored = g.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("row_id"), F.lit(-1).cast("long").alias("value"))
    return k.append_once(stored, g.table(spark, d, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderkey").alias("value")), "row_id")


@query("health_latest", "SELECT user_id AS repo, event_id % 3 AS branch, max(event_id) AS seq, arg_max(event_type, event_id) AS state FROM events GROUP BY ALL")
def health_latest(spark, d):
    h = g.table(spark, d, "events").select(F.col("user_id").alias("repo"), (F.col("event_id") % 3).alias("branch"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return k.latest(h, ["repo", "branch"], "seq")


@query("empty_strings", "SELECT count(*) FILTER (h = '') AS empty, count(*) AS n FROM (SELECT coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, '') AS h FROM orders)")
def empty_strings(spark, d):
    rows = g.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("h"))
    return k.without_nulls(rows, ["h"]).agg(F.count_if(F.col("h") == "").alias("empty"), F.count("*").alias("n"))


@query("module_histogram", graph_sql(MEM + " SELECT a.module, kind, count(*) AS n FROM g_edges e JOIN mem a ON a.id = src_id JOIN mem b ON b.id = dst_id WHERE a.module = b.module GROUP BY ALL"))
def module_histogram(spark, d):
    """Edges by kind among the members of a module."""
    own = members(spark, d)
    met = g.edges(spark, d).join(own.select(F.col("id").alias("src_id"), "module"), "src_id").join(own.select(F.col("id").alias("dst_id"), F.col("module").alias("other")), "dst_id")
    return met.where("module = other").groupBy("module", "kind").agg(F.count("*").alias("n"))


@query("lane_merge", """WITH RECURSIVE e AS (SELECT DISTINCT 'a' || user_id AS x, 'b' || event_id * 11 % 400 AS y FROM events WHERE event_id % 90 = 0), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x, x AS y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y) SELECT x AS id, min(y) AS lane FROM r GROUP BY x""")
def lane_merge(spark, d):
    """Ids that lanes give the same thing, merged into one by the smallest of them."""
    from tessera.operators.graph_algorithms import components

    e = g.table(spark, d, "events").where("event_id % 90 = 0").select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("src_id"), F.concat(F.lit("b"), (F.col("event_id") * 11 % 400).cast("string")).alias("dst_id"))
    return components(e).select("id", F.col("component").alias("lane"))


@query(
    "profile_knn",
    """WITH p AS (SELECT l_suppkey AS id, l_suppkey % 3 AS repo, [count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'N'), count(*) FILTER (l_returnflag = 'R'), count(DISTINCT l_orderkey), count(*) FILTER (l_linestatus = 'F')]::DOUBLE[] AS v FROM lineitem GROUP BY 1), s AS (SELECT * FROM p WHERE id = 1)
    SELECT p.id, p.repo, round(1 - list_cosine_similarity(p.v, s.v), 6) AS distance FROM p, s WHERE p.id <> 1 AND p.repo <> s.repo ORDER BY round(1 - list_cosine_similarity(p.v, s.v), 9), p.id LIMIT 15""",
)
def profile_knn(spark, d):
    """Neighbours of a node by its profile, in other repos only."""
    of = lambda cond: F.count_if(cond).cast("double")
    vec = F.array(of(F.col("l_returnflag") == "A"), of(F.col("l_returnflag") == "N"), of(F.col("l_returnflag") == "R"), F.count_distinct("l_orderkey").cast("double"), of(F.col("l_linestatus") == "F"))
    v = g.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(vec.alias("vec")).withColumn("repo", F.col("id") % 3)
    return s.knn(v, 1, 15, "other").select("id", "repo", *r6("distance"))


@query(
    "shape_distance",
    """WITH q AS (SELECT a, b FROM (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation)), dist AS (SELECT x.n_nationkey AS lo, y.n_nationkey AS hi, abs(x.n_regionkey - y.n_regionkey)::DOUBLE AS distance FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey)
    SELECT a, b, distance FROM q LEFT JOIN dist ON lo = least(a, b) AND hi = greatest(a, b)""",
)
def shape_distance(spark, d):
    """A stored distance of a pair, named in either order; null where there's none."""
    n = g.table(spark, d, "nation")
    q = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    x, y = n.select(F.col("n_nationkey").alias("lo"), F.col("n_regionkey").alias("rx")), n.select(F.col("n_nationkey").alias("hi"), F.col("n_regionkey").alias("ry"))
    stored = x.join(y, F.col("lo") < F.col("hi")).select("lo", "hi", F.abs(F.col("rx") - F.col("ry")).cast("double").alias("distance"))  # the table of 25 nations
    return q.join(stored, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left").select("a", "b", "distance")


@query("capped_anchors", graph_sql(", i AS (SELECT src_id AS id FROM g_edges UNION ALL SELECT dst_id FROM g_edges), c AS (SELECT id, count(*) AS n FROM i GROUP BY id) SELECT count(*) FILTER (n > 30) AS capped, coalesce(sum(n - 30) FILTER (n > 30), 0)::BIGINT AS left_out, count(*) AS anchors FROM c"))
def capped_anchors(spark, d):
    """What the cap on an anchor's incident edges leaves out of motif counts."""
    from tessera.operators.motifs import capped

    return capped(g.edges(spark, d))


@query("edge_insert", graph_sql(""", n AS (SELECT 'C:' || (o_custkey * 3) AS src_id, 'O:' || o_orderkey AS dst_id, 'INJECTS' AS kind, NULL::BIGINT AS "count" FROM orders WHERE o_orderkey % 5 = 0)
SELECT kind, count(*) AS n FROM (SELECT * FROM g_edges UNION ALL SELECT * FROM n WHERE src_id IN (SELECT id FROM g_nodes) AND dst_id IN (SELECT id FROM g_nodes)) GROUP BY kind"""))
def edge_insert(spark, d):
    from tessera.operators.graph_query import insert_edges

    o = g.table(spark, d, "orders").where("o_orderkey % 5 = 0")
    new = o.select(F.concat(F.lit("C:"), (F.col("o_custkey") * 3).cast("string")).alias("src_id"), F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("dst_id"), F.lit("INJECTS").alias("kind"), F.lit(None).cast("long").alias("count"))
    return insert_edges(g.nodes(spark, d), g.edges(spark, d), new).groupBy("kind").agg(F.count("*").alias("n"))


@query("cycle_consistency", """WITH f AS (SELECT c_custkey AS s, c_custkey * 7 % 1000 AS t FROM customer), b AS (SELECT c_custkey AS t, min(x) AS s FROM (SELECT c_custkey * 7 % 1000 AS c_custkey, c_custkey AS x FROM customer WHERE c_custkey % 3 <> 0) GROUP BY 1)
SELECT count(*) AS mapped, count(b.s) AS back, count(*) FILTER (b.s = f.s) AS same, round(count(*) FILTER (b.s = f.s) / count(b.s), 6) AS consistency FROM f LEFT JOIN b USING (t)""")
def cycle_consistency(spark, d):
    from tessera.operators.graph_algorithms import cycle_consistency as measure

    c, t = g.table(spark, d, "customer"), (F.col("c_custkey") * 7 % 1000).alias("t")
    back = c.where("c_custkey % 3 <> 0").groupBy(t).agg(F.min("c_custkey").alias("s"))
    return measure(c.select(F.col("c_custkey").alias("s"), t), back).select("mapped", "back", "same", *r6("consistency"))


@query("threshold_classes", """WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.label, a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.label = b.label),
th AS (SELECT unnest([0.3::DOUBLE, 0.8::DOUBLE, 0.99::DOUBLE]) AS threshold), l AS (SELECT threshold, label, a, b FROM p, th WHERE s >= threshold), r AS (SELECT threshold, label, a, a AS b FROM l UNION SELECT r.threshold, r.label, r.a, l.b FROM r JOIN l ON l.threshold = r.threshold AND l.a = r.b),
c AS (SELECT threshold, label, a, min(b) AS c FROM r GROUP BY ALL), k AS (SELECT threshold, label, c, count(*) AS n FROM c GROUP BY ALL) SELECT label AS "group", threshold, count(*) AS n_classes, max(n) AS largest FROM k GROUP BY label, threshold""")
def threshold_classes(spark, d):
    v = g.table(spark, d, "embeddings").select(F.col("label").alias("group"), F.col("embedding").cast("array<double>").alias("vec"))
    return s.threshold_classes(v, (0.3, 0.8, 0.99))
