"""Queries: predicates, orders, cards, ledgers and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as g
from tessera.operators import cards as c, modules as m, orders as o, predicates as p
from tessera.operators.similarity import compared, kind_group, relative_cut
from tessera.plans.mining_queries import r6
from tessera.plans.structure_queries import CROSS, MEM, members
from tessera.registry import graph_sql, query


def suppliers(spark, d):
    return g.table(spark, d, "supplier")


def out_kinds(spark, d):
    return g.edges(spark, d).where("src_id LIKE 'U:%'").groupBy(F.col("src_id").alias("id")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


@query(
    "kind_lists",
    graph_sql(""", k AS (SELECT src_id AS id, list_sort(list(DISTINCT kind)) AS kinds FROM g_edges WHERE src_id LIKE 'U:%' GROUP BY src_id)
    SELECT id, array_to_string(kinds, ',') AS kinds FROM k WHERE list_has_any(kinds, ['RAISES', 'WRITES_FIELD']) AND len(kinds) >= 3"""),
)
def kind_lists(spark, d):
    rows = out_kinds(spark, d).where(p.overlaps(F.col("kinds"), ["RAISES", "WRITES_FIELD"]) & p.at_least(F.col("kinds"), 3))
    return rows.select("id", F.array_join("kinds", ",").alias("kinds"))


@query(
    "pairs_touching_module",
    graph_sql(CROSS + " SELECT su, sv, sum(weight)::BIGINT AS n FROM cr WHERE (su = 'ASIA' OR sv = 'ASIA') AND contains(lower(kind), 'field') GROUP BY su, sv"),
)
def pairs_touching_module(spark, d):
    cr = m.crossings(g.edges(spark, d), members(spark, d))
    return cr.where(p.either_side(F.col("su"), F.col("sv"), "ASIA") & p.holds(F.col("kind"), "Field")).groupBy("su", "sv").agg(F.sum("weight").alias("n"))


@query("near_equal", "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE abs(l_discount - 0.05) < 1e-9 GROUP BY l_linenumber")
def near_equal(spark, d):
    return g.table(spark, d, "lineitem").where(p.near(F.col("l_discount"), 0.05)).groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query(
    "glob_scope",
    graph_sql(""" SELECT file, count(*) FILTER (regexp_matches(file, '^A[^/]*/[^/]*$')) AS one_level, count(*) FILTER (regexp_matches(file, '^(?:.*/)?f[^/]*$')) AS any_level,
      count(*) FILTER (regexp_matches(file, '^[^/]SIA/.*$')) AS single FROM g_nodes GROUP BY file"""),
)
def glob_scope(spark, d):
    n = g.nodes(spark, d)
    hit = lambda glob, name: F.count_if(p.matches_glob(F.col("file"), glob)).alias(name)
    return n.groupBy("file").agg(hit("A*/*", "one_level"), hit("**/f*", "any_level"), hit("?SIA/**", "single"))


@query("path_families", graph_sql(" SELECT CASE WHEN starts_with(file, 'ASIA/') THEN split_part(substr(file, 6), '/', 1) END AS family, count(*) AS n FROM g_nodes GROUP BY 1"))
def path_families(spark, d):
    return g.nodes(spark, d).groupBy(p.path_family(F.col("file"), "ASIA").alias("family")).agg(F.count("*").alias("n"))


BASES = ["ConfigEntityBase", "ContentEntityBundleInfo", "DefaultPluginManager", "X\\ControllerBase", "FormBase", "EntityForm", "DeriverBase", "Constraint", "ConfirmFormBase", "Formatter", "MyEntityForm", "PluginBases"]
_FRAMEWORK_SQL = r"'(?:^|\\)(?:(?:Content|Config)Entity(?:Base|Interface|Bundle\w*)|(?:Default)?Plugin(?:Base|Manager|Interface)|ControllerBase|(?:Config)?FormBase|EntityForm|(?:Deriver|EntityAction)Base|Constraint(?:Validator)?|ConfirmFormBase)$'"


@query(
    "framework_nodes",
    f"""WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'external::' ELSE 'own::' END || s_name AS qn, ({BASES!r})[1 + s_suppkey % {len(BASES)}] AS sn FROM supplier)
    SELECT sn AS short_name, CASE WHEN starts_with(qn, 'external::') THEN 'external' WHEN regexp_matches(sn, {_FRAMEWORK_SQL}) THEN 'base' END AS reason, count(*) AS n FROM n GROUP BY ALL""".replace("\\\\C", "\\C"),
)
def framework_nodes(spark, d):
    named = suppliers(spark, d).select(F.concat(F.when(F.col("s_suppkey") % 5 == 0, "external::").otherwise("own::"), "s_name").alias("qn"), F.element_at(F.array(*map(F.lit, BASES)), (F.col("s_suppkey") % len(BASES) + 1).cast("int")).alias("short_name"))
    return named.groupBy("short_name", p.framework_reason(F.col("qn"), F.col("short_name")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "compare_dispatch",
    """WITH x AS (SELECT ['==', '!=', '>', '>=', '<', '<='][1 + l_linenumber % 6] AS op, l_discount AS a, l_tax AS b FROM lineitem)
    SELECT op, count(*) AS n, count(*) FILTER (CASE op WHEN '==' THEN abs(a - b) <= 1e-9 WHEN '!=' THEN abs(a - b) > 1e-9 WHEN '>' THEN a - b > 1e-9 WHEN '>=' THEN a - b >= -1e-9 WHEN '<' THEN b - a > 1e-9 ELSE b - a >= -1e-9 END) AS holds FROM x GROUP BY op""",
)
def compare_dispatch(spark, d):
    x = g.table(spark, d, "lineitem").select(F.element_at(F.array(*map(F.lit, p.OPS)), F.col("l_linenumber") % 6 + 1).alias("op"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return x.groupBy("op").agg(F.count("*").alias("n"), F.count_if(p.compare(F.col("op"), F.col("a"), F.col("b"))).alias("holds"))


VALUES = ["5", "5.0", "true", "1", '"5"', "null", "5e0", "[1]"]


@query(
    "value_equality",
    """WITH v AS (SELECT event_id % 8 AS i, (event_id // 8) % 8 AS j FROM events), w AS (SELECT DISTINCT i, j FROM v),
    t AS (SELECT i, j, ['5', '5.0', 'true', '1', '"5"', 'null', '5e0', '[1]'][1 + i] AS a, ['5', '5.0', 'true', '1', '"5"', 'null', '5e0', '[1]'][1 + j] AS b FROM w)
    SELECT a, b, CASE WHEN i IN (0, 1, 3, 6) AND j IN (0, 1, 3, 6) THEN a::DOUBLE = b::DOUBLE ELSE a = b END AS same FROM t""",
)
def value_equality(spark, d):
    pick = lambda k: F.element_at(F.array(*map(F.lit, VALUES)), (k + 1).cast("int"))
    e = g.table(spark, d, "events").select(pick(F.col("event_id") % 8).alias("a"), pick(F.floor(F.col("event_id") / 8) % 8).alias("b")).distinct()
    return e.select("a", "b", p.same_value(F.col("a"), F.col("b")).alias("same"))


@query("card_sections", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 10 = 0")
def card_sections(spark, d):
    card = F.struct(F.struct("s_suppkey", "s_name").alias("envelope"), F.struct("s_nationkey").alias("topology"), F.struct("s_acctbal").alias("value"))
    rows = suppliers(spark, d).where("s_suppkey % 10 = 0").select(card.alias("card")).select(p.sections(F.col("card"), ["envelope", "value"]).alias("card"))
    return rows.select("card.envelope.*", "card.value.*")


@query(
    "motif_labels",
    """WITH l AS (SELECT l_suppkey AS id, arg_max(l_shipmode, o) AS label FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_suppkey % 3 <> 0) GROUP BY 1)
    SELECT s_suppkey AS id, label FROM supplier LEFT JOIN l ON l.id = s_suppkey""",
)
def motif_labels(spark, d):
    labels = g.table(spark, d, "lineitem").where("l_suppkey % 3 <> 0").select(F.col("l_suppkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return c.with_labels(suppliers(spark, d).select(F.col("s_suppkey").alias("id")), labels, "id", "o")


@query(
    "patterns_with_evidence",
    """WITH e AS (SELECT DISTINCT l_suppkey AS id, p_brand AS repo, 'P' || l_partkey AS ref FROM lineitem JOIN part ON p_partkey = l_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ref, repo) AS rn FROM e)
    SELECT id, count(*) AS n_evidence, string_agg(ref, ',' ORDER BY ref) FILTER (rn <= 3) AS refs FROM r WHERE id IN (SELECT id FROM e WHERE repo = 'Brand#11') GROUP BY id""",
)
def patterns_with_evidence(spark, d):
    e = g.table(spark, d, "lineitem").join(g.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.col("p_brand").alias("repo"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ref")).distinct()
    out = c.with_evidence(suppliers(spark, d).select(F.col("s_suppkey").alias("id")), e, "Brand#11")
    return out.select("id", "n_evidence", F.array_join("refs", ",").alias("refs"))


@query(
    "central_with_clusters",
    graph_sql(MEM + """, t AS (SELECT dst_id AS id, count(*) AS degree FROM g_edges GROUP BY 1 ORDER BY degree DESC, id LIMIT 20) SELECT t.*, module FROM t LEFT JOIN mem USING (id)"""),
)
def central_with_clusters(spark, d):
    from tessera.operators.graph_query import top_k

    degree = g.edges(spark, d).groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("degree"))
    return top_k(degree, "degree", 20).join(members(spark, d), "id", "left")


@query(
    "subsystem_rollup",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_name) AS rn FROM customer)
    SELECT c_nationkey AS module, count(*) AS n, count(*) FILTER (c_mktsegment < 'C') AS n_locality, count(*) FILTER (c_mktsegment >= 'C') AS n_structural, round(avg(c_acctbal), 6) AS confidence, string_agg(c_name, ',' ORDER BY c_name) FILTER (rn <= 3) AS boundary FROM r GROUP BY 1""",
)
def subsystem_rollup(spark, d):
    rows = g.table(spark, d, "customer").select(F.col("c_nationkey").alias("module"), F.col("c_name").alias("id"), (F.col("c_mktsegment") < "C").alias("by_locality"), F.col("c_acctbal").alias("confidence"))
    return c.member_rollup(rows).select("module", "n", "n_locality", "n_structural", *r6("confidence"), F.array_join("boundary", ",").alias("boundary"))


@query(
    "top_exports",
    """WITH n AS (SELECT 'C' || c_custkey AS id, 'f' || c_nationkey || '::' || c_mktsegment AS qn FROM customer), m AS (SELECT 'O' || o_orderkey AS id, 'f' || c_nationkey || '::' || c_mktsegment || '::' || o_orderstatus AS qn FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0
      UNION ALL SELECT 'X' || s_suppkey, 'g' || s_nationkey || '::none' FROM supplier) SELECT m.id, qn AS qualified_name, e.export FROM m LEFT JOIN (SELECT qn AS h, min(id) AS export FROM n GROUP BY qn) e ON e.h = split_part(m.qn, '::', 1) || '::' || split_part(m.qn, '::', 2)""",
)
def top_exports(spark, d):
    cust = g.table(spark, d, "customer")
    head = F.concat(F.lit("f"), F.col("c_nationkey").cast("string"), F.lit("::"), "c_mktsegment")
    n = cust.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), head.alias("qualified_name"))
    a = g.table(spark, d, "orders").where("o_orderkey % 2 = 0").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(head, F.lit("::"), "o_orderstatus").alias("qualified_name"))
    b = suppliers(spark, d).select(F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("g"), F.col("s_nationkey").cast("string"), F.lit("::none")).alias("qualified_name"))
    return c.top_export(a.unionByName(b), n)


@query(
    "feature_modules",
    """WITH f AS (SELECT 'modules/' || c_mktsegment || '/n' || c_nationkey || '/c' || c_custkey AS file, c_nationkey AS module FROM customer)
    SELECT s AS feature, module, count(*) AS n_files FROM f, (SELECT DISTINCT c_mktsegment AS s FROM customer) WHERE starts_with(file, 'modules/' || s || '/') AND regexp_matches(file, '^modules/[^/]*/n1[^/]*/.*$') GROUP BY ALL""",
)
def feature_modules(spark, d):
    cust = g.table(spark, d, "customer")
    files = cust.select(F.concat(F.lit("modules/"), "c_mktsegment", F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string")).alias("file"), F.col("c_nationkey").alias("module"))
    globs = cust.select(F.col("c_mktsegment").alias("feature")).distinct().select("feature", F.concat(F.lit("modules/"), "feature").alias("root"), F.lit(p.glob_regex("modules/*/n1*/**")).alias("regex"))
    return c.feature_modules(globs, files)


LOADS = "SELECT s_suppkey AS id, (s_suppkey % 11) / 10.0::DOUBLE AS d, (s_suppkey % 7) / 10.0::DOUBLE AS r FROM supplier"


def loads(spark, d):
    return suppliers(spark, d).select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 11) / F.lit(10.0)).alias("d"), ((F.col("s_suppkey") % 7) / F.lit(10.0)).alias("r"))


@query(
    "coupled_load",
    f"""WITH l AS ({LOADS}), j AS (SELECT id, d, r, CASE WHEN id % 4 < 3 THEN ['hard', 'soft', 'mixed'][1 + id % 4] END AS grade FROM l), k AS (SELECT *, d * CASE grade WHEN 'soft' THEN 0.5 WHEN 'mixed' THEN 0.8 ELSE 1.0 END AS dc FROM j)
    SELECT id, grade, round(dc, 6) AS d_coupled, CASE WHEN dc >= 0.55 THEN 'structure-clear' WHEN r >= 0.4 THEN 'intention-critical' ELSE 'ambiguous' END AS load FROM k""",
)
def coupled_load(spark, d):
    grades = suppliers(spark, d).where("s_suppkey % 4 < 3").select(F.col("s_suppkey").alias("id"), F.element_at(F.array(F.lit("hard"), F.lit("soft"), F.lit("mixed")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("grade"))
    return c.coupled_load(loads(spark, d), grades, {"soft": 0.5, "mixed": 0.8}).select("id", "grade", *r6("d_coupled"), "load")


USES = "SELECT 'f' || user_id % 9 AS feature, event_type || CASE WHEN event_id % 2 = 0 THEN '_recorded' ELSE '' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'fold' ELSE 'emit' END AS role, event_id % 50 = 0 AS gated, event_id % 7 AS via FROM events WHERE event_id % 11 < 3 OR user_id % 9 = event_id % 9"


def uses(spark, d):
    e = g.table(spark, d, "events").where("event_id % 11 < 3 OR user_id % 9 = event_id % 9")
    return e.select(F.concat(F.lit("f"), (F.col("user_id") % 9).cast("string")).alias("feature"), F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "_recorded").otherwise("")).alias("kind"), F.when(F.col("event_id") % 3 == 0, "fold").otherwise("emit").alias("role"), (F.col("event_id") % 50 == 0).alias("gated"), (F.col("event_id") % 7).alias("via"))


@query("feature_kinds", f"SELECT feature, kind, role, bool_or(gated) AS gated, count(DISTINCT via) AS n_via FROM ({USES}) GROUP BY ALL")
def feature_kinds(spark, d):
    return c.feature_kinds(uses(spark, d))


@query(
    "kernel_surface",
    f"""SELECT kind, count(DISTINCT feature) AS n_features, count(DISTINCT feature) FILTER (role = 'emit') AS n_emit, count(DISTINCT feature) FILTER (role = 'fold') AS n_fold, count(DISTINCT feature) FILTER (gated) AS n_gated, count(DISTINCT feature) >= 5 AS is_kernel FROM ({USES}) GROUP BY kind""",
)
def kernel_surface(spark, d):
    return c.kernel_surface(c.feature_kinds(uses(spark, d)), 5)


@query(
    "taxonomy_tensions",
    f"""WITH w AS (SELECT kind, min(feature) AS owner FROM (SELECT CASE event_type WHEN 'click' THEN 'f1' WHEN 'view' THEN 'f2' ELSE 'f0' END AS feature, event_type || '_recorded' AS kind FROM events) GROUP BY kind)
    SELECT x.kind AS a, x.owner AS owner_a, y.kind AS b, y.owner AS owner_b FROM w x JOIN w y ON x.kind < y.kind AND x.owner <> y.owner""",
)
def taxonomy_tensions(spark, d):
    e = g.table(spark, d, "events").select(F.when(F.col("event_type") == "click", "f1").when(F.col("event_type") == "view", "f2").otherwise("f0").alias("feature"), F.concat("event_type", F.lit("_recorded")).alias("kind"), F.lit("emit").alias("role"))
    return c.taxonomy_tensions(e, "_recorded")


@query(
    "term_coverage",
    """WITH cl AS (SELECT DISTINCT c_mktsegment AS class, 'n' || c_nationkey AS term FROM customer), k AS (SELECT 'app.n' || n_nationkey AS term FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0),
    h AS (SELECT DISTINCT split_part(term, '.', -1) AS term FROM k) SELECT class, count(*) AS n_terms, count(h.term) AS covered, round(count(h.term) / count(*), 6) AS ratio FROM cl LEFT JOIN h USING (term) GROUP BY class""",
)
def term_coverage(spark, d):
    nation, name = g.table(spark, d, "nation"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    terms = nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("app."), name).alias("term")).unionByName(nation.where("n_nationkey % 5 = 0").select(name.alias("term")))
    classes = g.table(spark, d, "customer").select(F.col("c_mktsegment").alias("class"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("term"))
    return c.term_coverage(classes, terms).select("class", "n_terms", "covered", *r6("ratio"))


@query(
    "verdict_currency",
    """WITH b AS (SELECT o_orderkey AS port, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 5 END AS seal, o_orderkey % 13 = 0 AS retired FROM orders), v AS (SELECT l_orderkey AS port, l_linenumber % 5 AS seal, l_returnflag <> 'R' AS clean FROM lineitem WHERE l_orderkey % 4 <> 0),
    j AS (SELECT b.port, b.seal, retired, count(v.seal) AS n, count(*) FILTER (v.seal = b.seal) AS cur, coalesce(bool_and(clean) FILTER (v.seal = b.seal), true) AS clean FROM b LEFT JOIN v USING (port) GROUP BY ALL)
    SELECT port, CASE WHEN retired THEN 'retired' WHEN seal IS NULL THEN 'undeterminable' WHEN n = 0 THEN 'missing' WHEN cur = 0 THEN 'stale' WHEN NOT clean THEN 'unclean' ELSE 'ok' END AS state FROM j""",
)
def verdict_currency(spark, d):
    b = g.table(spark, d, "orders").select(F.col("o_orderkey").alias("port"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") % 5).alias("seal"), (F.col("o_orderkey") % 13 == 0).alias("retired"))
    v = g.table(spark, d, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("port"), (F.col("l_linenumber") % 5).cast("long").alias("seal"), (F.col("l_returnflag") != "R").alias("clean"))
    return c.verdict_currency(b, v)


@query(
    "divergence_match",
    """SELECT o_orderkey AS k, coalesce(n, 0) AS n_matches, CASE coalesce(n, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS outcome FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON k = o_orderkey""",
)
def divergence_match(spark, d):
    declared = g.table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("k"))
    return c.unique_match(g.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), declared, "k")


@query(
    "candidate_blocking",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id % 4 AS k FROM embeddings), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.label = b.label AND (CASE WHEN a.k < 2 THEN 'callable' ELSE 'o' || a.k END) = (CASE WHEN b.k < 2 THEN 'callable' ELSE 'o' || b.k END) WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id),
    r AS (SELECT *, max(sim) OVER (PARTITION BY src) AS best, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS rank FROM s WHERE round(sim, 9) >= 0.1), c AS (SELECT *, round(sim, 9) >= round(best - 0.02, 9) AS near, count(*) FILTER (round(sim, 9) >= round(best - 0.02, 9)) OVER (PARTITION BY src) AS n FROM r),
    k AS (SELECT * FROM c WHERE (near AND rank <= 400) OR (n < 10 AND rank <= 10)) SELECT src, dst, round(sim, 6) AS sim, rank, round(coalesce(sim - lead(sim) OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst), 1.0), 6) AS margin FROM k""",
)
def candidate_blocking(spark, d):
    """Candidates only within a group of kinds; sources are the stated query set."""
    kinds = F.array(*map(F.lit, ("function", "method", "file", "module")))
    grp = kind_group(F.element_at(kinds, (F.col("vec_id") % 4 + 1).cast("int")))
    v = g.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.col("label").cast("string"), F.lit("|"), grp).alias("grp"), F.col("embedding").cast("array<double>").alias("vec"))
    pairs = compared(v.where("id % 20 = 0"), v, 0.1, "grp", cap=400)
    return relative_cut(pairs, min_sim=0.1).select("src", "dst", "rank", *r6("sim", "margin"))


@query(
    "waivers",
    """SELECT coalesce(p.t, w.t) AS target, CASE WHEN w.t IS NULL THEN 'open' WHEN p.t IS NULL THEN 'stale' ELSE 'waived' END AS status FROM (SELECT DISTINCT l_partkey AS t FROM lineitem WHERE l_returnflag = 'R') p FULL JOIN (SELECT p_partkey AS t FROM part WHERE p_size < 20) w ON p.t = w.t""",
)
def waivers(spark, d):
    return c.waivers(g.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("target")), g.table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("target")))


@query("affected_agents", "SELECT l_suppkey AS agent, count(DISTINCT l_partkey) AS n_topics FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7 GROUP BY 1")
def affected_agents(spark, d):
    agents = g.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("agent"), (F.col("l_partkey") % 100).alias("page")).agg(F.collect_set("l_partkey").alias("topics")).drop("page")
    changed = g.table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("topic"))
    return c.affected(agents, changed)


@query("run_contribution", graph_sql(" SELECT kind, count(*) AS n FROM g_nodes WHERE ast_hash IS NOT NULL AND length(id) % 2 = 0 GROUP BY kind"))
def run_contribution(spark, d):
    return g.nodes(spark, d).where("ast_hash is not null and length(id) % 2 = 0").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "freshness",
    "SELECT o_orderkey AS file, coalesce(bool_or(l_linenumber = o_orderkey % 5), false) AS fresh FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def freshness(spark, d):
    stored = g.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("hash"))
    return c.freshness(stored, g.table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 5).alias("hash")))


@query(
    "exemplars",
    """WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(x) AS m FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1),
    s AS (SELECT label, vec_id, sum(x * m) / (sqrt(sum(x * x)) * any_value(norm)) AS sim FROM e JOIN m USING (label, k) JOIN n USING (label) GROUP BY ALL) SELECT label AS "group", arg_min(vec_id, (-round(sim, 12), vec_id)) AS id, round(max(sim), 6) AS similarity FROM s GROUP BY label""",
)
def exemplars(spark, d):
    v = g.table(spark, d, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return c.exemplars(v).select("group", "id", *r6("similarity"))


@query("semantic_reach", graph_sql(" SELECT dst_id AS id, count(DISTINCT src_id) AS reach FROM g_edges WHERE kind IN ('CALLS', 'READS_FIELD', 'WRITES_FIELD', 'CONSTRUCTS') GROUP BY 1"))
def semantic_reach(spark, d):
    return c.semantic_reach(g.edge_sets(spark, d), ("CALLS", "READS_FIELD", "WRITES_FIELD", "CONSTRUCTS"))


@query("field_flow", graph_sql(MEM + " SELECT a.module AS source, b.module AS target, kind, count(*) AS n FROM g_edges e JOIN mem a ON a.id = src_id JOIN mem b ON b.id = dst_id WHERE kind IN ('READS_FIELD', 'WRITES_FIELD') AND a.module <> b.module GROUP BY ALL"))
def field_flow(spark, d):
    return c.field_flow(g.edges(spark, d), members(spark, d))


@query(
    "fused_candidates",
    """WITH f AS (SELECT l_returnflag AS lane, l_partkey AS topic, l_suppkey % 5 AS module, l_discount AS score, l_linenumber AS reach FROM lineitem)
    SELECT topic, module, count(DISTINCT lane) AS lanes, round(max(score) + 0.1 * (count(DISTINCT lane) - 1) + CASE WHEN max(reach) > 1 THEN 0.05 ELSE 0 END, 6) AS score FROM f GROUP BY topic, module""",
)
def fused_candidates(spark, d):
    f = g.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("lane"), F.col("l_partkey").alias("topic"), (F.col("l_suppkey") % 5).alias("module"), F.col("l_discount").alias("score"), F.col("l_linenumber").alias("reach"))
    return c.fused_candidates(f).select("topic", "module", "lanes", *r6("score"))


#: What a signal of each tier weighs.
TIERS = {"S": 1.0, "A": 0.6, "B": 0.25, "C": 0.1}


@query(
    "intention_richness",
    """WITH s AS (SELECT l_orderkey AS id, sum(CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.6 ELSE 0.25 END) AS mass, bool_or(l_linenumber = 5) AS tested FROM lineitem GROUP BY 1), h AS (SELECT o_orderkey AS id, (o_orderkey % 10) / 10.0::DOUBLE AS h FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT id, round(least(1.0, greatest(least(1.0, mass / 3.0) * CASE WHEN h IS NULL THEN 1.0 WHEN h <= 0.35 THEN 1.2 ELSE 0.5 END, CASE WHEN tested THEN 0.4 ELSE 0.0 END))::DOUBLE, 6) AS r FROM s LEFT JOIN h USING (id)""",
)
def intention_richness(spark, d):
    s = g.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "S").when(F.col("l_returnflag") == "A", "A").otherwise("B").alias("tier"), (F.col("l_linenumber") == 5).alias("is_test"))
    h = g.table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 10) / F.lit(10.0)).alias("h"))
    return c.richness(s, h, TIERS).select("id", *r6("r"))


@query(
    "conflicts",
    graph_sql(MEM + """, n AS (SELECT id, CASE WHEN length(id) % 2 = 0 THEN 'getName' ELSE 'setName' END AS sn, id LIKE '%3' AS doc_pure, id LIKE '%7' AS deprecated, length(id) AS doc_arity, 5 AS arity FROM g_nodes WHERE id LIKE 'U:%' OR id LIKE 'O:%'),
    w AS (SELECT src_id AS id, a.module IS DISTINCT FROM b.module AS across FROM g_edges LEFT JOIN mem a ON a.id = src_id LEFT JOIN mem b ON b.id = dst_id WHERE kind IN ('WRITES_FIELD', 'CONSTRUCTS'))
    SELECT id, 'read_name_writes' AS detector, true AS critical FROM n WHERE sn = 'getName' AND id IN (SELECT id FROM w WHERE across) UNION ALL SELECT id, 'pure_doc_writes', true FROM n WHERE doc_pure AND id IN (SELECT id FROM w)
    UNION ALL SELECT id, 'deprecated_called', false FROM n WHERE deprecated AND id IN (SELECT dst_id FROM g_edges WHERE kind = 'CALLS') UNION ALL SELECT id, 'arity_mismatch', false FROM n WHERE doc_arity <> arity"""),
)
def conflicts(spark, d):
    n = g.nodes(spark, d).where("id LIKE 'U:%' OR id LIKE 'O:%'")
    named = n.select("id", F.when(F.length("id") % 2 == 0, "getName").otherwise("setName").alias("short_name"), F.col("id").endswith("3").alias("doc_pure"), F.col("id").endswith("7").alias("deprecated"), F.length("id").alias("doc_arity"), F.lit(5).alias("arity"))
    return c.conflicts(named, g.edges(spark, d), members(spark, d))


@query(
    "role_dissonance",
    """WITH s AS (SELECT l_suppkey AS role, l_orderkey AS id, l_partkey % 40 AS stem FROM lineitem), n AS (SELECT role, count(DISTINCT id) AS members FROM s GROUP BY 1), t AS (SELECT role, max(n) AS top FROM (SELECT role, stem, count(DISTINCT id) AS n FROM s GROUP BY ALL) GROUP BY 1)
    SELECT role, members, round(top / members, 6) AS share FROM n JOIN t USING (role) WHERE members >= 3 AND top / members < 0.34""",
)
def role_dissonance(spark, d):
    s = g.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("role"), F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 40).alias("stem"))
    return c.role_dissonance(s).select("role", "members", *r6("share"))


NOTES = "SELECT user_id % 40 AS topic, event_id % 13 AS agent, CASE event_type WHEN 'error' THEN 'punt' WHEN 'click' THEN 'invented' ELSE 'note' END AS kind, event_id % 400 = 0 AS flagged FROM events WHERE event_id % 6 = 0"


@query("promotions", f"SELECT topic, count(DISTINCT agent) FILTER (kind IN ('punt', 'invented')) AS n_agents, bool_or(flagged) AS flagged FROM ({NOTES}) GROUP BY topic HAVING count(DISTINCT agent) FILTER (kind IN ('punt', 'invented')) >= 8 OR bool_or(flagged)")
def promotions(spark, d):
    e = g.table(spark, d, "events").where("event_id % 6 = 0")
    notes = e.select((F.col("user_id") % 40).alias("topic"), (F.col("event_id") % 13).alias("agent"), F.when(F.col("event_type") == "error", "punt").when(F.col("event_type") == "click", "invented").otherwise("note").alias("kind"), (F.col("event_id") % 400 == 0).alias("flagged"))
    return c.promotions(notes, 8)


@query("latest_answers", "SELECT user_id AS question, arg_max(event_type, event_id) AS answer, max(event_id) AS line_no FROM events GROUP BY 1")
def latest_answers(spark, d):
    rows = g.table(spark, d, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("answer"), F.col("event_id").alias("line_no"))
    return c.last_of(rows, ["question"], "line_no")


@query(
    "reading_coverage",
    "SELECT p_partkey AS target, CASE WHEN p_size < 25 THEN 'known' ELSE 'grown' END AS status FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40)",
)
def reading_coverage(spark, d):
    part, line = g.table(spark, d, "part"), g.table(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity > 40")
    name = F.col("p_partkey").alias("target")
    return c.coverage_ratchet(part.select(name), line.select(F.col("l_partkey").alias("target")), part.where("p_size < 25").select(name))


@query("finding_clusters", "SELECT token, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand, '[A-Za-z]+#?[0-9]*')) AS token FROM part) GROUP BY token HAVING count(*) >= 3")
def finding_clusters(spark, d):
    return c.finding_clusters(g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")), "[A-Za-z]+#?[0-9]*")


@query(
    "export_cards",
    graph_sql(CROSS + """ SELECT sv AS module, CASE WHEN length(dst_id) % 2 = 0 THEN 'E:' || right(dst_id, 1) ELSE dst_id END AS key, count(DISTINCT kind) AS n_modes, sum(weight)::BIGINT AS callers FROM cr WHERE sv IS NOT NULL GROUP BY ALL"""),
)
def export_cards(spark, d):
    i = m.interfaces(g.edges(spark, d), members(spark, d)).where("direction = 'provides'")
    return c.export_cards(i.select("module", F.col("internal_id").alias("member"), F.when(F.length("internal_id") % 2 == 0, F.concat(F.lit("E:"), F.right("internal_id", F.lit(1)))).alias("export"), "edge_kind", "edge_count"))


@query(
    "consumes_summary",
    graph_sql(CROSS + """, s AS (SELECT su AS module, coalesce(sv, '(external package)') AS target, count(DISTINCT kind) AS n_modes, sum(weight)::BIGINT AS edges, min(src_id) AS sample FROM cr WHERE su IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY edges DESC, target) AS rn FROM s) SELECT module, target, n_modes, edges, sample FROM r WHERE rn <= 3"""),
)
def consumes_summary(spark, d):
    return c.consumes_summary(m.interfaces(g.edges(spark, d), members(spark, d)).where("direction = 'consumes'"), 3)


@query(
    "shape_cards",
    graph_sql(MEM + """, u AS (SELECT n.id, e.kind, coalesce(f.module = x.module, false) AS inside FROM g_nodes n LEFT JOIN mem f ON f.id = n.id LEFT JOIN (SELECT * FROM g_edges WHERE kind IN ('READS_FIELD', 'WRITES_FIELD')) e ON e.dst_id = n.id LEFT JOIN mem x ON x.id = e.src_id WHERE n.kind = 'field'),
    s AS (SELECT id, coalesce(bool_or(kind = 'READS_FIELD' AND inside), false) AS ri, coalesce(bool_or(kind = 'READS_FIELD' AND NOT inside), false) AS ro, coalesce(bool_or(kind = 'WRITES_FIELD' AND inside), false) AS wi, coalesce(bool_or(kind = 'WRITES_FIELD' AND NOT inside), false) AS wo FROM u GROUP BY id),
    t AS (SELECT dst_id AS type, bool_or(ro OR wo) AS boundary, count(*) AS n_fields, count(*) FILTER (wo AND ri) AS n_in, count(*) FILTER (wi AND ro) AS n_out FROM s JOIN g_edges e ON e.src_id = s.id AND e.kind = 'EXTENDS' GROUP BY dst_id)
    SELECT *, row_number() OVER (ORDER BY boundary DESC, n_fields DESC, type) AS rank FROM t"""),
)
def shape_cards(spark, d):
    e = g.edges(spark, d)
    owners = e.where("kind = 'EXTENDS'").select(F.col("src_id").alias("id"), F.col("dst_id").alias("type"))
    return c.shape_cards(m.data_shapes(g.nodes(spark, d), e, members(spark, d)), owners).withColumn("rank", F.col("rank").cast("long"))


@query(
    "card_summary",
    graph_sql(CROSS + f""", dg AS (SELECT module, sum(w) FILTER (side = 'p')::BIGINT AS p, sum(w) FILTER (side = 'c')::BIGINT AS c FROM (SELECT sv AS module, 'p' AS side, weight AS w FROM cr WHERE sv IS NOT NULL UNION ALL SELECT su, 'c', weight FROM cr WHERE su IS NOT NULL) GROUP BY module),
    lo AS (SELECT module, round(count(*) FILTER (NOT d >= 0.55 AND r >= 0.4) / count(*), 6) AS critical FROM (SELECT 'U:' || id AS id, d, r FROM ({LOADS})) JOIN mem USING (id) GROUP BY module) SELECT module, coalesce(p, 0) AS provides, coalesce(c, 0) AS consumes, critical FROM dg LEFT JOIN lo USING (module)"""),
)
def card_summary(spark, d):
    from tessera.operators.scoring import load_class

    own = loads(spark, d).select(F.concat(F.lit("U:"), F.col("id").cast("string")).alias("id"), load_class(F.col("d"), F.col("r")).alias("load"))
    return c.card_summary(m.interfaces(g.edges(spark, d), members(spark, d)), own, members(spark, d)).select("module", "provides", "consumes", *r6("critical"))


@query("prescreened", "SELECT l_orderkey AS element, count(*) <= 1 AND bool_and(l_returnflag <> 'R') AND bool_and(l_quantity < 40) AS screened FROM lineitem GROUP BY 1")
def prescreened(spark, d):
    return c.prescreened(g.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("element"), (F.col("l_returnflag") != "R").alias("soft"), (F.col("l_quantity") < 40).alias("shallow")))


@query("undriven", "SELECT c_custkey AS operation FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def undriven(spark, d):
    return c.undriven(g.table(spark, d, "customer").select(F.col("c_custkey").alias("operation")), g.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("operation")))


@query(
    "ledger_state",
    """WITH r AS (SELECT user_id AS wave, event_id AS line_no, CASE WHEN event_type IN ('view', 'signup') THEN 'open' ELSE 'close' END AS action, epoch_us(ts) AS moment FROM events WHERE event_type <> 'error'),
    s AS (SELECT wave, max(line_no) FILTER (action = 'open') AS o, max(line_no) FILTER (action = 'close') AS c, arg_max(moment, line_no) FILTER (action = 'open') AS oa, arg_max(moment, line_no) FILTER (action = 'close') AS ca FROM r GROUP BY wave)
    SELECT wave, oa AS opened_at, CASE WHEN c IS NOT NULL AND (o IS NULL OR c > o) THEN ca END AS closed_at, NOT (c IS NOT NULL AND (o IS NULL OR c > o)) AS is_open FROM s""",
)
def ledger_state(spark, d):
    e = g.table(spark, d, "events").where("event_type <> 'error'")
    return c.ledger_state(e.select(F.col("user_id").alias("wave"), F.col("event_id").alias("line_no"), F.when(F.col("event_type").isin("view", "signup"), "open").otherwise("close").alias("action"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")))


@query(
    "verdict_cascade",
    """WITH x AS (SELECT event_id AS i FROM events), v AS (SELECT i % 7 <> 0 AS bound, i % 11 = 0 AS prov, i % 5 <> 0 AS alias, i % 3 <> 0 AS ans, i % 4 = 0 AS decl, i % 2 = 0 AS eq, i % 13 < 6 AS dv, i % 17 < 8 AS ov FROM x)
    SELECT CASE WHEN NOT bound OR prov THEN 'NO VERDICT' WHEN NOT alias THEN 'FAILED' WHEN decl AND NOT ans THEN 'PASSED' WHEN decl THEN 'NO VERDICT' WHEN NOT ans THEN 'FAILED' WHEN eq THEN 'PASSED' WHEN dv AND ov THEN 'DIVERGED' ELSE 'FAILED' END AS outcome, count(*) AS n FROM v GROUP BY 1""",
)
def verdict_cascade(spark, d):
    i = F.col("event_id")
    outcome = c.verdict(i % 7 != 0, i % 11 == 0, i % 5 != 0, i % 3 != 0, i % 4 == 0, i % 2 == 0, i % 13 < 6, i % 17 < 8)
    return g.table(spark, d, "events").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "index_repetition",
    """WITH r AS (SELECT DISTINCT user_id % 30 AS run, user_id % 30 // 2 AS commit, event_id % 97 AS hash FROM events WHERE event_id % 5 = 0) SELECT b.run, count(*) AS repeats, bool_and(a.commit = b.commit) AS same_commit FROM r b JOIN r a ON a.run + 1 = b.run AND a.hash = b.hash GROUP BY b.run""",
)
def index_repetition(spark, d):
    run = F.col("user_id") % 30
    return c.repeated_index(g.table(spark, d, "events").where("event_id % 5 = 0").select(run.alias("run"), F.floor(run / 2).alias("commit"), (F.col("event_id") % 97).alias("hash")))


@query("dominant_stems", "SELECT stem, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(regexp_replace(p_name || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z]+')) AS stem FROM part) WHERE stem <> '' GROUP BY stem ORDER BY n DESC, stem LIMIT 5")
def dominant_stems(spark, d):
    return c.dominant_stems(g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_type").alias("name")))


@query("members_without_role", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def members_without_role(spark, d):
    roles = g.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") > 400000).alias("has_centroid"))
    return c.without_role(g.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), roles)


@query("row_ordinals", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def row_ordinals(spark, d):
    return o.ordinals(g.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("functor_order", "SELECT s_suppkey AS id, s_acctbal AS coverage, s_nationkey::DOUBLE AS fidelity FROM supplier ORDER BY round(s_acctbal * s_nationkey, 9) DESC, id LIMIT 25")
def functor_order(spark, d):
    return o.functor_order(suppliers(spark, d).select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("coverage"), F.col("s_nationkey").cast("double").alias("fidelity")), 25)


@query("functor_edge_order", "SELECT s_suppkey AS id, s_nationkey::DOUBLE AS fidelity, s_acctbal AS similarity FROM supplier ORDER BY fidelity DESC, similarity DESC, id LIMIT 25")
def functor_edge_order(spark, d):
    return o.functor_edge_order(suppliers(spark, d).select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("fidelity"), F.col("s_acctbal").alias("similarity")), 25)


@query("truncation_probe", "SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') > 10 AS truncated FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 10")
def truncation_probe(spark, d):
    return o.page(g.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"), ["c_custkey"], 10)


@query("cluster_ranks", "SELECT c_nationkey AS label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(c_custkey)) - 1 AS cluster FROM customer GROUP BY 1")
def cluster_ranks(spark, d):
    return o.cluster_ranks(g.table(spark, d, "customer").select(F.col("c_nationkey").alias("label"), F.col("c_custkey").alias("id"))).withColumn("cluster", F.col("cluster").cast("long"))


@query(
    "neighbour_cap",
    graph_sql(""", b AS (SELECT src_id AS id, dst_id AS other, 0 AS side FROM g_edges UNION ALL SELECT dst_id, src_id, 1 FROM g_edges), n AS (SELECT id, other, min(side) AS side FROM b WHERE id <> other GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, other) AS rn FROM n) SELECT id, other, CASE side WHEN 0 THEN 'out' ELSE 'in' END AS direction FROM r WHERE rn <= 6"""),
)
def neighbour_cap(spark, d):
    return o.capped_neighbours(g.edges(spark, d))


@query("decision_rank", "SELECT c_custkey AS id, c_acctbal AS uncertainty, (c_custkey % 9)::DOUBLE AS blast, round(c_acctbal * (c_custkey % 9), 6) + 0.0 AS score, row_number() OVER (ORDER BY round(c_acctbal * (c_custkey % 9), 9) DESC, c_custkey) AS rank FROM customer")
def decision_rank(spark, d):
    rows = g.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("uncertainty"), (F.col("c_custkey") % 9).cast("double").alias("blast"))
    return o.ranked_decisions(rows).select("id", "uncertainty", "blast", (F.round("score", 6) + F.lit(0.0)).alias("score"), "rank")
