"""Queries: profiles, entropy, neighbours, motifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as g
from tessera.functions.vectors import bucket_key
from tessera.operators import motifs, profiles as p, similarity as s
from tessera.registry import graph_sql, query
from tessera.schema import DIMS

INC = """, inc AS (SELECT src_id AS id, kind, 'out' AS direction, dst_id AS other FROM g_edges UNION ALL SELECT dst_id, kind, 'in', src_id FROM g_edges)
, prof AS (SELECT id, kind, direction, count(*) AS n FROM inc WHERE id IN (SELECT id FROM g_nodes) GROUP BY ALL)"""
_VEC = ", ".join(f"coalesce(sum(n) FILTER (p.kind = '{k}' AND direction = '{d}'), 0)::BIGINT" for k, d in DIMS)
VEC = f"{INC}, vecs AS (SELECT n.id, n.kind AS kind, n.repo, [{_VEC}] AS vec FROM g_nodes n LEFT JOIN prof p ON p.id = n.id GROUP BY n.id, n.kind, n.repo)"


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("hom_profile_d1", graph_sql(f"{INC} SELECT id, kind, direction, n FROM prof"))
def hom_profile_d1(spark, d):
    return p.profile_long(g.nodes(spark, d), g.edges(spark, d))


@query("hom_profile_excluding", graph_sql(f"{INC} SELECT id, kind, direction, n FROM prof WHERE id NOT IN (SELECT id FROM g_nodes WHERE kind IN ('method', 'field'))"))
def hom_profile_excluding(spark, d):
    return p.profile_long(g.nodes(spark, d), g.edges(spark, d), ("method", "field"))


@query("hom_profile_weighted", graph_sql(f"{INC} SELECT id, kind, direction, round(n * CASE kind WHEN 'CONTAINS' THEN 0.5 WHEN 'CALLS' THEN 2.0 ELSE 1.0 END, 6) AS n FROM prof"))
def hom_profile_weighted(spark, d):
    return p.profile_weighted(g.nodes(spark, d), g.edges(spark, d), {"CONTAINS": 0.5, "CALLS": 2.0}).select("id", "kind", "direction", *r6("n"))


@query(
    "hom_profile_d2",
    graph_sql(f"""{INC}, blk AS (SELECT id, kind || ':' || direction AS block, other FROM inc WHERE id IN (SELECT id FROM g_nodes)),
    sz AS (SELECT id, block, count(*) AS size FROM blk GROUP BY ALL)
    SELECT b.id, b.block, p.kind || ':' || p.direction AS dim, round(sum(p.n) / any_value(size), 6) AS mean FROM blk b JOIN prof p ON p.id = b.other JOIN sz ON sz.id = b.id AND sz.block = b.block GROUP BY b.id, b.block, dim"""),
)
def hom_profile_d2(spark, d):
    return p.profile_depth2(g.nodes(spark, d), g.edge_sets(spark, d), g.KINDS).select("id", "block", "dim", *r6("mean"))


_ENT = "-sum(n / total * log2(n / total))"


@query(
    "profile_entropy",
    graph_sql(f"""{VEC}, gr AS (SELECT vec, count(*) AS n FROM vecs GROUP BY vec), t AS (SELECT sum(n) AS total, count(*) AS n_distinct FROM gr),
    r AS (SELECT any_value(total)::BIGINT AS n, any_value(n_distinct) AS n_distinct, {_ENT} AS bits, (SELECT sum(n) FROM (SELECT n FROM gr ORDER BY n DESC LIMIT 10)) / any_value(total) AS top_share FROM gr, t)
    SELECT n, n_distinct, round(bits, 6) AS bits, round(top_share, 6) AS top_share, CASE WHEN bits >= 4.0 AND top_share <= 0.5 THEN 'PROCEED' WHEN bits < 4.0 AND top_share > 0.7 THEN 'BLOCKED' ELSE 'BORDERLINE' END AS verdict FROM r"""),
)
def profile_entropy(spark, d):
    return p.entropy_report(p.profile_array(g.nodes(spark, d), g.edges(spark, d))).select("n", "n_distinct", *r6("bits", "top_share"), "verdict")


@query(
    "entropy_by_kind",
    graph_sql(f"""{VEC}, gr AS (SELECT kind, vec, count(*) AS n FROM vecs GROUP BY ALL), t AS (SELECT kind, sum(n) AS total FROM gr GROUP BY kind)
    SELECT kind, sum(n)::BIGINT AS n, count(*) AS n_distinct, round({_ENT}, 6) AS bits FROM gr JOIN t USING (kind) GROUP BY kind"""),
)
def entropy_by_kind(spark, d):
    v = p.profile_array(g.nodes(spark, d), g.edges(spark, d), ("kind",))
    return p.entropy_by(v, "kind", "vec").select("kind", "n", "n_distinct", *r6("bits"))


_BLANK = " UNION ALL ".join(f"SELECT '{k}' AS kind, list_transform(vec, lambda x, i: CASE WHEN i IN ({2 * j + 1}, {2 * j + 2}) THEN 0 ELSE x END) AS vec FROM vecs" for j, k in enumerate(dict.fromkeys(k for k, _ in DIMS)))


@query(
    "marginal_entropy",
    graph_sql(f"""{VEC}, bl AS ({_BLANK} UNION ALL SELECT '', vec FROM vecs), gr AS (SELECT kind, vec, count(*) AS n FROM bl GROUP BY ALL), t AS (SELECT kind, sum(n) AS total FROM gr GROUP BY kind),
    b AS (SELECT kind, {_ENT} AS bits FROM gr JOIN t USING (kind) GROUP BY kind), f AS (SELECT bits AS full_bits FROM b WHERE kind = '')
    SELECT kind, round(bits, 6) AS bits, round(full_bits - bits, 6) + 0.0 AS delta, CASE WHEN round(full_bits - bits, 9) > 0.1 THEN 'HIGH' WHEN round(full_bits - bits, 9) > 0.01 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM b, f WHERE kind <> ''"""),
)
def marginal_entropy(spark, d):
    return p.marginal_entropy(p.profile_array(g.nodes(spark, d), g.edges(spark, d))).select("kind", *r6("bits"), (F.round("delta", 6) + 0.0).alias("delta"), "level")


def _key(k: str, even: bool) -> str:
    return f"array_to_string(list_transform(vec, lambda x: {'round_even' if even else 'round'}(CASE WHEN list_sum(vec) = 0 THEN 0.0::DOUBLE ELSE x / list_sum(vec)::DOUBLE END * {k}, 0)::BIGINT), ',')"


@query(
    "role_buckets",
    graph_sql(f"""{VEC} SELECT substr(sha256(sum(('0x' || substr(md5(id), 1, 8))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(md5(id), 9, 8))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(md5(id), 17, 8))::BIGINT)::VARCHAR), 1, 16) AS role_id, {_key("4", True)} AS "key", count(*) AS n, min(id) AS first_member
    FROM vecs WHERE list_sum(vec) > 0 GROUP BY "key" HAVING count(*) >= 2"""),
)
def role_buckets(spark, d):
    return p.role_buckets(p.profile_array(g.nodes(spark, d), g.edges(spark, d)), 4)


@query(
    "role_entropy_curve",
    graph_sql(f"""{VEC}, ks AS (SELECT unnest(range(1, 13))::INTEGER AS k), gr AS (SELECT k, {_key("k", False)} AS "key", count(*) AS n FROM vecs, ks GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY k) AS total, row_number() OVER (PARTITION BY k ORDER BY n DESC, "key") AS rn FROM gr)
    SELECT k, round({_ENT}, 6) AS bits, round(sum(n / total) FILTER (rn <= 5), 6) AS top5, count(*) AS n_classes FROM t GROUP BY k"""),
)
def role_entropy_curve(spark, d):
    return p.role_curve(p.profile_array(g.nodes(spark, d), g.edges(spark, d))).select("k", *r6("bits", "top5"), "n_classes")


@query("orbit_classes", graph_sql(f'{VEC} SELECT repo AS "group", count(*) AS n, min(id) AS first_member FROM vecs GROUP BY repo, vec'))
def orbit_classes(spark, d):
    return p.orbits(p.profile_array(g.nodes(spark, d), g.edges(spark, d), ("repo",)), F.col("repo"))


def _vectors(spark, d):
    return g.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("repo"), F.col("embedding").cast("array<double>").alias("vec"))


_V = "WITH v AS (SELECT vec_id AS id, label::VARCHAR AS repo, embedding::DOUBLE[] AS vec FROM embeddings), s AS (SELECT vec AS sv, repo AS sr FROM v WHERE id = 7)"


@query("embedding_knn", f"{_V} SELECT id, repo, round(list_cosine_distance(vec, sv), 6) AS distance FROM v, s WHERE id <> 7 ORDER BY round(list_cosine_distance(vec, sv), 9), id LIMIT 25")
def embedding_knn(spark, d):
    return s.knn(_vectors(spark, d), 7, 25).select("id", "repo", *r6("distance"))


@query("role_equivalent", f"{_V} SELECT id, repo, round(list_cosine_distance(vec, sv), 6) AS distance FROM v, s WHERE id <> 7 AND repo <> sr ORDER BY round(list_cosine_distance(vec, sv), 9), id LIMIT 25")
def role_equivalent(spark, d):
    return s.knn(_vectors(spark, d), 7, 25, repo="other").select("id", "repo", *r6("distance"))


def _pairs(spark, d, min_sim, cap=None):
    """Pairs of vectors of one label, for a stated set of sources: ids divisible by 20."""
    v = _vectors(spark, d)
    return s.compared(v.where("id % 20 = 0"), v, min_sim, "repo", cap)


_PAIRS = "WITH v AS (SELECT vec_id AS id, label AS repo, embedding::DOUBLE[] AS vec FROM embeddings), pr AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.vec, b.vec) AS sim FROM v a JOIN v b ON a.repo = b.repo AND a.id <> b.id WHERE a.id % 20 = 0)"


@query(
    "relative_cut_candidates",
    _PAIRS + """, r AS (SELECT *, max(sim) OVER w AS best, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS rank FROM pr WHERE round(sim, 9) >= 0.1 WINDOW w AS (PARTITION BY src)),
    c AS (SELECT *, count(*) FILTER (round(sim, 9) >= round(best - 0.02, 9)) OVER (PARTITION BY src) AS n_close FROM r), k AS (SELECT * FROM c WHERE (round(sim, 9) >= round(best - 0.02, 9) AND rank <= 400) OR (n_close < 10 AND rank <= 10))
    SELECT src, dst, round(sim, 6) AS sim, rank, round(coalesce(sim - lead(sim) OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst), 1.0), 6) AS margin FROM k""",
)
def relative_cut_candidates(spark, d):
    return s.relative_cut(_pairs(spark, d, 0.1, cap=400), min_sim=0.1).select("src", "dst", *r6("sim"), F.col("rank").cast("long").alias("rank"), *r6("margin"))


@query(
    "twins_with_margin",
    _PAIRS + """, r AS (SELECT src, dst, sim, coalesce(sim - lead(sim) OVER w, 1.0) AS margin, row_number() OVER w AS rn FROM pr WHERE round(sim, 9) >= 0.0 WINDOW w AS (PARTITION BY src ORDER BY round(sim, 9) DESC, dst))
    SELECT src, dst, round(sim, 6) AS sim, round(margin, 6) AS margin FROM r""",
)
def twins_with_margin(spark, d):
    return s.with_margin(_pairs(spark, d, 0.0), ["src"], "sim", "dst").select("src", "dst", *r6("sim", "margin"))


@query(
    "typed_jaccard",
    graph_sql(f"""{INC}, f AS (SELECT DISTINCT id, direction || '|' || kind || '|' || other AS f FROM inc), own AS (SELECT f FROM f WHERE id = 'U:1'), sh AS (SELECT id, count(*) AS both_n FROM f WHERE id <> 'U:1' AND f IN (FROM own) GROUP BY id),
    sz AS (SELECT id, count(*) AS size FROM f WHERE id IN (SELECT id FROM sh) GROUP BY id) SELECT id, round(sc, 6) AS score FROM (SELECT id, both_n / (size + (SELECT count(*) FROM own) - both_n) AS sc FROM sh JOIN sz USING (id)) ORDER BY round(sc, 9) DESC, id LIMIT 25"""),
)
def typed_jaccard(spark, d):
    return s.typed_jaccard(g.edges(spark, d), "U:1", 25).select("id", *r6("score"))


_MOTIF = f"""{INC}, own AS (SELECT i.id, a.kind AS anchor_kind, a.repo, i.direction, i.kind || ':' || o.kind AS arm, i.other, i.idx FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, direction, other) AS idx FROM inc) i
  JOIN g_nodes o ON o.id = i.other JOIN g_nodes a ON a.id = i.id WHERE idx <= 30),
pr AS (SELECT a.anchor_kind, a.repo, CASE WHEN a.direction <> b.direction THEN 'path' WHEN a.direction = 'out' THEN 'v' ELSE 'w' END AS shape, a.direction AS ad, a.arm AS aa, b.arm AS ba
  FROM own a JOIN own b ON a.id = b.id AND a.idx < b.idx AND a.other <> b.other),
sg AS (SELECT shape, repo, shape || ' ' || anchor_kind || ' ' || CASE WHEN shape = 'path' THEN CASE WHEN ad = 'in' THEN aa || ' ' || ba ELSE ba || ' ' || aa END ELSE least(aa, ba) || ' ' || greatest(aa, ba) END AS signature FROM pr)"""


@query("motifs_3node", graph_sql(f"{_MOTIF} SELECT signature, shape, count(*) AS support, count(DISTINCT repo) AS n_repos FROM sg GROUP BY signature, shape HAVING count(*) >= 5"))
def motifs_3node(spark, d):
    return motifs.motif_counts(g.nodes(spark, d), g.edge_sets_at_dst(spark, d), kinds=g.KINDS, at_dst=True)


@query("typed_2chains", graph_sql(" SELECT a.kind AS kind1, b.kind AS kind2, count(*)::BIGINT AS n, count(DISTINCT n.repo) AS n_repos FROM g_edges a JOIN g_edges b ON a.dst_id = b.src_id JOIN g_nodes n ON n.id = a.src_id GROUP BY a.kind, b.kind"))
def typed_2chains(spark, d):
    return motifs.two_chains(g.nodes(spark, d), g.edges(spark, d))


@query(
    "motif_instances_balanced",
    graph_sql(""", f AS (SELECT kind, repo, id, row_number() OVER (PARTITION BY kind, repo ORDER BY id) AS rn FROM g_nodes), r AS (SELECT kind, repo, id, row_number() OVER (PARTITION BY kind ORDER BY rn, repo, id) AS place FROM f WHERE rn <= 3)
    SELECT kind, repo, id, place FROM r WHERE place <= 10"""),
)
def motif_instances_balanced(spark, d):
    return motifs.balanced_sample(g.nodes(spark, d), "kind", "repo", "id", 3, 10)
