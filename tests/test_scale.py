"""The work that a query does, and its results where the way to them has changed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph_algorithms as ga, modules as mo, profiles as pr, similarity as si


@pytest.fixture
def cuts(monkeypatch):
    """Frames that are stored."""
    seen, cut = [], ga.cut
    monkeypatch.setattr(ga, "cut", lambda df: seen.append(1) or cut(df))
    return seen


def power_graph(spark, rows):
    ids = sorted({v for r in rows for v in r[:2]})
    a = np.zeros((len(ids), len(ids)))
    for s, t, w in rows:
        a[ids.index(t), ids.index(s)] += w
    return spark.createDataFrame(rows, "src_id string, dst_id string, weight long"), ids, a


CYCLE = [("a", "b", 3), ("b", "c", 1), ("c", "a", 2), ("c", "d", 7), ("a", "d", 1), ("e", "a", 1)]
CHAIN = [("a", "b", 3), ("b", "c", 1), ("a", "c", 5)]


@pytest.mark.parametrize("rows", [CYCLE, CHAIN, [(s, t, w * 10**9) for s, t, w in CYCLE]])
def test_eigenvector_is_the_power_iteration(spark, rows):
    e, ids, a = power_graph(spark, rows)
    v = np.ones(len(ids))
    for _ in range(50):
        v = v + a @ v
        v /= np.linalg.norm(v)
    got = {r["id"]: r["score"] for r in ga.eigenvector(e).collect()}
    assert [got[i] for i in ids] == pytest.approx(v.tolist(), abs=1e-12)


@pytest.mark.parametrize("rows", [CYCLE, CHAIN, [*CYCLE, ("a", "no node", 4), ("d", "no node", 1)]])
def test_pagerank_is_the_round_by_round_one(spark, rows):
    e, ids, a = power_graph(spark, [r for r in rows if r[1] != "no node"])
    out = {s: sum(w for x, _, w in rows if x == s) for s in ids}
    a /= [max(out[i], 1) for i in ids]
    ends = a.sum(axis=0) == 0
    rank = np.full(len(ids), 1 / len(ids))
    for _ in range(20):
        rank = 0.15 / len(ids) + 0.85 * (a @ rank + rank[ends].sum() / len(ids))
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame(rows, "src_id string, dst_id string, weight long")
    got = {r["id"]: r["rank"] for r in ga.pagerank(nodes, e).collect()}
    assert [got[i] for i in ids] == pytest.approx(rank.tolist(), abs=1e-12)


def test_rounds_end_with_the_longest_path(spark, cuts):
    e, ids, _ = power_graph(spark, CHAIN)
    ga.eigenvector(e).collect()
    assert len(cuts) <= 6
    cuts.clear()
    ga.pagerank(spark.createDataFrame([(i,) for i in ids], "id string"), e).collect()
    assert len(cuts) <= 7


def test_candidates_are_judged_from_one_row_a_pair_of_nodes(spark):
    """A node with several candidates counts an arm once; parallel edges of several kinds are one row, seen from both ends."""
    src = [("a", "b", "K1"), ("a", "b", "K2"), ("a", "c", "K1"), ("b", "a", "K1"), ("a", "a", "K1"), ("d", "e", "K1")]
    dst = [("A", "B", "K1"), ("A", "B2", "K1"), ("A", "B2", "K2"), ("A", "A", "K1"), ("B", "A", "K2")]
    cand = [("a", "A", 0.9), ("b", "B", 0.9), ("b", "B2", 0.8), ("c", "C", 0.9), ("d", "D", 0.01), ("d", "D2", 0.01)]
    e, i = (spark.createDataFrame(r, "src_id string, dst_id string, kind string") for r in (src, dst))
    c = ga.numbered(spark.createDataFrame(cand, "s string, t string, sigma double"))
    met, degree, held, kinds = ga.edge_pairs(e, i, c)
    assert met.count() == 3 and kinds == ["K1", "K2"]
    held.unpersist()

    def arms(rows):
        return {(s, "o" + k, t) for s, t, k in rows} | {(t, "i" + k, s) for s, t, k in rows}

    sa, ta = arms(src), arms(dst)
    assert {r["s"]: r["deg"] for r in degree.collect()} == {s: sum(x[0] == s for x in sa) for s in "abcde"}
    ok = {(s, t) for s, t, x in cand if x >= 0.05 and len({(k, n) for a, k, n in sa if a == s for m, u, _ in cand if m == n and (t, k, u) in ta}) >= 0.5 * sum(a == s for a, _, _ in sa)}
    rest = {min((-x, s, t) for s, t, x in cand if s == n)[1:] for n in {s for s, _, _ in cand} - {s for s, _ in ok}}
    assert {(r["s"], r["t"]) for r in ga.arc_consistent(e, i, c.drop("p"), share=0.5).collect()} == ok | rest
    got = ga.flood_similarity(e, i, c.drop("p")).collect()
    assert len(got) == len(cand) and all(0 <= r["sigma"] <= 1 for r in got)


@pytest.mark.parametrize("cap", [None, 3])
def test_vectors_are_compared_in_blocks(spark, cap):
    """The same as all pairs in one group, whatever blocks they come in; null vectors and groups meet nothing, a zero vector's cosine is 0."""
    rng = np.random.default_rng(3)
    rows = [(i, str(i % 3), rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(60, "0", None), (61, None, [1.0, 0.0, 0.0, 0.0]), (62, "0", [0.0] * 4), (63, "0", [1.0, None, 0.0, 0.0]), *[(64 + k, "1", rows[5][2]) for k in range(20)]]
    v = spark.createDataFrame(rows, "id long, repo string, vec array<double>").repartition(5)
    pairs = si.compared(v.where("id % 5 = 0"), v, 0.0, "repo", cap, block=4)
    live = [r for r in rows if r[1] and r[2] and None not in r[2]]
    cos = lambda x, y: float(np.dot(x, y) / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300))
    want = [(a, b, cos(x, y)) for a, p, x in live if a % 5 == 0 for b, q, y in live if p == q and a != b and round(cos(x, y), 9) >= 0]
    if cap is None:
        assert sorted((r["src"], r["dst"], round(r["sim"], 9)) for r in pairs.collect()) == sorted((a, b, round(x, 9)) for a, b, x in want)
    else:
        got, ref = (si.relative_cut(p, 0.0, cap=cap).select("src", "dst", "rank", F.round("sim", 9), F.round("margin", 9)).collect() for p in (pairs, spark.createDataFrame(want, "src long, dst long, sim double")))
        assert sorted(got) == sorted(ref)


def test_moves_shuffle_pairs_once(spark):
    """Links, own ones and the best target come from one pass: no join of links with themselves. Ties go to the smaller name."""
    e = spark.createDataFrame([("a", "b", "K"), ("a", "b", "L"), ("c", "a", "K"), ("d", "a", "K"), ("a", "a", "K"), ("e", "c", "K"), ("e", "d", "K")], "src_id string, dst_id string, kind string")
    m = spark.createDataFrame([("a", "m1"), ("b", "m2"), ("c", "m3"), ("d", "m2"), ("e", "m9")], "id string, module string")
    out = mo.realign_moves(e, m)
    assert {tuple(r) for r in out.collect()} == {("a", "m1", "m2", 2, 3), ("b", "m2", "m1", 0, 2), ("c", "m3", "m1", 0, 1), ("d", "m2", "m1", 0, 1), ("e", "m9", "m2", 0, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df):
    """Shuffles of the plan that ran; those used again count once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange " in line and "ReusedExchange" not in line for line in plan.splitlines())


def brute_depth2(nodes, edges):
    """(id, block, dim): mean. edges: src, dst, kind."""
    inc = [x for s, t, k in edges for x in ((s, f"{k}:out", t), (t, f"{k}:in", s))]
    prof, out = {}, {}
    for i, dim, _ in inc:
        prof.setdefault(i, {}).setdefault(dim, 0)
        prof[i][dim] += 1
    for i, block, other in inc:
        if i in nodes and other in nodes:
            for dim, n in prof[other].items():
                out[i, block, dim] = out.get((i, block, dim), 0) + n
    return {(i, b, d): x / sum(1 for j, c, _ in inc if (j, c) == (i, b)) for (i, b, d), x in out.items()}


@pytest.mark.parametrize("word", [40, 2])
def test_depth2_is_sent_packed(spark, no_broadcast, monkeypatch, word):
    """Null and unknown ends count in a block's size only; many kinds, counts beyond 16 bits and pairs in one row give the same means."""
    monkeypatch.setattr(pr, "WORD", word)
    n_kinds, rng = 3, np.random.default_rng(5)
    ids = [f"v{i}" for i in range(12)]
    rows = [(str(rng.choice(ids)), str(rng.choice(ids)), f"K{rng.integers(n_kinds)}") for _ in range(150)] + [("v1", "v2", "K1")] * 3 + [("v3", None, "K0"), (None, "v3", "K1"), ("v4", "gone", "K0"), ("gone", "v4", "K0"), ("v5", "v5", "K2"), ("", "v1", "K0")]
    nodes = spark.createDataFrame([(i,) for i in [*ids, "", None]], "id string")
    edges = spark.createDataFrame(rows, "src_id string, dst_id string, kind string")
    want = brute_depth2({*ids, ""}, rows)
    for e in (edges, edges.groupBy("src_id", "dst_id").agg(F.collect_set("kind").alias("kinds"))):
        got = pr.profile_depth2(nodes, e).collect()
        if "kinds" in e.columns:
            want = brute_depth2({*ids, ""}, sorted(set(rows), key=str))
        assert len(got) == len(want) and {tuple(r)[:3]: r["mean"] for r in got} == pytest.approx(want)
    assert shuffles(pr.profile_depth2(nodes, edges, tuple(f"K{i}" for i in range(n_kinds)))) <= 3  # nodes, edges, profiles
    big = spark.range(70_000).select(F.lit("hub").alias("src_id"), F.concat(F.lit("leaf"), "id").alias("dst_id"), F.lit("K").alias("kind"))
    hub = pr.profile_depth2(spark.createDataFrame([("hub",), ("leaf0",)], "id string"), big).collect()
    assert {tuple(r) for r in hub} == {("leaf0", "K:in", "K:out", 70_000.0), ("hub", "K:out", "K:in", 1 / 70_000)}


def test_parallel_edges_of_a_row_are_collapsed(spark, monkeypatch):
    """A row with all kinds of a pair weighs what its edges do; what a task holds doesn't follow the table, as tasks do."""
    from tessera import dealing

    rows = [("a", "b", ["K", "L"], None), ("a", "b", ["M"], 4), ("b", "a", ["K"], 1), (None, "a", ["K", "M"], 2)]
    sets = spark.createDataFrame(rows, "src_id string, dst_id string, kinds array<string>, count long")
    single = sets.select("src_id", "dst_id", F.explode("kinds").alias("kind"), "count")
    want = {("a", "b", 7), ("b", "a", 2), (None, "a", 6)}
    assert {tuple(r) for r in ga.collapse(sets).collect()} == want == {tuple(r) for r in ga.collapse(single).collect()}
    monkeypatch.setattr(dealing, "tasks", lambda *frames: 7)
    assert "RepartitionByExpression [src_id" in ga.collapse(sets)._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_follow_the_files(spark, tmp_path, monkeypatch):
    from tessera import dealing

    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(dealing, "PER_TASK", 10_000)
    one = dealing.tasks(t)
    assert one > 10 and dealing.tasks(t.unionByName(t)) in (2 * one - 1, 2 * one)
    assert dealing.dealt(t, "id").rdd.getNumPartitions() == one


def test_reach_counts_a_source_once(spark):
    """Sources in several rows, of several kinds and null; pairs are made distinct after one dealing, by both ends."""
    from tessera.operators import cards

    rows = [("a", "x", ["K", "L"]), ("a", "x", ["L"]), ("b", "x", ["M", "K"]), (None, "x", ["K"]), ("c", "x", ["M"]), (None, "y", ["K"]), ("a", None, ["K"])]
    sets = spark.createDataFrame(rows, "src_id string, dst_id string, kinds array<string>")
    for e in (sets, sets.select("src_id", "dst_id", F.explode("kinds").alias("kind"))):
        out = cards.semantic_reach(e, ("K", "L"))
        assert {tuple(r) for r in out.collect()} == {("x", 2), ("y", 0), (None, 1)}
        assert "RepartitionByExpression [dst_id" in out._jdf.queryExecution().optimizedPlan().toString()


def test_insertion_needs_no_distinct_nodes(spark):
    from tessera.operators.graph_query import insert_edges

    nodes = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    row = "src_id string, dst_id string, kind string"
    new = spark.createDataFrame([("a", "b", "N"), ("a", "b", "N"), ("a", "z", "N"), ("z", "b", "N"), (None, "b", "N")], row)
    out = insert_edges(nodes, spark.createDataFrame([("q", "r", "K")], row), new)
    assert sorted(map(tuple, out.collect())) == [("a", "b", "N"), ("a", "b", "N"), ("q", "r", "K")]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def brute_motifs(nodes, edges, cap):
    """{(signature, shape): (support, repos)}, by the definition. nodes: id, kind, repo; edges: src, dst, kind."""
    arms, out, nodes = {}, {}, [n for n in nodes if n[0] is not None]
    for s, t, k in edges:
        arms.setdefault(s, []).append((k, "out", t))
        arms.setdefault(t, []).append((k, "in", s))
    for anchor, kind, repo in nodes:
        own = sorted(arms.get(anchor, []), key=lambda x: (x[0], x[1], x[2] is None, x[2]))[:cap]
        same = sum(n[0] == anchor for n in nodes)
        for i, (ak, ad, ao) in enumerate(own):
            for bk, bd, bo in own[i + 1 :]:
                for _, x, _ in (n for n in nodes if n[0] == ao != bo):
                    for _, y, _ in (n for n in nodes if n[0] == bo):
                        pair = (f"{ak}:{x}", f"{bk}:{y}")
                        shape = "path" if ad != bd else "v" if ad == "out" else "w"
                        pair = sorted(pair) if shape != "path" else pair if ad == "in" else pair[::-1]
                        n, repos = out.setdefault((" ".join([shape, kind, *pair]), shape), (0, set()))
                        out[" ".join([shape, kind, *pair]), shape] = (n + same, repos | {repo})
    return {k: (n, len(r)) for k, (n, r) in out.items()}


@pytest.mark.parametrize("word", [40, 2])
def test_motifs_are_counted_by_what_neighbours_share(spark, no_broadcast, monkeypatch, word):
    """Hubs above the cap, parallel edges in one row and in several, self-loops, ends that are null (last in the order) or no nodes, ids of several nodes."""
    from tessera.operators import motifs

    monkeypatch.setattr(pr, "WORD", word)
    rng, ids = np.random.default_rng(8), [f"v{i}" for i in range(14)]
    nodes = [(v, f"k{i % 3}", f"r{i % 4}") for i, v in enumerate(ids)] + [("v1", "k1", "r9"), ("v2", "k0", "r2"), (None, "k0", "r0"), ("", "k1", "r1")]
    rows = [(str(rng.choice(ids)), str(rng.choice(ids[:5])), f"K{rng.integers(5)}") for _ in range(120)] + [(s, f"v{i}", "K0") for i in range(14) for s in ("v3", "", "gone")]
    rows += [("v1", "v2", "K1")] * 3 + [("v3", None, "K0"), (None, "v3", "K0"), (None, "v4", "K0"), ("v4", "gone", "K0"), ("v5", "v5", "K2"), ("v0", "", "K4")] + [(None, "v9", "K0")] * 4
    e = spark.createDataFrame(rows, "src_id string, dst_id string, kind string")
    sets = e.withColumn("at", F.monotonically_increasing_id() % 2).groupBy("src_id", "dst_id", "at").agg(F.collect_set("kind").alias("kinds"))
    single = sorted(map(tuple, sets.select("src_id", "dst_id", F.explode("kinds")).collect()), key=str)
    frame = spark.createDataFrame(nodes, "id string, kind string, repo string")
    for cap in (4, 30):
        for edges, plain, kinds in ((e, rows, None), (sets, single, ("K4", "K3", "K2", "K1", "K0")), (sets.repartition(3, "dst_id"), single, None)):
            got = motifs.motif_counts(frame, edges, 1, cap, kinds, at_dst=edges.rdd.getNumPartitions() == 3).collect()
            assert {(r["signature"], r["shape"]): (r["support"], r["n_repos"]) for r in got} == brute_motifs(nodes, plain, cap)
    assert motifs.motif_counts(frame, e.limit(0)).collect() == []


def test_motifs_read_and_send_lines_once(spark, no_broadcast, monkeypatch):
    """Pairs go to dst, src and dst again; lines aren't shuffled before that, for each kind of pair or for each end."""
    from tessera import dealing
    from tessera.plans.mining_queries import motifs_3node

    monkeypatch.setattr(dealing, "PER_TASK", 100_000)
    out = motifs_3node(spark, "/root/testdata/sf0.001")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("FileScan" in line and "l_partkey" in line for line in plan.splitlines()) == 1
    assert sum("Exchange hashpartitioning(src_id" in line and "ReusedExchange" not in line for line in plan.splitlines()) == 1
