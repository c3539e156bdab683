"""Facts about small fixtures."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.operators import events, graph_algorithms as ga, graph_query as gq, local_graphs as lg, roles
from tessera.plans.cypher import cypher
from tessera.sources import files, python_code as pc

EV = "key long, t long, hlc struct<physical: long, logical: long, replica: string>, kind string, value long, status string"


def balance(spark, rows, as_of=None, how="require_confirmed"):
    df = spark.createDataFrame([(1, t, (p, lo, "a"), k, v, s) for k, v, t, p, lo, s in rows], EV)
    r = events.fold_balance(df, as_of, how).first()
    return r["balance"] if r else None


def test_folds(spark):
    inc, dec, res = "increment", "decrement", "reset"
    done = [(inc, 10, 1, 1, 0, "done"), (dec, 3, 2, 2, 0, "done"), (inc, 1, 3, 3, 0, "done")]
    assert balance(spark, done) == 8
    mixed = [(inc, 10, 1, 1, 0, "done"), (res, 4, 2, 2, 0, "done"), (dec, 1, 3, 3, 0, "done")]
    assert {balance(spark, p) for p in itertools.permutations(mixed)} == {3}
    assert balance(spark, [(inc, 3, 5, 1, 0, "done"), (res, 4, 5, 2, 0, "done"), (dec, 1, 5, 3, 0, "done")]) == 3
    assert balance(spark, [(res, 4, 5, 1, 0, "done"), (inc, 5, 5, 1, 1, "done")]) == 9
    assert balance(spark, [(inc, 5, 5, 1, 0, "done"), (res, 4, 5, 1, 1, "done")]) == 4
    assert balance(spark, [(inc, 10, 100, 1, 0, "done"), (res, 4, 500, 2, 0, "done")], as_of=200) == 10
    assert balance(spark, [(inc, 2, 1, 1, 0, "done"), (inc, 9, 2, 2, 0, "pending")]) == 2
    assert balance(spark, [(inc, 2, 1, 1, 0, "done"), (inc, 9, 2, 2, 0, "pending")], how="pending_only") == 9
    assert balance(spark, [(inc, 9, 2, 2, 0, "pending")]) is None


def test_greedy_matching_equals_sorted_pass(spark):
    rows = [(f"s{i}", f"t{(i * j) % 5}", ((i * 7 + j * 3) % 10) / 10) for i in range(6) for j in range(4)]
    best = {}
    for s, t, x in rows:
        best[(s, t)] = max(x, best.get((s, t), -1))
    used_s, used_t, want = set(), set(), set()
    for (s, t), x in sorted(best.items(), key=lambda p: (-p[1], p[0])):
        if s not in used_s and t not in used_t:
            want.add((s, t))
            used_s.add(s)
            used_t.add(t)
    df = spark.createDataFrame([(s, t, x) for (s, t), x in best.items()], "s string, t string, sigma double")
    assert {(r["s"], r["t"]) for r in ga.greedy_matching(df).collect()} == want


def cliques(spark):
    rows = [("r", f"{c}{i}", f"{c}{j}", 1.0) for c in "ab" for i in range(6) for j in range(i)] + [("r", "a0", "b0", 1.0)]
    return spark.createDataFrame(rows, "repo string, src_id string, dst_id string, weight double")


def test_cliques_with_a_bridge(spark):
    e = cliques(spark)
    got = {r["id"]: r["community"] for r in lg.louvain(e).collect()}
    assert {frozenset(v for v in got if got[v] == c) for c in set(got.values())} == {frozenset(f"{c}{i}" for i in range(6)) for c in "ab"}
    assert {r["id"] for r in lg.articulation_points(e).collect()} == {"a0", "b0"}
    top = {r["id"] for r in lg.betweenness(e).orderBy(F.desc("score")).limit(2).collect()}
    assert top == {"a0", "b0"}
    assert all(0 <= r["confidence"] <= 1 for r in lg.subsystems(e).collect())


def test_pagerank_sums_to_one(spark):
    e = cliques(spark).select("src_id", "dst_id", "weight")
    nodes = e.select(F.col("src_id").alias("id")).union(e.select("dst_id")).distinct().union(spark.createDataFrame([("lone",)], "id string"))
    assert ga.pagerank(nodes, e, rounds=5).agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_reach_is_cycle_safe(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "src_id string, dst_id string")
    got = {r["id"]: r["depth"] for r in ga.reach(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_role_violations(spark):
    gen = spark.createDataFrame([("Cache", "Store", 3), ("Store", "Logger", 2), ("O", "W", 4), ("W", "O", 2)], "i string, j string, support long")
    assert {(r["kind"], r["roles"], r["support"]) for r in roles.violations(gen).collect()} == {("missing_composite", "Cache>Store>Logger", 2), ("back_call_cycle", "O>W", 2)}


def test_search_and_cypher(spark):
    t = spark.createDataFrame([("RateLimiter", "identifier", "cline", "s1", 0), ("rate_limit", "identifier", "crewAI", "s2", 0), ("unrelated", "identifier", "cline", "s3", 0)], "text string, kind string, repo string, symbol_id string, pos long")
    assert gq.code_search(t, "rate").count() == 2 and gq.code_search(t, "rate", repo="cline").count() == 1 and gq.code_search(t, "r").count() == 0
    n = spark.createDataFrame([("n1", "class", "a"), ("n2", "method", "b's")], "id string, kind string, repo string")
    e = spark.createDataFrame([("n1", "n2", "CALLS")], "src_id string, dst_id string, kind string")
    assert cypher(n, e, "MATCH (a:class)-[r:CALLS]->(b) WHERE b.repo = $x RETURN a.id, b.id AS other", {"x": "b's"}).collect() == [("n1", "n2")]
    assert cypher(n, e, "MATCH (a) RETURN a.id ORDER BY a.id DESC LIMIT 1").first()[0] == "n2"
    with pytest.raises(ValueError):
        cypher(n, e, "CREATE (a)")


def test_python_source(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.py").write_text("a = 1")
    (tmp_path / "pkg" / "m.py").write_text("class Base:\n    size: Base = None\n\nclass Own(Base):\n    def go(self) -> Base:\n        self.size = 1\n        return helper()\n\ndef helper():\n    raise Own()\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (")
    x = pc.extract(pc.scan_files(spark, str(tmp_path)), "r").cache()
    assert {r["qualified_name"] for r in pc.symbols(x).collect()} == {"pkg/m.py", "pkg/bad.py", "pkg/m.py::Base", "pkg/m.py::Base::size", "pkg/m.py::Own", "pkg/m.py::Own::go", "pkg/m.py::helper"}
    assert x.where("record = 'error'").count() == 1
    name = {r["id"]: r["short_name"] for r in pc.symbols(x).collect()}
    got = {(name[r["src_id"]], r["kind"], name[r["dst_id"]]) for r in pc.resolve_edges(x).where("kind <> 'CONTAINS'").collect()}
    assert got == {("size", "TYPE_OF", "Base"), ("Own", "EXTENDS", "Base"), ("go", "RETURNS_TYPE", "Base"), ("go", "WRITES_FIELD", "size"), ("go", "CALLS", "helper"), ("helper", "CONSTRUCTS", "Own"), ("helper", "RAISES", "Own")}


def test_ledger(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('// note\n{"a": 1}\n\n{"a": 2\n')
    rows = files.read_ledger(spark, str(tmp_path / "l.jsonl"), "a long").select("a", "malformed").collect()
    assert sorted((r["malformed"], r["a"]) for r in rows if not r["malformed"]) == [(False, 1)] and sum(r["malformed"] for r in rows) == 1


def test_reach_and_matching_go_on_to_the_end(spark):
    n = 104
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src_id long, dst_id long")
    got = ga.reach(chain, spark.createDataFrame([(0,)], "id long"))
    assert {(r["id"], r["depth"]) for r in got.collect()} == {(i, i) for i in range(n + 1)}
    assert ga.reach(chain, spark.createDataFrame([(0,)], "id long"), max_depth=3).count() == 4
    # each pair but the best is blocked by a better one: a round settles one of them
    ladder = spark.createDataFrame([(i // 2 + i % 2, i // 2, 1 - i / 100) for i in range(40)], "s long, t long, sigma double")
    assert {(r["s"], r["t"]) for r in ga.greedy_matching(ladder).collect()} == {(i, i) for i in range(20)}


def test_strong_components_against_mutual_reach(spark):
    import random

    rnd = random.Random(3)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    to = {v: {v} for p in pairs for v in p}
    for _ in to:
        for a, b in pairs:
            to[a] |= to[b]
    want = {v: max(u for u in to[v] if v in to[u]) for v in to}
    want = {v: c for v, c in want.items() if list(want.values()).count(c) > 1}
    assert {r["id"]: r["component"] for r in ga.scc(spark.createDataFrame(pairs, "src_id long, dst_id long")).collect()} == want
    assert ga.scc(spark.createDataFrame([(1, 2)], "src_id long, dst_id long")).count() == 0


def test_betweenness_against_all_shortest_paths(spark):
    import random

    rnd = random.Random(8)
    pairs = sorted({(rnd.randrange(14), rnd.randrange(14)) for _ in range(32)} - {(i, i) for i in range(14)})
    for directed in (True, False):
        arcs = pairs if directed else [*pairs, *[(b, a) for a, b in pairs]]
        near = {v: {b for a, b in arcs if a == v} for v in range(14)}
        ids, want = {v for p in pairs for v in p}, dict.fromkeys(range(14), 0.0)
        for s in ids:
            paths, done = [[s]], {s: [[s]]}
            while paths:
                longer = [[*q, u] for q in paths for u in near[q[-1]] if u not in done]
                for q in longer:
                    done.setdefault(q[-1], []).append(q)
                paths = longer
            for t in ids & done.keys() - {s}:
                for q in done[t]:
                    for v in q[1:-1]:
                        want[v] += 1 / len(done[t])
        n = len(ids)
        df = spark.createDataFrame([("r", f"{a:02}", f"{b:02}", 1.0) for a, b in [*pairs, pairs[0]]], "repo string, src_id string, dst_id string, weight double")
        got = {int(r["id"]): r["score"] for r in lg.betweenness(df, directed=directed).collect()}
        assert got.keys() == ids and all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-6 for v in ids)


def test_refold_stores_a_retried_batch_once(spark, tmp_path):
    from tessera.streaming import folds

    rows = lambda *xs: spark.createDataFrame([(1, t, (t, 0, "a"), "increment", v, "done") for t, v in xs], EV)
    log = str(tmp_path / "log")
    assert folds.refold(spark, log, rows((1, 5)), 0).first()["balance"] == 5
    for _ in range(2):
        assert folds.refold(spark, log, rows((2, 7)), 1).first()["balance"] == 12
    assert spark.read.parquet(log).count() == 2
    got = []
    rows((3, 1), (4, 2)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EV).parquet(str(tmp_path / "in"))
    folds.start_refold(stream, str(tmp_path / "log2"), lambda df, _: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [r["balance"] for r in got] == [3]
    stored = spark.createDataFrame([("a", "h1"), ("b", "h2")], "file string, hash string")
    assert [r["file"] for r in folds.changed_files(spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h1")], "file string, hash string"), stored).orderBy("file").collect()] == ["b", "c"]


def test_artifacts_and_packs(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "fixtures.jsonl").write_text('{"fixture_id": "x", "title": "first"}\n{"fixture_id": "y"}\n')
    (tmp_path / "a" / "b" / "fixtures.jsonl").write_text('{"fixture_id": "x", "title": "second"}\n')
    (tmp_path / "a" / "other.jsonl").write_text('{"fixture_id": "z"}\n')
    got = {r["fixture_id"]: r["title"] for r in files.read_packs(spark, str(tmp_path / "a"), "fixture_id string, title string").collect()}
    assert got.keys() == {"x", "y"} and got["x"] == "second"  # a/b/fixtures.jsonl comes before a/fixtures.jsonl
    assert files.read_json_lines(spark, str(tmp_path / "a" / "other.jsonl"), "fixture_id string, n long").collect() == [("z", None)]
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert files.read_artifact(spark, str(tmp_path / "p"), {"has_p": True}, "has_p").count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_artifact(spark, str(tmp_path / "p"), {}, "has_p")


def test_sinks(spark, tmp_path):
    from tessera.operators import sinks

    path = str(tmp_path / "t")
    sinks.write_slices(spark.createDataFrame([("a", 1), ("b", 2)], "repo string, n int"), path, ["repo"])
    sinks.write_slices(spark.createDataFrame([("b", 3)], "repo string, n int"), path, ["repo"])
    assert sorted((r["repo"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    sinks.write_artifact(spark.range(2).withColumn("x", F.lit(1)), str(tmp_path / "u"), ["x", "id"])
    assert spark.read.parquet(str(tmp_path / "u")).columns == ["x", "id"]
    old, new = {"a": 1, "own": {"k": 1, "l": 2}, "kept": True}, {"a": 2, "own": {"k": 5}, "more": []}
    assert sinks.merged_manifest(old, new) == {"a": 2, "own": {"k": 5, "l": 2}, "kept": True, "more": []}


def test_text_functions(spark):
    from tessera.functions import text as t

    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert one(t.identifier_tokens, "parseHTTPResponse2_fast") == ["parse", "http", "response", "2", "fast"]
    assert one(t.parameters, "def go(self, a: int, *rest, b = 1) -> x") == ["a", "rest", "b"]
    assert one(t.doc_arity, ":param a: x\n@param b y") == 2 and one(t.doc_arity, "none") is None
    assert one(t.hlc_parse, "5:6:r") == (5, 6, "r") and one(t.hlc_parse, "x") is None
    assert one(t.iso_time, "1970-01-02") == 86_400_000_000 and one(t.iso_time, "soon") is None
    assert t.canonical_json({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    m = spark.sql("select map('b', 'x\"', 'a', 'y') as m").select(t.canonical_map(F.col("m")).alias("j")).first()["j"]
    assert m == '{"a":"y","b":"x\\""}'


def test_ordinals_hold_over_many_rows(spark):
    from tessera.operators import orders

    n = 300_000
    rows = spark.range(n).repartition(3).select("id", ((F.col("id") * 7919) % n).cast("double").alias("uncertainty"), F.lit(1.0).alias("blast"))
    got = orders.ranked_decisions(rows)
    assert got.where(F.col("rank") != n - F.col("uncertainty")).count() == 0 and got.count() == n
    few = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 1.0), (3, 5.0, 1.0)], "id long, uncertainty double, blast double")
    assert {r["id"]: r["rank"] for r in orders.ranked_decisions(few).collect()} == {3: 1, 1: 2, 2: 3}


def test_local_graphs_have_no_bound_on_nodes(spark):
    n = 210_000
    star = spark.range(n).select(F.lit("r").alias("repo"), F.lit("hub").alias("src_id"), F.format_string("n%06d", "id").alias("dst_id"), F.lit(1.0).alias("weight"))
    assert lg.articulation_points(star).collect() == [("r", "hub")]
    got = lg.betweenness(star, pivots=10, directed=True)
    assert got.count() == n + 1 and got.where("score <> 0").count() == 0
    assert [(r["birth"], r["death"]) for r in lg.persistence_h0(star).collect()] == [(0.0, 1.0)]
    assert [(r["community"], r["count"]) for r in lg.louvain(star).groupBy("community").count().collect()] == [("hub", n + 1)]


def test_reach_is_the_same_with_large_fronts(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "src_id string, dst_id string")
    seeds = spark.createDataFrame([("a",)], "id string")
    want = {"a": 0, "b": 1, "c": 2, "d": 3}
    for most in (ga.MAX_SENT, 0):
        monkeypatch.setattr(ga, "MAX_SENT", most)
        assert {r["id"]: r["depth"] for r in ga.reach(edges, seeds).collect()} == want


def test_profile_array_has_no_join(spark):
    from tessera.operators import profiles
    from tessera.schema import DIMS

    nodes = spark.createDataFrame([("x", "r1"), ("y", None), ("z", "r2")], "id string, repo string")
    edges = spark.createDataFrame([("x", "y", "CALLS"), ("x", "y", "CALLS"), ("y", "gone", "RAISES")], "src_id string, dst_id string, kind string")
    got = profiles.profile_array(nodes, edges, ("repo",))
    rows = {r["id"]: (r["repo"], {DIMS[i]: n for i, n in enumerate(r["vec"]) if n}) for r in got.collect()}
    assert rows == {"x": ("r1", {("CALLS", "out"): 2}), "y": (None, {("CALLS", "in"): 2, ("RAISES", "out"): 1}), "z": ("r2", {})}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_typed_jaccard_is_the_same_beyond_what_is_sent(spark):
    from tessera.operators import similarity

    edges = spark.createDataFrame([("s", "p", "CALLS"), ("s", "q", "CALLS"), ("t", "p", "CALLS"), ("t", "p", "CALLS"), ("u", "p", "RAISES")], "src_id string, dst_id string, kind string")
    assert similarity.typed_jaccard(edges, "s", 5).collect() == similarity.typed_jaccard(edges, "s", 5, max_sent=0).collect() == [("t", 0.5)]


def test_precision_and_recall_from_judged_rows(spark):
    from tessera.operators import scoring

    judged = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (2, 1, None)], "query long, rank int, hit int")
    total = spark.createDataFrame([(1, 4), (2, 2), (3, 1)], "query long, total long")
    assert [(r["k"], round(r["precision"], 6), round(r["recall"], 6)) for r in scoring.scored_ranks(judged, total, (1,)).collect()] == [(1, round(1 / 3, 6), round(0.25 / 3, 6))]


def test_a_pair_raises_once_whatever_its_flags(spark, tmp_path):
    import os

    from tessera import testgraph

    d = "/root/testdata/sf0.001"
    for f in os.listdir(d):
        if f != "lineitem.parquet":
            os.symlink(f"{d}/{f}", tmp_path / f)
    line = spark.read.parquet(f"{d}/lineitem.parquet").limit(1)
    other = lambda flag: line.withColumn("l_returnflag", F.lit(flag).cast("string"))
    other("R").unionByName(other("X")).unionByName(other(None)).unionByName(other("A")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = testgraph.edges(spark, str(tmp_path)).where("src_id like 'U:%'").groupBy("kind").count()
    assert {r["kind"]: r["count"] for r in got.collect()} == {"CONSTRUCTS": 1, "READS_FIELD": 1, "RAISES": 1}
