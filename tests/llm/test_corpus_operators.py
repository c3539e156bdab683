"""Near-duplicates, lines, leaks, mixing: brute-force versions and edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontaminate, embedding_dedup, line_dedup, mixing, near_copies, simhash
from tessera.llm.common import components
from tessera.llm.local_graph import roots

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, h int")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_roots(pairs):
    ids, root = roots(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = union_find({x for p in pairs for x in p}, pairs)
    assert dict(zip(ids.tolist(), root.tolist(), strict=True)) == want


def test_components(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    e = spark.createDataFrame([*pairs, (None, 3), (3, None)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(e).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert all(got.get(i, i) == c for i, c in want.items()) and set(got) == {x for a, b in pairs if a != b for x in (a, b)}
    assert components(e.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 3), st.integers(0, 2**32))
def test_trie_pairs(values, budget, seed):
    rnd = random.Random(seed)
    near = {v ^ (1 << rnd.randrange(64)) for v in values}
    fps = np.array(sorted(values | near), dtype=np.uint64)
    simhash.LEAF_PAIRS, old = 4, simhash.LEAF_PAIRS
    got = [(int(a), int(b)) for i, j in simhash.trie_pairs(fps, budget) for a, b in zip(i, j, strict=True)]
    simhash.LEAF_PAIRS = old
    want = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= budget]
    assert sorted(got) == want


def simple_fingerprint(text):
    import xxhash

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(80):
        w = rnd.choices(WORDS, k=rnd.choice([0, 1, 2, 3, 40, 400]))
        rows.append((i, " ".join(w)))
        if len(w) == 400:
            w[rnd.randrange(400)] = "changed"
            rows.append((100 + i, "\t".join(w).upper()))
    rows += [(500, None), (501, ""), (502, " \n"), (503, rows[0][1]), (503, rows[0][1]), (504, "É " * 30_000), (505, "nbsp word other")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {i: simple_fingerprint(t) for i, t in rows}
    assert all(r["fp"] % 2**64 == fp[r["doc_id"]] for r in got)
    ids = sorted(fp)
    want = union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = simhash.drop_near_duplicates(docs(spark, [*rows, (None, "x")]))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    """Two different texts under one doc_id both stay; repeated rows and copies under other ids go."""
    long = [" ".join(random.Random(k).choices(WORDS, k=60)) for k in range(4)]
    rows = [(1, long[0]), (1, long[1]), (1, long[0]), (2, long[1]), (3, long[2]), (3, long[2]), (4, None), (5, ""), (None, long[0]), (None, None)]
    for similarity in (None, 0.8):
        kept = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash.drop_near_duplicates(docs(spark, rows), 3, 3, min_similarity=similarity).collect()), key=str)
        # of long[1] the copy of the smaller number stays: under 1 or 2, as the second text of id 1 is numbered by a hash
        both = [t for _, t in kept if t == long[1]]
        assert len(both) == 1 and (1, long[0]) in kept and (3, long[2]) in kept and len([k for k in kept if k[0] == 3]) == 1
        assert len([k for k in kept if k[0] in (4, 5)]) == 1 and (0, long[0]) in kept and (0, None) in kept and len(kept) == 6


def test_embeddings(spark):
    rnd = np.random.default_rng(1)
    base = rnd.standard_normal((60, 16))
    rows, k = [], 0
    for i, v in enumerate(base):
        for s in (0, 0.02, 0.05, 0.1):
            rows.append((k, (v + s * rnd.standard_normal(16)).astype(np.float32).tolist(), i % 3))
            k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 1), (k + 2, (2 * np.array(rows[0][1])).tolist(), 0), (k + 3, None, 0), (k + 4, [0.0] * 16, 0), (k + 5, [float("nan")] * 16, 0), (k + 6, [None] * 16, 0), (k + 7, rows[0][1], None), (k + 8, [], 0), (k + 9, [1.0] * 8, 0), (k + 10, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "vec_id long, embedding array<float>, label int, dim int, links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    ok = [(i, np.array(e, dtype=np.float32).astype(float), lab) for i, e, lab in rows if lab is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    pairs = [(a[0], b[0]) for x, a in enumerate(ok) for b in ok[x + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    comp = union_find([r[0] for r in rows], pairs)
    n = {i: 0 for i in comp}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in comp}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_line_dedup(spark):
    rnd = random.Random(11)
    pool = [rnd.choices(WORDS, k=rnd.choice([2, 5, 9, 10, 14, 30])) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(6):
            w = list(rnd.choice(pool))
            edit = rnd.randrange(5)
            at = rnd.randrange(len(w))
            if edit == 0:
                w[at] = "new"
            elif edit == 1:
                del w[at]
            elif edit == 2:
                w.insert(at, "more")
            lines.append("  ".join(w) if rnd.random() < 0.2 else " ".join(w).title())
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (103, rows[0][1]), (104, " ".join(WORDS) * 3000), (None, rows[1][1])]
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    occ, first = [], {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t}):
        for k, line in enumerate(t.split("\n")):
            w = tuple(line.lower().split())
            if len(w) >= 5:
                occ.append((i, k, w))
                first[w] = min(first.get(w, (i, k)), (i, k))

    def near(a, b):
        d = np.arange(len(b) + 1)
        for x in a:
            new = np.empty_like(d)
            new[0] = d[0] + 1
            for j, y in enumerate(b, 1):
                new[j] = min(d[j] + 1, new[j - 1] + 1, d[j - 1] + (x != y))
            d = new
        return d[-1] <= 1

    late = {a for a in first if any(first[b] < first[a] and abs(len(a) - len(b)) <= 1 and max(len(a), len(b)) >= 10 and near(a, b) for b in first if b != a)}
    drop = {}
    for i, k, w in occ:
        if w in late or first[w] != (i, k):
            drop.setdefault(i, set()).add(k)
    for r in got:
        i, t = r["doc_id"], next(t for j, t in rows if j == r["doc_id"])
        gone = drop.get(i, set())
        assert r["text"] == (t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
        assert r["lines_dropped"] == len(gone)
    assert sum(map(len, drop.values())) > 50 and late
    thai = spark.createDataFrame([(1, "这是一个很长的句子没有空格"), (2, "x\n这是一个很长的句子没有空白"), (3, "短句")], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.dedup_lines(thai).orderBy("doc_id").collect()] == ["这是一个很长的句子没有空格", "x", "短句"]
    assert line_dedup.dedup_lines(docs(spark, rows).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.lists(st.sampled_from("abc"), max_size=20))
def test_myers(pattern, text):
    best, prev = (len(pattern), 0), list(range(len(pattern) + 1))
    for j, w in enumerate(text, 1):
        cur = [0]
        for i, x in enumerate(pattern, 1):
            cur.append(min(prev[i] + 1, cur[i - 1] + 1, prev[i - 1] + (x != w)))
        prev = cur
        best = min(best, (cur[-1], j), key=lambda b: b[0])
    assert decontaminate.myers(pattern, text) == best


@pytest.mark.parametrize("block_chars", [10, 4_000_000])
def test_leaks(spark, monkeypatch, block_chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block_chars)
    rnd = random.Random(13)
    items = [(i, " ".join(rnd.choices(WORDS, k=k))) for i, k in enumerate([3, 5, 8, 20, 40, 60])] + [(6, None), (7, ""), (3, None), (8, "今日は良い天気です"), (9, "omega")]
    rows = []
    for i in range(60):
        w = rnd.choices([x + "x" for x in WORDS], k=80)
        k = rnd.randrange(6)
        item = items[k][1].split()
        for _ in range(rnd.randrange(0, 3 + len(item) // 4)):
            item[rnd.randrange(len(item))] = "zz"
        rows.append((i, " ".join([*w[:30], *item, *w[30:]]).upper().replace(" ", ", ")))
    rows += [(100, None), (101, ""), (102, ("pad " * 20_000) + items[4][1] + " pad" * 20_000), (1, rows[1][1]), (103, "昨日、今日は悪い天気です。"), (104, "Omega")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, distance int")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect())
    want = []
    for i, t in rows:
        words = decontaminate.normalise(t).split()
        for k, item in items:
            p = decontaminate.normalise(item).split()
            if p and t:
                d, _ = decontaminate.myers(p, words)
                if d <= int(0.2 * len(p)):
                    want.append((i, k, d))
    assert got == sorted(want) and (102, 4, 0) in got and (103, 8, 1) in got and (104, 9, 0) in got
    left = sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs(spark, [*rows, (None, "calm"), (None, items[4][1])]), bench).collect() if r["doc_id"] is not None)
    assert left == sorted(i for i, _ in rows if i not in {w[0] for w in want})
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, active, out = 1.5 * sum(sizes.values()), set(names), {}
    while active:
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        over = {s for s in active if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        active -= over
    return out


def test_mixing(spark):
    rnd = random.Random(17)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 7, 300, 900])), rnd.choice(["b", "a", "hot", "hot", "hot", None, "é", "tiny"] if i else ["tiny"])) for i in range(200)]
    rows += [(900, None, "a"), (901, "", "empty"), (7, rows[7][1], rows[7][2]), (None, "x y z", "a"), (902, "w " * 40_000, "hot")]
    df = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, source string, size int, rank string")
    documents, manifest = mixing.mix(df, block=64, shard_slots=16)
    got = mixing.taken(documents, manifest).collect()
    again = mixing.taken(*mixing.mix(df.repartition(7), block=64, shard_slots=16)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, took = brute_targets(sizes), {}
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
    assert all(abs(took[s] - want[s]) <= 1 for s in want)
    slots = manifest.groupBy("shard", "slot").agg(F.sum("n_words").alias("n"), F.countDistinct(F.coalesce("source", F.lit("")), "block_index").alias("k")).collect()
    assert all(s["n"] <= 64 and s["k"] == 1 for s in slots)
    assert mixing.mix(df.limit(0))[1].count() == 0


def test_shard_counts_are_drawn(spark):
    """Slots of a source in a shard have the mean and the variance of the hypergeometric distribution; every place is filled once, in several tasks."""
    sizes = spark.createDataFrame([("a", 500_000), ("b", 300_000), ("c", 90_000), ("d", 70)], "source string, source_size long")
    plan = mixing.targets(sizes)
    got = mixing.slots(plan, block=64, shard_slots=100)
    assert got.rdd.getNumPartitions() > 1
    rows = got.collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) == len({(r["rank"], r["epoch"], r["block_index"]) for r in rows})
    per = mixing.places(plan, 64).collect()
    n, total = {r["rank"]: r["n"] for r in per}, sum(r["n"] for r in per)
    shards = total // 100  # whole ones
    for rank in (0, 1, 2):
        counts = np.bincount([r["shard"] for r in rows if r["rank"] == rank and r["shard"] < shards], minlength=shards)
        p = n[rank] / total
        assert abs(counts.mean() - 100 * p) < 0.2
        assert 0.7 < counts.var() / (100 * p * (1 - p) * (total - 100) / (total - 1)) < 1.4
    for r in per:
        tokens = sum(x["tokens"] for x in rows if x["rank"] == r["rank"])
        assert tokens == r["wanted"]


def test_mixing_many_sources_and_copies_without_id(spark):
    rows = [(None, "w " * 50, "hot")] * 300 + [(i, "w " * (i % 40), f"s{i:04}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(*mixing.mix(df, block=16, shard_slots=64)).collect()
    took, want = {}, {}
    for r in got:
        took[r["source"]], want[r["source"]] = took.get(r["source"], 0) + r["taken"], r["target"]
    assert len(got) == 1000 and all(abs(took[s] - want[s]) <= 1 for s in want)
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        p = mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"))
        r = spark.range(n).select("id", p.alias("p")).withColumn("back", mixing.permute_inverse(F.col("p"), F.lit(n).cast("long"), F.lit(3).cast("long"))).collect()
        assert sorted(x["p"] for x in r) == list(range(n)) and all(x["back"] == x["id"] for x in r)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=9), min_size=1, max_size=14), st.integers(0, 2**32))
def test_link(sets, seed):
    rnd = random.Random(seed)
    pivot = np.array([rnd.random() < 0.6 for _ in sets])
    known = np.array([rnd.randrange(len(sets)) if rnd.random() < 0.3 else 100 + i for i in range(len(sets))])
    got = near_copies.link([np.array(sorted(s), dtype=np.int64) for s in sets], known, pivot, 0.6)
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if known[i] == known[j] or ((pivot[i] or pivot[j]) and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) and (sets[i] or sets[j]))]
    want = union_find(range(len(sets)), pairs)
    assert [[got[i] == got[j] for j in range(len(sets))] for i in range(len(sets))] == [[want[i] == want[j] for j in range(len(sets))] for i in range(len(sets))]


def test_large_groups_of_near_copies(spark, monkeypatch):
    """A hot key and a component of many blocks: copies of one text that are like it, but mostly not like each other, chains and loners."""
    rnd = random.Random(23)
    for name, small in (("HOT_KEY", 16), ("BLOCK_SETS", 16), ("PIVOTS", 2)):
        monkeypatch.setattr(near_copies, name, small)
    base = [f"w{rnd.randrange(9000)}" for _ in range(300)]
    texts = []
    for k in range(150):
        copy = list(base)
        for at in rnd.sample(range(300), 5 if k < 100 else 8):
            copy[at] = f"x{rnd.randrange(10**6)}"
        texts.append(copy)
    texts.append(base)
    chain = list(base)
    for _ in range(25):
        for at in rnd.sample(range(300), 3):
            chain[at] = f"y{rnd.randrange(10**6)}"
        texts.append(list(chain))
    rnd.shuffle(texts)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    want = union_find(range(len(texts)), [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.similar_documents(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), 5, 18, 0.8).collect()}
    assert 1 < len(set(want.values())) < 60
    assert got == want


def test_near_copies_of_similarity_080_go(spark):
    """Against all pairs by their shingle sets; 3 bits, the budget before, reach hardly any of these."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        base = words(rng.randrange(100, 400))
        texts.append(base)
        for changes in (1, 2, 4, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "changed" + str(rng.randrange(10**6))
            texts.append(copy)
    texts += [words(100) for _ in range(40)] + [[], ["one"], ["one"]]
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set() for t in texts]
    root = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = sorted((root[i], root[j]))
        root = [a if x == b else x for x in root]
    df = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in cp.near_dedup(spark, df, "").collect()}
    assert len(pairs) > 100
    assert set(root) <= kept  # nothing goes that isn't similar enough
    assert len(kept) <= 1.02 * len(set(root))
    assert len(kept - set(root)) <= 0.02 * len(set(root))
