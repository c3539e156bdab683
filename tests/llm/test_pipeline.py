"""The pipeline's stages: edge cases of each, and a run against brute-force versions of what each stage does with its own input."""

import random

import corpus_pipeline as cp
import pytest
from tessera.llm import decontaminate, quality
from test_corpus_operators import brute_targets, union_find

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, rank string"
VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu", "me") for b in ("na", "ro", "ti", "su", "ve") for c in ("", "n", "s", "la")]


def prose(rnd, n):
    out = []
    while n > 0:
        k = min(n, rnd.randrange(6, 13))
        out.append(" ".join(rnd.choices(VOCABULARY, k=k)).capitalize() + ".")
        n -= k
    return " ".join(out)


def corpus(rnd):
    """Rows, with nulls in any column, empty and very long texts, repeated rows, two texts under one id, exact and near copies, junk, shared lines, leaks."""
    items = [prose(rnd, k).rstrip(".") for k in (20, 35)]
    shared = prose(rnd, 60)
    rows = []
    for i in range(60):
        text = [prose(rnd, rnd.randrange(40, 120)) for _ in range(3)]
        if i % 9 == 0:
            text.insert(1, shared)
        if i % 13 == 5:
            text.insert(2, items[i % 2] + ".")
        rows.append((i, "\n".join(text)))
    rows += [(100 + i, " | ".join(rnd.choices(VOCABULARY, k=60))) for i in range(8)] + [(110 + i, "BUY!! NOW!! " * 40) for i in range(4)]
    for i in (3, 4, 6, 7):
        words = rows[i][1].split(" ")
        words[30] = "changedword"
        rows += [(200 + i, " ".join(words)), (220 + i, rows[i][1])]
    long = "\n".join(prose(rnd, 60) for _ in range(400))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, long), (8, prose(rnd, 90)), rows[10], rows[10], (None, prose(rnd, 70)), (None, rows[11][1])]
    full = [(i, t, None if k % 7 == 0 else "x", [None, "b", "a", "é"][k % 4], None if t is None else len(t), 1, 0.5, "r") for k, (i, t) in enumerate(rows)]
    return full, items


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rnd = random.Random(31)
    rows, items = corpus(rnd)
    d = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (7, None), (8, "two words")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def test_stages_take_odd_rows_and_keep_the_columns(spark, world):
    d, rows, _ = world
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        got = [(r["doc_id"], r["lang"]) for r in out.collect()]
        assert got and len(got) <= len(rows)
        assert stage(spark, docs.limit(0), d).count() == 0
    mixed = cp.source_mixing(spark, docs, d)
    assert set(docs.columns) | {"size", "source_size", "target", "taken"} == set(mixed.columns)
    assert mixed.count() > 0 and cp.source_mixing(spark, docs.limit(0), d).count() == 0


def words(line):
    return tuple(line.lower().split())


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute_lines(rows):
    """(doc_id, text) after line dedup."""
    first = {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t}):
        for no, line in enumerate(t.split("\n")):
            if len(words(line)) >= 5:
                first[words(line)] = min(first.get(words(line), (i, no, t)), (i, no, t))
    late = {a for a in first if any(first[b][:2] < first[a][:2] and max(len(a), len(b)) >= 10 and edit_one(a, b) for b in first if b != a and abs(len(a) - len(b)) <= 1)}
    out = []
    for i, t in rows:
        if i is None or not t:
            out.append((i, t))
            continue
        lines = t.split("\n")
        kept = [line for no, line in enumerate(lines) if len(words(line)) < 5 or (words(line) not in late and first[words(line)] == (i, no, t))]
        if len(kept) == len(lines) or "\n".join(kept).strip():
            out.append((i, "\n".join(kept)))
    return out


def brute_near(rows):
    """(doc_id, text) with one document of each group of similarity 0.8 or more; rows without doc_id stay."""
    named = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = []
    for _, t in named:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    pairs = [(x, y) for y in range(len(named)) for x in range(y) if sets[x] == sets[y] or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    root = union_find(range(len(named)), pairs)
    return {frozenset(named[x] for x in root if root[x] == r) for r in set(root.values())}


def test_run_against_brute_force(spark, world):
    d, _, items = world
    docs = spark.read.parquet(f"{d}/documents.parquet")
    pair = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    key = lambda rows: sorted(map(str, rows))
    # 1: just those whose whole text scores enough
    good = cp.quality_classifier(spark, docs, d)
    model = quality.fit(docs)
    assert key(pair(good)) == key([(i, t) for i, t in pair(docs) if model.score(t) >= quality.THRESHOLD])
    kept = {i for i, _ in pair(good)}
    assert not kept & {100 + i for i in range(8)} and not kept & {110 + i for i in range(4)} and not kept & {300, 301, 302}
    assert len(kept & set(range(60))) >= 58
    # 2
    good.write.parquet(f"{d}/good")
    good = spark.read.parquet(f"{d}/good")
    lines = cp.dedup_lines(spark, good, d)
    assert key(pair(lines)) == key(brute_lines(pair(good)))
    assert all(r["n_chars"] == len(r["text"]) for r in lines.where("text is not null").collect())
    # 3: on documents as they came, where there are copies
    near = pair(cp.near_dedup(spark, good, d))
    groups = brute_near(pair(good))
    stays = [(i, t or "") for i, t in near if i is not None]
    assert len(stays) == len(set(stays)) == len(groups) and all(len(g & set(stays)) == 1 for g in groups)
    assert key([x for x in near if x[0] is None]) == key([x for x in pair(good) if x[0] is None])
    # 4
    clean = pair(cp.decontamination(spark, good, d))
    patterns = [decontaminate.normalise(t).split() for t in items]
    leaks = lambda t: any(decontaminate.myers(p, decontaminate.normalise(t).split())[0] <= int(0.2 * len(p)) for p in patterns)
    assert key(clean) == key([(i, t) for i, t in pair(good) if not leaks(t)]) and len(clean) < good.count()
    # 5
    mixed = cp.source_mixing(spark, good, d).collect()
    sizes, took = {}, {}
    for r in good.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    want = brute_targets(sizes)
    for r in mixed:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 < r["taken"] <= 2 * r["size"]
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
    assert {None, 8, 10} <= {r["doc_id"] for r in mixed}
    assert all(abs(took.get(s, 0) - want[s]) <= 1 for s in want)
    # all of them in a row
    out = cp.run(spark, d).collect()
    assert out and {r["doc_id"] for r in out} <= kept
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in cp.run(spark, d).collect()}
