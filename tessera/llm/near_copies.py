"""Near copies of texts: SimHash tries below min-hash keys, with the similarity verified exactly.

Texts of shingle similarity 0.8 differ in about 10 of the 64 bits of their fingerprints, and a budget that wide prunes a trie of all
fingerprints little. So the trie is cut up by something sharper than its top levels: a text has BANDS keys, each made of KEY_HASHES
min-hashes of its shingles, and the walk over pairs of nodes takes place among the texts that share a key. Two texts of
similarity 0.8 share one with a probability of 0.998; what is compared grows with the texts and not with their square. Hot keys are dealt
out as pairs of blocks of HOT_KEY fingerprints. A walk hands on stars and not pairs, whose components are the candidates.

Within a candidate component the Jaccard similarity of the shingle sets decides. One task takes a component of up to BLOCK_SETS sets (and
BLOCK_SHINGLES shingles): a set is compared with all that aren't linked to it yet, then the sets that it was linked with, and so on, so that a group
around a common original takes a few comparisons for each set. Larger components are cut in blocks. Each block first meets a few pivots, the sets
nearest to the component's majority fingerprint; what these don't link to the component's main part is then compared, in blocks, with everything in
it. So every pair of a component that isn't linked already is compared, and no row stands for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, if_small
from tessera.llm.local_graph import roots
from tessera.llm.simhash import SEED, _majority, shingle_hashes, trie_pairs

BANDS = 12
KEY_HASHES = 4
HOT_KEY = 4_096
BLOCK_SETS = 4_096
BLOCK_SHINGLES = 2_000_000
PIVOTS = 8
PIVOT_ROUNDS = 4
LEAF_PAIRS = 65_536

_rng = np.random.default_rng(97)
_MIX, _TURN = _rng.integers(0, 2**63, BANDS * KEY_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 2**63, BANDS * KEY_HASHES, dtype=np.uint64)


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The keys (signed longs) of a text's distinct shingle hashes; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_MIX), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _TURN) * _MIX).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, KEY_HASHES).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _read(docs: DataFrame, shingle_words: int, seed: int) -> DataFrame:
    """doc_id, fp, size (distinct shingles), keys of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes = [shingle_hashes(t, shingle_words, seed) for t in pdf["text"]]
            own = [np.unique(h) for h in hashes]
            fp = np.array([_majority(h) for h in hashes], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp, "size": [len(h) for h in own], "keys": [keys_of(h) for h in own]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long, size long, keys array<long>")


def _blocked(rows: DataFrame, n: str) -> DataFrame:
    """rows, each as often as there are pairs (p, q) of the n blocks of its group with its own block among them."""
    own = F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("own", "other")


def candidates(nodes: DataFrame, max_bits: int, min_similarity: float) -> DataFrame:
    """nodes: fp (distinct), size, keys. Stars (a, b) of fingerprints that share a key, differ in max_bits bits at most and whose sizes allow the similarity."""
    keyed = nodes.select("fp", "size", F.explode("keys").alias("key"))
    hot = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).select("key", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("n")))
    dealt = _blocked(keyed.join(hot, "key", "left").withColumn("n", F.coalesce("n", F.lit(1))), "n").select("key", "p", "q", "fp", "size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in groups(batches, ["key", "p", "q"]):
            if len(group["fp"]) < 2:
                continue
            fp = group["fp"].view(np.uint64)
            order = np.argsort(fp)
            fp, size = fp[order], group["size"][order]
            found = []
            for i, j in trie_pairs(fp, max_bits, leaf_pairs=LEAF_PAIRS):
                near = np.minimum(size[i], size[j]) >= min_similarity * np.maximum(size[i], size[j])
                if near.any():
                    found.append(roots(i[near], j[near]))
            if found:
                a, b = roots(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
                keep = a != b
                yield pd.DataFrame({"a": fp[a[keep]].view(np.int64), "b": fp[b[keep]].view(np.int64)})

    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInPandas(run, "a long, b long").distinct()


def groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """The groups of rows that come sorted by these columns, whichever batches they are in: key, and columns as arrays."""
    key, held = None, []

    def whole() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for pdf in batches:
        if not len(pdf):
            continue
        own, rest = np.stack([pdf[c].to_numpy() for c in by], axis=1), {c: pdf[c].to_numpy() for c in pdf.columns if c not in by}
        starts = [0, *(np.nonzero((own[1:] != own[:-1]).any(axis=1))[0] + 1).tolist(), len(own)]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(own[lo].tolist())
            if held and now != key:
                yield key, whole()
                held = []
            key = now
            held.append({c: v[lo:hi] for c, v in rest.items()})
    if held:
        yield key, whole()


def link(sets: list[np.ndarray], label: np.ndarray, pivot: np.ndarray, min_similarity: float) -> np.ndarray:
    """Components of sets, given those that they are known to be in (label): all pairs with a pivot in them count whose sets have this Jaccard
    similarity. Returns the new labels."""
    label, open_ = np.unique(label, return_inverse=True)[1], pivot.copy()
    sizes = np.array([len(s) for s in sets])
    live = np.arange(len(sets))  # those that a pivot may still have to be compared with
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=np.int32)
    flat, at = codes, starts[:-1]
    queue: list[int] = []
    while open_.any():
        wanted = open_ | ~pivot  # a set that was the pivot has been compared with all of these
        if len(np.unique(label[wanted])) == 1:
            break
        x = None
        while queue and x is None:
            k = queue.pop()
            x = k if open_[k] else None
        if x is None:
            rare = np.bincount(label[wanted], minlength=len(sets))[label]
            x = int(np.argmin(np.where(open_, rare, len(sets) + 1)))  # of the smallest part, which settles most
        open_[x] = False
        mine = codes[starts[x] : starts[x + 1]]
        mark[mine] = 1
        run = np.concatenate([[0], np.cumsum(mark[flat])])
        shared = run[at + sizes[live]] - run[at]
        mark[mine] = 0
        near = (shared >= min_similarity * (sizes[live] + sizes[x] - shared)) & (shared > 0) & (label[live] != label[x])
        for y in live[near].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
        queue += [y for y in live[near][np.argsort(shared[near], kind="stable")].tolist() if open_[y]]
        if wanted[live].sum() < 0.7 * len(live):
            live = live[wanted[live]]
            flat = np.concatenate([codes[starts[k] : starts[k + 1]] for k in live.tolist()]) if len(live) else codes[:0]
            at = np.concatenate([[0], np.cumsum(sizes[live])[:-1]])[: len(live)]
    return label


def links(rows: DataFrame, min_similarity: float) -> DataFrame:
    """rows: comp, p, q, fp, label, pivot, own (shingles). Stars (a, b) of what link() ties together in each group (comp, p, q)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in groups(batches, ["comp", "p", "q"]):
            fp, first = np.unique(group["fp"], return_index=True)
            pivot = np.isin(fp, group["fp"][group["pivot"]])
            if len(fp) < 2 or not pivot.any():
                continue
            label = link([np.asarray(group["own"][k]) for k in first.tolist()], group["label"][first], pivot, min_similarity)
            _, least = np.unique(label, return_index=True)
            b = fp[least][np.unique(label, return_inverse=True)[1]]
            keep = fp != b
            yield pd.DataFrame({"a": fp[keep], "b": b[keep]})

    return rows.select("comp", "p", "q", "fp", "label", "pivot", "own").repartition("comp", "p", "q").sortWithinPartitions("comp", "p", "q").mapInPandas(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, shingle_words: int, seed: int) -> DataFrame:
    """wanted (fp, rep, comp) with own: the distinct shingle hashes of the text of fp."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes = [shingle_hashes(t, shingle_words, seed) for t in pdf["text"]]
            keep = np.array([_majority(h) for h in hashes], dtype=np.uint64).view(np.int64) == pdf["fp"].to_numpy()
            yield pd.DataFrame({"fp": pdf["fp"][keep], "comp": pdf["comp"][keep], "own": [np.unique(h).view(np.int64) for h, k in zip(hashes, keep, strict=True) if k]})

    return texts.mapInPandas(run, "fp long, comp long, own array<long>").dropDuplicates(["fp"])


def _labels(edges: DataFrame) -> DataFrame:
    return cut(components(edges).select(F.col("id").alias("fp"), F.col("component").alias("label")))


def _pivots(left: DataFrame) -> DataFrame:
    """left: comp, n, block, fp. comp, n, fp of the PIVOTS fingerprints of a component nearest to its majority, at most one of a block."""
    set_bits = [F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{k}") for k in range(64)]
    bits = [F.when(F.col(f"b{k}") * 2 > F.col("rows"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(64)]
    most = bits[0]
    for b in bits[1:]:
        most = most.bitwiseOR(b)
    major = cut(left.groupBy("comp").agg(F.count("*").alias("rows"), *set_bits).select("comp", most.alias("major")))
    near = left.join(major, "comp").groupBy("comp", "n", "block").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("major"))).alias("bits"), "fp")).alias("m"))
    return near.groupBy("comp", "n").agg(F.slice(F.array_sort(F.collect_list("m")), 1, PIVOTS).alias("ms")).select("comp", "n", F.explode("ms.fp").alias("fp"))


def verified(docs: DataFrame, nodes: DataFrame, stars: DataFrame, shingle_words: int, min_similarity: float, seed: int) -> DataFrame:
    """Stars (a, b) of the fingerprints in one candidate component whose sets are similar enough, directly or through others."""
    comps = cut(components(stars).select(F.col("id").alias("fp"), F.col("component").alias("comp")).join(nodes.select("fp", "rep", "size"), "fp"))
    n = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    large = cut(comps.groupBy("comp").agg(n.alias("n")).where("n > 1"))
    sets = cut(_sets(docs, if_small(comps.select("fp", "rep", "comp")), shingle_words, seed))
    alone = sets.join(large, "comp", "left_anti").select("comp", F.lit(0).alias("p"), F.lit(0).alias("q"), "fp", F.col("fp").alias("label"), F.lit(True).alias("pivot"), "own")
    found = cut(links(alone, min_similarity))
    if not large.limit(1).count():
        return found
    items = cut(comps.join(large, "comp").select("comp", "n", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("block"), "fp", F.col("fp").alias("label")))
    edges = None
    for _ in range(PIVOT_ROUNDS):
        left = _beside_main(items)
        pivots = _pivots(left.drop("label"))
        rows = items.select("comp", "n", "block", "fp", "label", F.lit(False).alias("pivot")).unionByName(
            pivots.join(items.select("fp", "label"), "fp").select("comp", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), "fp", "label", F.lit(True).alias("pivot"))
        )
        new = cut(links(rows.join(sets.select("fp", "own"), "fp").withColumn("p", F.lit(-1)).withColumn("q", F.col("block")), min_similarity))
        edges = new if edges is None else edges.unionByName(new)
        items = cut(items.drop("label").join(_labels(edges), "fp", "left").select("comp", "n", "block", "fp", F.coalesce("label", "fp").alias("label")))
        if not new.limit(1).count():
            break
    left = _beside_main(items)
    parts = left.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("m"))
    left = left.join(parts, "comp").withColumn("p", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("m")).cast("int"))
    rest = left.select("comp", "p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"), "fp", "label", F.lit(True).alias("pivot"))
    everything = items.join(parts, "comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("p"), F.col("block").alias("q"), "fp", "label", F.lit(False).alias("pivot"))
    last = links(rest.unionByName(everything).join(sets.select("fp", "own"), "fp"), min_similarity)
    return cut(found.unionByName(edges).unionByName(last))


def _beside_main(items: DataFrame) -> DataFrame:
    """The items that aren't in the largest known part of their component; all of it where nothing is linked yet."""
    sizes = items.groupBy("comp", "label").agg(F.count("*").alias("rows")).groupBy("comp").agg(F.max(F.struct("rows", "label")).alias("m"))
    main = sizes.where("m.rows > 1").select(F.col("comp").alias("main_comp"), F.col("m.label").alias("main"))
    return cut(items.join(main, (items["comp"] == main["main_comp"]) & (items["label"] == main["main"]), "left_anti"))


def similar_documents(docs: DataFrame, shingle_words: int, max_bits: int, min_similarity: float, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, fp and component_id, as simhash.near_duplicates has them, of documents whose shingle sets have at least
    this Jaccard similarity. Equal fingerprints are linked as they are; pairs that share none of the keys, or whose fingerprints and those of their
    kin differ in more than max_bits bits, aren't found.

    docs: needs doc_id and text, other columns are ignored. Null, empty and blank texts are copies of each other. Repeated rows come back as often as
    they came in; rows without doc_id aren't compared and have no component. Texts are read whole. An empty table gives no row.
    """
    fps = cut(_read(docs, shingle_words, seed))
    nodes = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "size", "keys")).alias("m")).select("fp", F.col("m.doc_id").alias("rep"), "m.size", "m.keys"))
    stars = cut(candidates(nodes, max_bits, min_similarity))
    labels = _labels(verified(docs, nodes, stars, shingle_words, min_similarity, seed))
    named = nodes.join(labels, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return fps.join(named.select("fp", "component").join(ids, "component").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")
