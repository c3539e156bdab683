"""SimHash near-duplicates, linked by a self-join of binary tries.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Documents whose
fingerprints differ in at most `max_bits` bits are linked.

The self-join walks pairs of nodes of one binary trie at once: it starts with (root, root), goes down to pairs of
children, adds one where their bits differ and prunes a pair as soon as the sum exceeds the budget. To share that
walk among tasks, the fingerprint's bits are cut into max_bits + 1 blocks; of two linked fingerprints at least one
block is equal, so for each block there is a trie whose top levels are that block, below which only the diagonal
of node pairs (no differing bit yet) can matter. The rest is cut once more in the same way. A task therefore holds the subtrees
below (block, bits, sub-block, bits) keys, each fingerprint being in (max_bits + 1) ** 2 of them, and walks every
subtree with itself. Every linked pair meets in at least one subtree: nothing is lost, and nothing is capped.

Equal fingerprints are one trie leaf: groups of copies, however large, cost one row, as they are pre-aggregated.
A task hands on stars (node, smallest node it is linked with there) in place of all pairs, which leaves the components the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, if_small

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BITS = 64
LEAF_PAIRS = 4096  # subtree pairs of up to so many leaf pairs are compared at once
FLUSH_PAIRS = 500_000

BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle, repeats kept; none where there is no word. Fewer words than a shingle: the whole sequence is one."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    n = len(words)
    if not n:
        return np.array([], dtype=np.uint64)
    joined = b" ".join(words)
    if n <= shingle_words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    last = shingle_words - 1
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[: n - last].tolist(), ends[last:].tolist(), strict=True)), np.uint64, n - last)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 where it has no word. Fewer words than a shingle: the whole sequence is one."""
    return _majority(shingle_hashes(text, shingle_words, seed))


def _majority(hashes: np.ndarray) -> int:
    planes = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):  # little-endian: byte k holds bits 8k..8k+7
        counts = np.bincount(planes[:, k], minlength=256) @ BYTE_BITS
        for bit in np.nonzero(counts * 2 > len(hashes))[0].tolist():
            out |= 1 << (8 * k + bit)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle_words, seed) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def trie_pairs(fps: np.ndarray, max_bits: int, leaf_pairs: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of places in the sorted, distinct uint64 array fps whose values differ in at most max_bits bits, each once, in blocks.

    A trie node is a range of the array: the values that share a prefix. The stack holds pairs of nodes of one depth
    and the number of bits in which their prefixes differ.
    """
    leaf_pairs = LEAF_PAIRS if leaf_pairs is None else leaf_pairs
    stack = [(0, len(fps), 0, len(fps), BITS - 1, 0)]
    while stack:
        a0, a1, b0, b1, bit, differ = stack.pop()
        same = a0 == b0 and a1 == b1
        if a0 >= a1 or b0 >= b1 or (same and a1 - a0 < 2):
            continue
        if bit < 0 or (a1 - a0) * (b1 - b0) <= leaf_pairs:
            i, j = np.nonzero(np.bitwise_count(fps[a0:a1, None] ^ fps[None, b0:b1]) <= max_bits)
            i, j = i + a0, j + b0
            keep = i < j
            if keep.any():
                yield i[keep], j[keep]
            continue
        am, bm = _split(fps, a0, a1, bit), _split(fps, b0, b1, bit)
        stack.append((a0, am, b0, bm, bit - 1, differ))
        stack.append((am, a1, bm, b1, bit - 1, differ))
        if differ < max_bits:
            stack.append((a0, am, bm, b1, bit - 1, differ + 1))
            if not same:
                stack.append((am, a1, b0, bm, bit - 1, differ + 1))


def _split(fps: np.ndarray, lo: int, hi: int, bit: int) -> int:
    """Where, in the node lo..hi, the child with this bit set begins."""
    if not hi - lo:
        return lo
    border = (int(fps[lo]) >> (bit + 1) << (bit + 1)) | (1 << bit)
    return lo + int(np.searchsorted(fps[lo:hi], np.uint64(border)))


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """For each pair (block, sub-block) the mask of its bits, and its number."""
    def cuts(places: list[int]) -> list[list[int]]:
        parts = np.array_split(np.array(places), max_bits + 1)
        return [p.tolist() for p in parts]

    out = []
    for block in cuts(list(range(BITS))):
        rest = [b for b in range(BITS) if b not in set(block)]
        for sub in cuts(rest):
            out.append((len(out), sum(1 << b for b in block + sub)))
    return out


def links(reps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """reps: distinct fingerprints (rep long, fp long). Edges (a, b) of stars that connect what max_bits connects."""
    masks = [(n, mask - (1 << BITS) if mask >> (BITS - 1) else mask) for n, mask in blocks(max_bits)]
    keyed = reps.select("rep", "fp", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for n, m in masks])).alias("k")).select("rep", "fp", "k.n", "k.key")
    dealt = keyed.repartition("n", "key").sortWithinPartitions("n", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal held
            ids, root = roots_of(found)
            found.clear()
            held = 0
            keep = ids != root
            return pd.DataFrame({"a": ids[keep], "b": root[keep]})

        tail: pd.DataFrame | None = None
        for pdf in _with_end(batches):
            if pdf is not None:
                tail = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
                n, key = tail["n"].to_numpy(), tail["key"].to_numpy()
                starts = np.concatenate([[0], np.nonzero((n[1:] != n[:-1]) | (key[1:] != key[:-1]))[0] + 1])
                whole, tail = tail.iloc[: starts[-1]], tail.iloc[starts[-1] :]  # the last key may go on
                starts = starts[:-1]
            else:
                if tail is None:
                    break
                whole, starts = tail, np.array([0])
            if not len(whole):
                continue
            fp, rep = whole["fp"].to_numpy().view(np.uint64), whole["rep"].to_numpy()
            ends = np.concatenate([starts[1:], [len(whole)]])
            for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                order = np.argsort(fp[lo:hi])
                own, ids = fp[lo:hi][order], rep[lo:hi][order]
                for i, j in trie_pairs(own, max_bits):
                    found.append((ids[i], ids[j]))
                    held += len(i)
                    if held >= FLUSH_PAIRS:
                        yield flush()
        if found:
            yield flush()

    return dealt.mapInPandas(run, "a long, b long")


def roots_of(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    from tessera.llm.local_graph import roots

    return roots(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from (b for b in batches if len(b))
    yield None


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id (smallest doc_id reachable by links, itself included).

    docs: needs doc_id and text; other columns are ignored. A null or empty text, or one of white space only, has the
    fingerprint 0 and is linked like any other. Repeated rows are copies of each other and come back as often as they
    came in. A null doc_id is never a component's id, unless all of its equals are null. An empty table gives no row.
    """
    fps = cut(fingerprints(docs, shingle_words, seed))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comps = components(links(reps.where("rep is not null"), max_bits))
    named = reps.join(comps, reps["rep"] == comps["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED, min_similarity: float | None = None) -> DataFrame:
    """One document of each group: the one whose doc_id names it; columns as they are.

    A document is a doc_id with a text: of two texts under one doc_id each is judged by itself, and stays unless it's like a kept one. Repeated
    rows of one document are copies, of which one stays. With min_similarity, groups are those of near_copies.similar_documents. Rows without doc_id can't
    name a group and stay; a null text is an empty one. The documents that go are joined, never gathered.
    """
    doc, version = "__dedup_doc", "__dedup_version"
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), version: F.xxhash64(F.coalesce("text", F.lit("")))})
    met = cut(keyed.where(F.col(doc).isNotNull()).groupBy(doc, version).agg(F.count("*").alias("rows")))
    # a document's number is its doc_id; of several texts of one doc_id the other ones get a hash of both
    several = cut(met.groupBy(doc).agg(F.min(version).alias("least"), F.max(version).alias("most")).where("least <> most").select(doc, "least"))
    number = F.when(F.col("least").isNull() | (F.col("least") == F.col(version)), F.col(doc)).otherwise(F.xxhash64(doc, version))
    named = keyed.where(F.col(doc).isNotNull()).select(doc, version, "text").join(if_small(several), doc, "left").select(number.alias("doc_id"), "text")
    from tessera.llm.near_copies import similar_documents

    found = near_duplicates(named, shingle_words, max_bits, seed) if min_similarity is None else similar_documents(named, shingle_words, max_bits, min_similarity, seed)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("number")).distinct()
    odd = cut(met.join(several, doc, "left").withColumn("number", number).join(gone.withColumn("gone", F.lit(True)), "number", "left").where("gone or rows > 1").select(doc, version, F.coalesce("gone", F.lit(False)).alias("gone")))
    alone = keyed.join(if_small(odd), [doc, version], "left_anti")  # rows without doc_id too
    repeated = keyed.join(if_small(cut(odd.where("not gone"))), [doc, version], "left_semi").dropDuplicates([doc, version])
    return alone.unionByName(repeated).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
