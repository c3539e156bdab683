"""Embedding near-duplicates by product quantisation over inverted lists.

Fit (driver, numpy, a sample): k-means centroids of unit vectors are the coarse lists, and the residuals of the
sample (vector minus centroid) train one small codebook for each subspace. Every vector, in the sample or not, is indexed. The number of lists
grows with the square root of the number of vectors, and the sample with the lists.

Search: a vector probes the lists that can hold a partner. For two vectors at most r apart, with u in the cell of
centroid c and v in that of c', the distances of u and v to the plane halfway between c and c' add up to r at most, so that one of them is
r / 2 or less. The probes of a vector are the lists for which that holds; they suffice, as of each linked pair at least one probes the
other's list. Within a list the distance of a query to a member's code is summed from a table of the query's distances to the codewords (asymmetric),
and differs from the true distance by the member's stored quantisation error at most: members beyond r plus that error are dropped, the rest
gets its exact cosine in double precision. These bounds are exact; recall is 1 up to rounding, whatever the quantiser has learned.

That takes place twice. First with vectors rounded to bytes, whose rounding error is known and widens r: it finds which vectors can have
a partner at all. The others then aren't sent anywhere as a whole. A pair that is met in two lists counts in one of them.

Equal vectors are one vector before that. Lists are dealt out in pairs of blocks, so that a task never holds more
than two blocks, however large a list is. A task returns the number of links of each vector and stars in place of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tessera.llm.common import components, cut, if_small
from tessera.llm.local_graph import roots

MIN_COSINE = 0.98
SAMPLE = 32_768  # vectors of one dimension that the quantiser is fitted on; SAMPLE_PER_LIST times the lists where that is more
SAMPLE_PER_LIST = 16
LISTS_PER_ROOT = 0.25  # lists, by the square root of the number of vectors
SUBSPACES = 8
CODES = 64
BLOCK = 4_096
SLACK = 1e-6  # of distances, for rounding
PAIRS_AT_ONCE = 65_536
TABLE_CELLS = 2_000_000  # of distances that are held at once


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Quantiser:
    """Coarse centroids and, for each subspace of a residual, its codewords."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.lists, self.gaps = _kmeans(sample, lists), None
        rest = sample - self.lists[_nearest(sample, self.lists)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, p], CODES) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: own list, codes, distance between the vector and what list and codes stand for."""
        own = _nearest(x, self.lists)
        rest = x - self.lists[own]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        off = sum(((rest[:, p] - b[codes[:, j]]) ** 2).sum(1) for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)))
        return own, codes, np.sqrt(off)

    def probes(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each unit vector its own list and those in whose cell lies something within reach that doesn't probe this one's."""
        if self.gaps is None:
            self.gaps = np.sqrt(_squares(self.lists, self.lists))
        gaps, out = self.gaps, []
        step = max(1, 2 * TABLE_CELLS // len(self.lists))
        for i in range(0, len(x), step):
            d = _squares(x[i : i + step], self.lists)
            own = d.argmin(1)
            away = d - d[np.arange(len(d)), own][:, None]
            out += [np.nonzero(row)[0] for row in away <= gaps[own] * reach + SLACK]
        return out

    def bounds(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances between queries and the members of a list, by table look-up."""
        rest = queries - self.lists[which]
        total = np.zeros((len(queries), len(codes)))
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            total += _squares(rest[:, p], b)[:, codes[:, j]]
        return np.sqrt(total)


def valid(col) -> F.Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(col.isNotNull() & (F.size(col) > 0) & F.forall(col, finite) & F.exists(col, lambda x: x != 0), F.lit(False))


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as bytes (127 stands for the largest component's size), and how far each is from what its bytes stand for."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    small = np.rint(x / scale).astype(np.int8)
    off = np.linalg.norm(x - small * scale, axis=1)
    return np.concatenate([scale.astype("<f8").view(np.uint8), small.view(np.uint8)], axis=1), off


def _unrounded(rows: np.ndarray) -> np.ndarray:
    raw = np.stack([np.frombuffer(r, np.uint8) for r in rows])
    return raw[:, 8:].copy().view(np.int8) * raw[:, :8].copy().view("<f8")


def fit(vectors: DataFrame) -> dict[int, Quantiser]:
    """One quantiser for each dimension. vectors: distinct, valid (rep, dim, embedding). Driver: the sample of a dimension at a time."""
    out = {}
    for dim, n in [(r["dim"], r["count"]) for r in vectors.groupBy("dim").count().orderBy("dim").toLocalIterator()]:
        lists = max(4, int(LISTS_PER_ROOT * n**0.5))
        share = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(max(SAMPLE, SAMPLE_PER_LIST * lists)).select("embedding").toPandas()
        out[dim] = Quantiser(_unit(share["embedding"]), lists)
    return out


ITEM = ["rep", "copies", "home", "probes", "codes", "off"]


def _dealt(indexed: DataFrame, vector: str) -> DataFrame:
    """Rows label, dim, list, p, q, b (own block), ITEM and x: every vector in each list that it probes, for each pair (p, q) of the list's blocks that
    its own is one of."""
    key = ["label", "dim", "list"]
    items = indexed.select("label", "dim", *ITEM, F.col(vector).alias("x"), F.explode("probes").alias("list"))
    sizes = indexed.select("label", "dim", F.explode("probes").alias("list")).groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).where("n > 1")
    n = F.coalesce("n", F.lit(1))
    placed = items.join(sizes, key, "left").withColumn("b", F.pmod(F.xxhash64("rep"), n).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = placed.select(*key, F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", *ITEM, "x")
    return rows.repartition(*key, "p", "q")


class _Found:
    """Links among the items of a group, kept as counts and stars."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray) -> None:
        self.ids, self.copies, self.links = ids, copies, np.zeros(len(ids), dtype=np.int64)
        self.a, self.b, self.held = [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.links += np.bincount(i, weights=self.copies[j], minlength=len(self.ids)).astype(np.int64) + np.bincount(j, weights=self.copies[i], minlength=len(self.ids)).astype(np.int64)
        self.a.append(i)
        self.b.append(j)
        self.held += len(i)
        if self.held > 16 * PAIRS_AT_ONCE:
            self.fold()

    def fold(self) -> None:
        a, b = roots(np.concatenate(self.a), np.concatenate(self.b)) if self.a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.a, self.b, self.held = [a], [b], len(a)

    def rows(self) -> pd.DataFrame:
        """id, links, root (the smallest id tied to it) of the items with a link."""
        self.fold()
        met, at = self.a[0], self.b[0]
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, at, self.ids[met])
        return pd.DataFrame({"id": self.ids[met], "links": self.links[met], "root": least[at]})


def _pairs(model: Quantiser, which: int, pdf: pd.DataFrame, x: np.ndarray, wider: np.ndarray, reach: float, near) -> _Found:
    """Links of a group: near(i, j) says which pairs of items are linked; wider: how far each x is from the vector it stands for."""
    ids, home, block = pdf["rep"].to_numpy(), pdf["home"].to_numpy(), pdf["b"].to_numpy()
    found, member = _Found(ids, pdf["copies"].to_numpy()), home == which
    codes, off = np.stack([np.frombuffer(c, np.uint8) for c in pdf["codes"]]), pdf["off"].to_numpy()
    # whether a member probes the home of another item: then the pair is met there too, and counts where the smaller id is the guest
    homes, col = np.unique(home, return_inverse=True)
    mutual = np.zeros((len(ids), len(homes)), dtype=bool)
    for k in np.nonzero(member)[0].tolist():
        mutual[k] = np.isin(homes, pdf["probes"].iloc[k])
    own = np.nonzero(member)[0]
    for s in range(0, len(own), BLOCK):
        left = own[s : s + BLOCK]
        step = max(1, TABLE_CELLS // max(1, len(left)))
        for t in range(0, len(ids), step):
            right = np.arange(t, min(t + step, len(ids)))
            j, i = np.nonzero(model.bounds(x[right], which, codes[left]) <= reach + off[left][None] + wider[right][:, None] + SLACK)
            i, j = left[i], right[j]
            once = np.where(member[j], i < j, ~mutual[i, col[j]] | (ids[j] < ids[i]))
            both = once & ((block[i] != block[j]) | pdf["same"].iloc[0])
            i, j = i[both], j[both]
            for u in range(0, len(i), PAIRS_AT_ONCE):
                a, b = i[u : u + PAIRS_AT_ONCE], j[u : u + PAIRS_AT_ONCE]
                ok = near(a, b)
                if ok.any():
                    found.add(a[ok], b[ok])
    return found


def search(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """vectors: distinct, valid (rep, label, dim, embedding, copies). Rows (id, links, root): links found in one pair of blocks,
    copies counted, and the smallest id tied to id there."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    models = vectors.sparkSession.sparkContext.broadcast(fit(vectors))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                model, x = models.value[dim], _unit(own["embedding"])
                which, codes, off = model.encode(x)
                small, lost = _rounded(x)
                probes = [p.astype(np.int32) for p in model.probes(x, reach + SLACK)]
                yield pd.DataFrame({"rep": own["rep"].to_numpy(), "label": own["label"].to_numpy(), "dim": dim, "copies": own["copies"].to_numpy(), "embedding": own["embedding"].to_numpy(), "home": which, "probes": probes, "codes": [c.tobytes() for c in codes], "off": off, "small": [v.tobytes() for v in small], "lost": lost})

    kind = vectors.schema["embedding"].dataType.simpleString()
    indexed = cut(vectors.mapInPandas(index, f"rep long, label string, dim int, copies long, embedding {kind}, home int, probes array<int>, codes binary, off double, small binary, lost double"))

    def can_have_partners(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model, x = models.value[int(group[1])], _unrounded(pdf["x"])
        wider = pdf["lost"].to_numpy()
        found = _pairs(model, int(group[2]), pdf.assign(same=group[3] == group[4]), x, wider, reach, lambda a, b: ((x[a] - x[b]) ** 2).sum(1) <= (reach + wider[a] + wider[b] + SLACK) ** 2)
        return pd.DataFrame({"rep": found.rows()["id"]})

    def compare(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf["x"])
        return _pairs(models.value[int(group[1])], int(group[2]), pdf.assign(same=group[3] == group[4]), x, np.zeros(len(x)), reach, lambda a, b: np.einsum("ij,ij->i", x[a], x[b]) >= min_cosine).rows()

    key = ["label", "dim", "list", "p", "q"]
    first = _dealt(indexed.withColumn("small", F.struct("small", "lost")), "small").select(*key, "b", *ITEM, F.col("x.small").alias("x"), F.col("x.lost").alias("lost"))
    active = cut(first.groupBy(*key).applyInPandas(can_have_partners, "rep long").distinct())
    return _dealt(indexed.join(if_small(active), "rep", "left_semi"), "embedding").groupBy(*key).applyInPandas(compare, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding and label; other columns are ignored. Only vectors of one non-null label and one length are
    compared. A null, empty or zero vector, or one with a null or non-finite component, links with nothing, nor does one
    without label or vec_id. Equal vectors link with each other. Repeated rows of one vec_id with one vector are one vector, and
    come back as often as they came in. An empty table gives no row. Equal vectors are told by two 64-bit hashes of label and vector.
    """
    kind = vectors.schema["embedding"].dataType
    exact = kind if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType) else ArrayType(DoubleType())
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(exact).alias("embedding"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    same = ["h1", "h2"]
    rows = rows.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding", "label"))
    good = rows.where("ok")
    kinds = cut(good.select("vec_id", *same).distinct().groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    # the row that stands for its equals: its vec_id and its hashes name it; repeated rows of it are one
    own = good.join(kinds, [*same], "inner").where(F.col("vec_id") == F.col("rep")).select("rep", "label", F.size("embedding").alias("dim"), "embedding", "copies", *same)
    distinct = cut(own.dropDuplicates(["rep", *same]).drop(*same))
    found = cut(search(distinct, min_cosine))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_rep = links.join(comps, "id", "left").select(F.col("id").alias("rep"), "links", F.coalesce("component", "id").alias("component"))
    named = kinds.join(of_rep, "rep", "left").select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    ok = good.select("vec_id", *same).join(named, same).select("vec_id", "n_links", "component_id")
    bad = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ok.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id::BIGINT AS component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
