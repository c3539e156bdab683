"""Toxicity by multiple-instance learning: labels are on documents, scores on sentences.

In the fit a sentence's probability is a logistic function of the sum of its hashed words' weights; a document's is the noisy-or of its
sentences': 1 - product(1 - p). The weights are learned from document labels alone, by gradient descent (Adam) on the
noisy-or's likelihood, so that blame goes to the sentences that explain a label. In the fit only, the noisy-or has a leak:
one more cause, the same for all documents, that stands for labels no sentence explains, such as wrong ones.

Afterwards a sentence's score is what it holds beyond a sentence without any telling word, so that length alone makes no text toxic; a
document's score is the noisy-or of those. Offending are the sentences whose own score reaches the threshold and, where the document's does
by several lesser ones, the fewest of these that bring it there.

The fit uses a bounded sample: up to SAMPLE_PER_CLASS labelled documents of each class, chosen by a hash of doc_id, whole texts of any
length; it is weighted to the classes' shares among all labelled documents, so that the scores don't depend on how many of these there
are. Only words that tell something about the label reach the driver. Scoring covers whole texts of any length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc32_mod, cut, table

BUCKETS = 1 << 20
MIN_DOCUMENTS = 8  # of the sample that a word's bucket must stand in to get a weight; rarer words could only be learned by heart
MIN_CHI_SQUARED = 20.0  # of a word and the label, for the same reason
SAMPLE_PER_CLASS = 4_000
THRESHOLD = 0.7
EPOCHS = 30
RATE = 0.3
DECAY = 2e-5
LEAK = 0.05  # to begin with
CACHE = 200_000

#: A word, or where a sentence ends: after a stop or at a line's end.
PIECE = re.compile(r"[^\W_]+|[.!?]+(?=\s|$)|\n+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class _Buckets(dict):
    """word: bucket, or -1 for a sentence's end. Starts anew when full, so that rare words don't fill memory."""

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = at = -1 if piece[0] in ".!?\n" else bucket(piece)
        return at


def pieces(text: str | None, known: _Buckets) -> np.ndarray:
    found = PIECE.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def sentences(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces: the buckets of words, and the number of the sentence that each stands in; sentences without word don't count."""
    end = at < 0
    number = np.cumsum(end)[~end]
    return at[~end], np.unique(number, return_inverse=True)[1] if len(number) else number


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.known = _Buckets()

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.bias = state
        self.known = _Buckets()

    def sentence_logits(self, text: str | None) -> np.ndarray:
        at, number = sentences(pieces(text, self.known))
        if not len(at):
            return np.zeros(0)
        words = np.unique(number * BUCKETS + at)  # a word counts once in a sentence
        return np.bincount(words // BUCKETS, weights=self.weights[words % BUCKETS]) + self.bias

    def sentence_causes(self, text: str | None) -> np.ndarray:
        """-log(1 - p) of each sentence, p being its score."""
        return np.maximum(_softplus(self.sentence_logits(text)) - _softplus(self.bias), 0)

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences' scores."""
        return float(-np.expm1(-self.sentence_causes(text).sum()))

    def offending(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """Spans (start, end, score) in code points of the offending sentences; there is one just if the document's score reaches the threshold."""
        causes = self.sentence_causes(text)
        enough = -np.log1p(-threshold)
        if not len(causes) or -np.expm1(-causes.sum()) < threshold:
            return []
        spans, start, end = [], None, None
        for m in PIECE.finditer(text):  # the text as given: lower() may change offsets, not the pieces' order
            if m[0][0] in ".!?\n":
                if start is not None:
                    spans.append((start, m.start() if m[0][0] == "\n" else m.end()))
                start = None
            else:
                start, end = m.start() if start is None else start, m.end()
        if start is not None:
            spans.append((start, end))
        if len(spans) != len(causes):  # lower-casing made or lost a piece: give the whole text
            return [(0, len(text), float(-np.expm1(-causes.sum())))]
        order = np.argsort(-causes, kind="stable")
        needed = 1 + int(np.searchsorted(np.cumsum(causes[order]), enough * (1 - 1e-12)))
        chosen = np.sort(order[: max(needed, int((causes >= enough).sum()))])
        return [(*spans[k], float(-np.expm1(-causes[k]))) for k in chosen.tolist()]


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[pd.DataFrame, float]:
    """(rows, share): of the documents that are learned from doc_id, toxic, n (sentences) and pairs (telling word, sentence), and the share
    of toxic ones among all that are labelled. A document with both labels is toxic."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = cut(marked.where("toxic = 0").orderBy(*order).limit(per_class).unionByName(marked.where("toxic = 1").orderBy(*order).limit(per_class)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Buckets()
        for pdf in batches:
            for doc_id, toxic, text in zip(pdf["doc_id"], pdf["toxic"], pdf["text"], strict=True):
                at, number = sentences(pieces(text, known))
                pair = np.unique(number * BUCKETS + at)
                yield pd.DataFrame({"doc_id": doc_id, "toxic": toxic, "n": int(number.max()) + 1 if len(number) else 0, "pairs": [pair]}, index=[0])

    # chosen is at most 2 * per_class rows of two numbers
    read = cut(texts.join(F.broadcast(chosen), "doc_id").mapInPandas(words, "doc_id long, toxic int, n long, pairs array<long>"))
    total = read.agg(F.count("*").alias("n"), F.avg("toxic").alias("share")).first()
    bucket_of = F.array_distinct(F.transform("pairs", lambda p: (p % BUCKETS).cast("int")))
    held = read.select("toxic", F.explode(bucket_of).alias("at")).groupBy("at").agg(F.count("*").alias("df"), F.sum("toxic").alias("in_toxic"))
    held = held.where(F.col("df") >= MIN_DOCUMENTS).toPandas()  # at most BUCKETS rows
    telling = _telling(held["at"].to_numpy(), held["df"].to_numpy(), held["in_toxic"].to_numpy(), total["n"], total["share"] or 0.0)
    kept = docs.sparkSession.sparkContext.broadcast(telling)  # at most BUCKETS numbers

    def only_telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(pairs=[p[np.isin(p % BUCKETS, kept.value)] for p in map(np.asarray, pdf["pairs"])])

    got = read.mapInPandas(only_telling, read.schema).toPandas()
    got["place"] = [zlib.crc32(str(i).encode()) for i in got["doc_id"]]
    got["size"] = [len(p) for p in got["pairs"]]
    return got.sort_values(["place", "doc_id", "n", "size"], kind="stable").reset_index(drop=True), share


def _telling(held: np.ndarray, df: np.ndarray, in_toxic: np.ndarray, n: int, share: float) -> np.ndarray:
    """Buckets, sorted, that stand more or less often in toxic documents than chance allows (chi-squared)."""
    expected = df * share
    off = np.maximum(np.abs(in_toxic - expected) - 0.5, 0) ** 2
    chi = off / np.maximum(expected * (1 - share) * (1 - df / max(1, n)), 1e-9)
    return np.sort(held[chi >= MIN_CHI_SQUARED]).astype(np.int64)


def train(rows: pd.DataFrame, prior: float, seed: int = 5) -> ToxicityModel:
    """rows: of sample(). prior: the share of toxic documents to which they are weighted."""
    y = rows["toxic"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(BUCKETS), -50.0 if not len(y) or y.max() == 0 else 0.0)
    all_pairs = [np.asarray(p, dtype=np.int64) for p in rows["pairs"]]
    held = np.unique(np.concatenate(all_pairs) % BUCKETS)
    size = len(held)
    cols = [np.searchsorted(held, p % BUCKETS) for p in all_pairs]
    sent = [p // BUCKETS for p in all_pairs]
    sizes = rows["n"].to_numpy(dtype=np.int64)
    share = y.mean()
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w, b, leak = np.zeros(size), -6.0, np.log(max(LEAK, 1e-6))
    m, v, mb, vb, ml, vl, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 0.0, 0.0, 0
    starts = np.cumsum([0] + [len(c) for c in cols])
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for ids in np.array_split(order, max(1, len(y) // 128)):
            col = np.concatenate([cols[i] for i in ids])
            local = np.concatenate([sent[i] for i in ids])
            counts = sizes[ids]
            base = np.concatenate([[0], np.cumsum(counts)[:-1]])
            row = local + np.repeat(base, [starts[i + 1] - starts[i] for i in ids])
            owner = np.repeat(np.arange(len(ids)), counts)
            z = np.bincount(row, weights=w[col], minlength=counts.sum()) + b
            total = np.bincount(owner, weights=_softplus(z), minlength=len(ids)) + np.exp(leak)  # minus log of the product of 1 - p
            # d(loss)/d(total): 1 for a clean document, -1 / (e^total - 1) for a toxic one
            pull = np.where(y[ids] == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-3), 1.0) * weight[ids]
            gz = pull[owner] / (1 + np.exp(-z))
            used = np.unique(col)
            g = np.bincount(col, weights=gz[row], minlength=size)[used] / len(ids) + DECAY * w[used]
            gb, gl = gz.sum() / len(ids), pull.mean() * np.exp(leak)
            t += 1
            m[used] = 0.9 * m[used] + 0.1 * g
            v[used] = 0.999 * v[used] + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            ml, vl = 0.9 * ml + 0.1 * gl, 0.999 * vl + 0.001 * gl * gl
            fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w[used] -= rate * fix * m[used] / (np.sqrt(v[used]) + 1e-8)
            b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
            leak -= rate * fix * ml / (np.sqrt(vl) + 1e-8)
    full = np.zeros(BUCKETS)
    full[held] = w
    return ToxicityModel(full, b)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return train(*sample(docs, labels))


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, spans: bool = True) -> DataFrame:
    """doc_id, score, and offending: array of (start, end, score) of sentences (unless spans is false).

    Null and empty texts, and those without a word, have score 0; with no label of a class nothing is toxic (or, where all labels are 1, each
    sentence adds nothing beyond the background). Texts of any length are scored whole, sentence by sentence. Of sentences with equal scores
    the earlier ones count as offending first. Repeated rows come back as often as they came in; extra columns
    are ignored; an empty table gives no row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for pdf in batches:
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "score": [own.score(t) for t in pdf["text"]]})
            if spans:
                out["offending"] = [[{"start": a, "end": b, "score": p} for a, b, p in own.offending(t, threshold)] if s >= threshold else [] for t, s in zip(pdf["text"], out["score"], strict=True)]
            yield out

    kind = "doc_id long, score double" + (", offending array<struct<start: long, end: long, score: double>>" if spans else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, kind)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = crc32_mod(F.col("doc_id"), 3)
    model = fit(docs.where(fold != 1), labels.where(fold != 1))
    out = score_documents(docs, model)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
