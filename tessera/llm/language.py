"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are the character n-grams of its words, word borders included. Each is hashed to a row of an embedding
table; the mean of the rows of all subwords of the whole text goes through a linear layer and a softmax. Table and layer
are learned together by stochastic gradient descent in numpy. A part of the sample is held back to fit a temperature, so
that scores are probabilities, and the least score at which accepted texts reach the wanted accuracy.

A text costs a histogram of its hashed subwords and two small products. Every language of the labelled rows can be predicted, however many
there are: what is broadcast is the table (BUCKETS by DIM) and one row of DIM for each language.

The fit uses a bounded sample: SAMPLE_PER_LANGUAGE texts of a language, fewer where that would make more than SAMPLE in all (but one at
least), chosen by a hash of doc_id after one count of the languages. Workers turn them into histograms before they reach the driver, so that
text length does not matter.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc32_mod, table

BUCKETS = 1 << 14
GRAMS = (2, 3)
DIM = 16
SAMPLE_PER_LANGUAGE = 400
SAMPLE = 60_000
BROADCAST_LANGUAGES = 50_000  # a table of so many languages with a number each is sent to all tasks
EPOCHS = 12
RATE = 20.0
TARGET_ACCURACY = 0.99
UNDETERMINED = "und"
CHUNK = 1 << 20  # characters hashed at once

_letters: np.ndarray | None = None


def _alphabet() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if a mark, else 0."""
    global _letters
    if _letters is None:
        kinds = {"L": 2, "M": 1}
        _letters = np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8)
    return _letters


def histogram(text: str | None, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> np.ndarray | None:
    """Counts of hashed subwords over the whole text; None if the text is null or has no letter."""
    if not text:
        return None
    kinds = _alphabet()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds[points]
    if not (kind == 2).any():
        return None
    out = np.zeros(buckets, dtype=np.int64)
    shift = np.uint32(32 - int(math.log2(buckets)))
    overlap = max(grams) - 1
    for at in range(0, len(points), CHUNK):
        # the chunk, with a border at either end of the text, and what grams that begin in it need beyond it
        part = np.where(kind[at : at + CHUNK + overlap] > 0, points[at : at + CHUNK + overlap], np.uint32(32))
        if at == 0:
            part = np.concatenate([[np.uint32(32)], part])
        if at + CHUNK >= len(points):
            part = np.concatenate([part, [np.uint32(32)]])
        mixed = part * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        word = part != 32
        for n in grams:
            m = len(part) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + mixed[k : k + m]
            inside = np.ones(m, dtype=bool)
            for k in range(1, n - 1):
                inside &= word[k : k + m]
            inside &= word[:m] | word[n - 1 :]
            if at + CHUNK < len(points):
                inside[CHUNK + (at == 0) :] = False  # these begin in the next chunk
            h = (h * np.uint32(0x85EBCA6B)) >> shift
            out += np.bincount(h[inside], minlength=buckets)
    return out if out.any() else None


class LanguageModel:
    """emb: bucket by DIM; layer: DIM by language; then bias, temperature and least score."""

    def __init__(self, languages: list[str], emb: np.ndarray, layer: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float) -> None:
        self.languages, self.emb, self.layer, self.bias, self.temperature, self.reject_below = languages, emb.astype(np.float32), layer.astype(np.float32), bias, temperature, reject_below

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, whether the caller should reject it."""
        h = histogram(text)
        if h is None or not self.languages:
            return UNDETERMINED, 0.0, True
        used = np.nonzero(h)[0]
        z = (h[used].astype(np.float64) @ self.emb[used] / h.sum() @ self.layer + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below)


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> pd.DataFrame:
    """doc_id, lang and sparse subword counts of up to per_language texts of each language."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED))
    counts = known.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return pd.DataFrame({"doc_id": [], "lang": [], "at": [], "n": []})
    wanted = max(1, min(per_language, SAMPLE // languages))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    # a language of at most 16 texts offers all of them, so that none goes unlearned by the luck of the hash
    share = counts.select("lang", F.when(F.col("count") <= 16, F.lit(1.0)).otherwise(F.greatest(1.5 * wanted / F.col("count"), 16 / F.col("count"))).alias("share"))
    chosen = place < F.col("share")
    if languages <= BROADCAST_LANGUAGES:
        near = known.join(F.broadcast(share), "lang").where(chosen)
    else:  # rows are picked without their texts first, of which no more than about 1.5 * SAMPLE are then read
        picked = known.select("doc_id", "lang").join(share, "lang").where(chosen).select("doc_id", "lang").distinct()
        near = known.join(picked, ["doc_id", "lang"], "left_semi")
    near = near.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", place.alias("place"), "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                h = histogram(r.text)
                if h is not None:
                    used = np.nonzero(h)[0]
                    rows.append((r.doc_id, r.lang, r.place, used.astype(np.int32), h[used].astype(np.float32)))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "place", "at", "n"])

    got = near.mapInPandas(counted, "doc_id long, lang string, place double, at array<int>, n array<float>").toPandas()
    return got.sort_values(["place", "doc_id"], kind="stable").groupby("lang", sort=True).head(wanted).reset_index(drop=True)


def train(rows: pd.DataFrame, seed: int = 11) -> LanguageModel:
    """Every fifth row of the sample, in hash order, calibrates; the others are learned from."""
    languages = sorted(rows["lang"].unique()) if len(rows) else []
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, DIM)), np.zeros((DIM, 0)), np.zeros(0), 1.0, 1.0)
    y = np.searchsorted(np.array(languages, dtype=object), rows["lang"].to_numpy(dtype=object))
    at, n = rows["at"].tolist(), [np.asarray(c, dtype=np.float32) / np.sum(c) for c in rows["n"]]
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 10 else np.zeros(len(rows), dtype=bool)
    held &= ~np.isin(y, np.setdiff1d(y, y[~held]))  # every language is learned from at least one text
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIM)) / math.sqrt(DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    own = np.nonzero(~held)[0]
    steps, step = EPOCHS * math.ceil(len(own) / 16), 0

    def dense(ids: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ids), BUCKETS), dtype=np.float32)
        for k, i in enumerate(ids):
            x[k, at[i]] = n[i]
        return x

    def soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for _ in range(EPOCHS):
        for ids in np.array_split(rng.permutation(own), math.ceil(len(own) / 16)):
            rate = RATE * (1 - step / steps)
            step += 1
            x = dense(ids)
            cols = np.nonzero(x.any(0))[0]
            x = x[:, cols]
            h = x @ emb[cols]
            g = soft(h @ layer + bias)
            g[np.arange(len(ids)), y[ids]] -= 1
            g /= len(ids)
            back = g @ layer.T
            layer -= np.float32(rate) * (h.T @ g)
            bias -= np.float32(0.02 * rate) * g.sum(0)
            emb[cols] -= np.float32(rate) * (x.T @ back)
    check = np.nonzero(held)[0] if held.any() else own
    z = np.concatenate([dense(check[k : k + 64]) @ emb @ layer + bias for k in range(0, len(check), 64)]).astype(np.float64)
    doubt = 1 / (len(z) + 2)  # a check without an error doesn't make scores certain

    def loss(t: float) -> float:
        logs = np.log(np.maximum(soft(z / t), 1e-30))
        return -float(((1 - doubt) * logs[np.arange(len(z)), y[check]] + doubt * logs.mean(1)).mean())

    temperature = min(np.geomspace(0.05, 20, 121).tolist(), key=loss)
    p = soft(z / temperature)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum(p.argmax(1)[order] == y[check][order]) / np.arange(1, len(order) + 1)
    good = np.nonzero(right >= TARGET_ACCURACY)[0]
    return LanguageModel(languages, emb, layer, bias, temperature, float(p.max(1)[order][good[-1]]) if len(good) else 1.0)


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row of docs, by a model fitted on labelled (default: docs).

    docs needs doc_id and text; labelled also lang. A null text, or one without a letter, is `und` with score 0 and rejected;
    so is everything if there's nothing to learn from. Repeated rows come back as often as they came in, extra columns are
    ignored, an empty table gives no row. Ties in the sample's order are broken by doc_id.
    """
    model = train(sample(docs if labelled is None else labelled))
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times DIM floats and DIM for each language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [held.value.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc32_mod(F.col("doc_id"), 5)
    out = identify(docs, docs.where(fold != 0))
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
