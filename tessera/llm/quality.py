"""Text quality without labels: overlapping heuristic labellers, a label model, and a hashed linear scorer.

1. Each labeller looks at one trait of a whole text and votes good, bad or abstains. Labellers overlap: what is wrong with a text shows in
   several traits, so that their agreement tells how far each of them can be trusted.
2. Expectation-maximisation over the votes estimates the share of good texts and, for each labeller, how often it votes bad on
   good and on bad ones, both freely (under a weak prior). A labeller that often stands alone with its bad votes loses them that way. It needs
   only the number of texts with each pattern of votes, so it uses all of them; there are at most 3 ** len(LABELLERS) patterns, however many texts.
3. The posterior probabilities are the labels from which a logistic regression over hashed features is trained, on a
   bounded sample: up to SAMPLE_PER_PATTERN texts of a pattern and SAMPLE in all, weighted to stand for the others.
4. The scorer judges every text; below THRESHOLD it is rejected.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

BAD, ABSTAIN, GOOD = 0, 1, 2
BUCKETS = 1 << 12
SAMPLE = 8_000
SAMPLE_PER_PATTERN = 800
THRESHOLD = 0.5
EM_ROUNDS = 200
PRIOR_VOTES = 4.0  # as many imagined votes of each labeller on good and on bad texts
PRIOR_BAD = (0.5, 0.05)  # share of bad votes among them, on bad and on good texts
EPOCHS = 400
RATE = 0.05
CACHE = 200_000

_LETTER = re.compile(r"[^\W\d_]")
#: Marks that ordinary prose holds.
_PROSE = set(".,;:'\"?!()-–—’‘“”«»„¿¡…%&/")
_EDGES = "".join(_PROSE)
_STOPS = ".!?…:。！？।؟"
_OTHER, _SMALL, _CAPITAL, _MARK, _ODD, _SPACE = range(6)
_kinds: np.ndarray | None = None


def _alphabet() -> np.ndarray:
    """For each code point: small letter (or one without case), capital, mark of prose, odd character, white space, other."""
    global _kinds
    if _kinds is None:

        def known(c: str) -> int:
            if c.isalpha():
                return _CAPITAL if c.isupper() else _SMALL
            return _SPACE if c.isspace() else _OTHER if c.isalnum() or unicodedata.category(c)[0] == "M" else _MARK if c in _PROSE else _ODD

        _kinds = np.array([known(chr(c)) for c in range(0x110000)], dtype=np.uint8)
    return _kinds


class _Looks(dict):
    """word: 1 if it holds a letter, plus 2 if it's letters within marks of prose only, plus 4 if it ends a sentence, plus 8 if that's by an
    exclamation. Starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        core = word.strip(_EDGES)
        letters = word.isalpha() or bool(_LETTER.search(word))
        clean = letters and (core.isalpha() or core.replace("-", "").replace("'", "").replace("’", "").isalpha()) and len(word) - len(core) <= 3
        tail = word.rstrip("\"'”’»)")[-1:]
        self[word] = got = letters + 2 * clean + 4 * (tail in _STOPS and tail != "") + 8 * (tail == "!" or tail == "！")
        return got


_looks = _Looks()


def _repeats(words: list[str]) -> tuple[int, int, int]:
    """How many words equal the one before; how many different runs of three words there are; how often the commonest word stands. By Python's
    word hashes, within one text."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    echoes = int((h[1:] == h[:-1]).sum())
    runs = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] if len(h) > 2 else h[:0]
    h.sort()
    ends = np.nonzero(h[1:] != h[:-1])[0] if len(h) else h[:0]
    most = int(np.diff(np.concatenate([[-1], ends, [len(h) - 1]])).max()) if len(h) else 0
    return echoes, len(np.unique(runs)), most


def traits(text: str) -> dict[str, float]:
    """What the labellers look at; rates are by word, line or character of the whole text."""
    words = text.split()
    n, lines = max(1, len(words)), [x for x in text.split("\n") if x.strip()]
    kinds = np.bincount(_alphabet()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=6)
    letters, solid = int(kinds[_SMALL] + kinds[_CAPITAL]), max(1, len(text) - int(kinds[_SPACE]))
    looks = np.bincount(np.fromiter(map(_looks.__getitem__, words), np.int64, len(words)), minlength=16)
    have = lambda bit: int(looks[[k for k in range(16) if k & bit]].sum())
    stops = have(4)
    echoes, runs, most = _repeats(words)
    return {
        "words": len(words),
        "symbols": kinds[_ODD] / n,
        "marks": (kinds[_ODD] + kinds[_MARK]) / solid,
        "alphabetic": have(1) / n,
        "clean": have(2) / n,
        "letters": letters,
        "upper": kinds[_CAPITAL] / max(1, letters),
        "stops": stops,
        "sentence": n / max(1, stops),
        "exclaimed": have(8) / max(1, stops),
        "echoes": echoes / n,
        "variety": runs / max(1, len(words) - 2),
        "most": most / n,
        "lines": len(lines),
        "line_variety": len(set(lines)) / max(1, len(lines)),
        "word_length": sum(map(len, words)) / n,
    }


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


#: Name and rule, after the filters published for web corpora (symbols by word, alphabetic words, stops, repeated lines and phrases, word
#: lengths). A trait that a text is too short for makes the labeller abstain.
LABELLERS = {
    "symbols": lambda t: _vote(t["symbols"] > 0.1, t["symbols"] < 0.02),
    "marks": lambda t: ABSTAIN if t["words"] < 8 else _vote(t["marks"] > 0.15, t["marks"] < 0.08),
    "alphabetic_words": lambda t: _vote(t["alphabetic"] < 0.8, t["alphabetic"] > 0.9),
    "clean_words": lambda t: ABSTAIN if t["words"] < 4 else _vote(t["clean"] < 0.7, t["clean"] > 0.85),
    "capitals": lambda t: ABSTAIN if t["letters"] < 40 else _vote(t["upper"] > 0.4, t["upper"] < 0.15),
    "exclamations": lambda t: ABSTAIN if t["stops"] < 4 else _vote(t["exclaimed"] > 0.5, t["exclaimed"] < 0.2),
    "sentence_length": lambda t: ABSTAIN if t["words"] < 20 else _vote(t["sentence"] < 2.5 or t["sentence"] > 80, 4 < t["sentence"] < 40),
    "echoes": lambda t: ABSTAIN if t["words"] < 8 else _vote(t["echoes"] > 0.15, t["echoes"] < 0.05),
    "commonest_word": lambda t: ABSTAIN if t["words"] < 20 else _vote(t["most"] > 0.3, t["most"] < 0.15),
    "variety": lambda t: ABSTAIN if t["words"] < 20 else _vote(t["variety"] < 0.3, t["variety"] > 0.6),
    "line_variety": lambda t: ABSTAIN if t["lines"] < 5 else _vote(t["line_variety"] < 0.5, t["line_variety"] > 0.8),
    "word_length": lambda t: _vote(not 2 <= t["word_length"] <= 20, 3 <= t["word_length"] <= 12),
}


def votes(text: str | None) -> str:
    """One digit for each labeller. Null, empty and blank texts: all bad."""
    if not text or not text.strip():
        return str(BAD) * len(LABELLERS)
    t = traits(text)
    return "".join(str(rule(t)) for rule in LABELLERS.values())


def label_model(counts: dict[str, int]) -> dict[str, float]:
    """For each pattern of votes the posterior probability that such a text is good, by expectation-maximisation.

    Labellers are taken to be independent given the class; an abstention says nothing. It starts from the guess that two bad votes make a text bad,
    that none makes it good and that one leaves it open, which also settles which of the two classes is called good.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    v = np.array([[int(c) for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], dtype=float)
    is_bad, is_good = (v == BAD).astype(float), (v == GOOD).astype(float)
    good = np.choose(np.minimum(is_bad.sum(1).astype(int), 2), [0.99, 0.5, 0.01])
    for _ in range(EM_ROUNDS):
        log = np.zeros((2, len(n)))
        for c, belief in enumerate((1 - good, good)):
            cast = (n * belief) @ is_bad + PRIOR_VOTES * PRIOR_BAD[c]
            bad = cast / (cast + (n * belief) @ is_good + PRIOR_VOTES * (1 - PRIOR_BAD[c]))
            log[c] = is_bad @ np.log(bad) + is_good @ np.log(1 - bad) + np.log((n @ belief + 1) / (n.sum() + 2))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        settled = np.abs(new - good).max() < 1e-9
        good = new
        if settled:
            break
    return dict(zip(patterns, good.tolist(), strict=True))


class _Shapes(dict):
    """word: bucket of its case and of the other characters that it holds. Starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        core = word if word.isalpha() else word.strip(_EDGES)
        core = core if core.isalpha() else "".join(_LETTER.findall(word))
        case = "none" if not core else "lower" if core.islower() else "upper" if len(core) > 1 and core.isupper() else "title" if len(core) == 1 or core[1:].islower() else "mixed"
        rest = "" if core is word else "".join(sorted(set(word) - set(core)))[:8]
        self[word] = at = bucket(f"{case} {'0' if any(map(str.isdigit, rest)) else rest}")
        return at


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


_ECHO, _AGAIN, _LINE = bucket("= same word as before"), bucket("= three words seen before"), bucket("= line seen before")


def features(text: str, shapes: _Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: the root of each feature's share of the words."""
    words = text.split()
    n = max(1, len(words))
    counts = np.bincount(np.fromiter(map(shapes.__getitem__, words), np.int64, len(words)), minlength=BUCKETS).astype(float)
    echoes, runs, _ = _repeats(words)
    counts[_ECHO] += echoes
    counts[_AGAIN] += max(0, len(words) - 2) - runs
    lines = [x for x in text.split("\n") if x.strip()]
    counts[_LINE] += (1 - len(set(lines)) / max(1, len(lines))) * n
    used = np.nonzero(counts)[0]
    return used, np.sqrt(counts[used] / n)


class Scorer:
    """Logistic regression over hashed features."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self.shapes = weights, float(bias), _Shapes()

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.bias = state
        self.shapes = _Shapes()

    def score(self, text: str | None) -> float:
        """Probability of being good; 0 for null, empty and blank texts."""
        if not text or not text.strip():
            return 0.0
        at, x = features(text, self.shapes)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[at] + self.bias, -500, 500))))


def train(rows: pd.DataFrame) -> Scorer:
    """rows: at, x (features), good (posterior), weight. Full-batch Adam with decay."""
    if not len(rows):
        return Scorer(np.zeros(BUCKETS), 0.0)
    owner = np.repeat(np.arange(len(rows)), rows["at"].map(len))
    col, val = np.concatenate([*rows["at"]]).astype(np.int64), np.concatenate([*rows["x"]]).astype(float)
    y, weight = rows["good"].to_numpy(float), rows["weight"].to_numpy(float)
    weight = weight / weight.sum()
    w, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, EPOCHS + 1):
        z = np.bincount(owner, weights=w[col] * val, minlength=len(y)) + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) * weight
        grad = np.append(np.bincount(col, weights=g[owner] * val, minlength=BUCKETS), g.sum())
        grad[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Scorer(w[:-1], w[-1])


def fit(docs: DataFrame) -> Scorer:
    """The scorer for a table of documents (doc_id, text), learned from the table itself without labels."""
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "pattern": [votes(t) for t in pdf["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    judged = cut(texts.mapInPandas(judge, "doc_id long, pattern string"))
    counts = {r["pattern"]: r["count"] for r in judged.groupBy("pattern").count().collect()}
    good = label_model(counts)
    total = sum(counts.values())
    wanted = {p: min(n, SAMPLE_PER_PATTERN, max(20, SAMPLE * n // max(1, total))) for p, n in counts.items()}
    scale = min(1.0, SAMPLE / max(1, sum(wanted.values())))
    share = {p: min(1.0, scale * wanted[p] / counts[p]) for p in counts}
    if not share:
        return train(pd.DataFrame({"at": [], "x": [], "good": [], "weight": []}))
    rate = F.create_map(*[F.lit(x) for p in sorted(share) for x in (p, share[p])])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    chosen = judged.where(F.col("doc_id").isNotNull() & (place < rate[F.col("pattern")])).dropDuplicates(["doc_id"])

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = _Shapes()
        for pdf in batches:
            pdf = pdf[pdf["text"].notna()]
            got = [features(t, shapes) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "pattern": pdf["pattern"], "at": [a.astype(np.int32) for a, _ in got], "x": [x for _, x in got]})

    rows = texts.join(F.broadcast(chosen), "doc_id").mapInPandas(featured, "doc_id long, pattern string, at array<int>, x array<double>").toPandas()  # chosen: about SAMPLE rows
    rows = rows.sort_values(["doc_id", "pattern"], kind="stable").reset_index(drop=True)
    rows["good"], rows["weight"] = rows["pattern"].map(good), rows["pattern"].map(lambda p: 1 / share[p])
    return train(rows)


def score_column(docs: DataFrame, model: Scorer, text: str = "text"):
    """A column with the score of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([held.value.score(t) for t in part], dtype=float)

    return score(F.col(text))


def judge(docs: DataFrame, model: Scorer | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns quality_score and kept added (replacing columns of those names). Fits a model if none is given.

    Null, empty and blank texts score 0 and are not kept; texts of any length are judged whole. A score equal to the threshold is kept, and equal
    texts score the same. Repeated rows come back as often as they came in (each counts as a text
    in the label model); rows without doc_id are scored, but not learned from; an empty table gives no row.
    """
    model = model or fit(docs)
    return docs.withColumn("quality_score", score_column(docs, model)).withColumn("kept", F.col("quality_score") >= F.lit(threshold))


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("quality_score").alias("score"), "kept")
