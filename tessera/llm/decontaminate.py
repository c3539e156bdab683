"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are compared as words, in lower case and without marks; a letter of a script without blanks is a word. An item of m words may differ from a
passage in up to floor(MAX_ERROR * m) edits of words. It is split into one piece more than that, so that at least one piece
stands in the passage as it is. All pieces of all items are looked for at once (Aho-Corasick) in whole texts; around
each hit, the window that can hold the item is verified with Myers' bit-parallel algorithm, in which one machine
operation on a bit vector of the item's length advances a whole column of the edit-distance matrix.

The benchmark is taken to the workers in blocks of BLOCK_CHARS characters at most (an item that is longer is a block of its own). Each block
has its own scan of the documents in tasks of its own, so that a worker holds one block at a time, however many items there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, spaced, table

MAX_ERROR = 0.2
MIN_ITEM_WORDS = 1
BLOCK_CHARS = 4_000_000

_BREAK = re.compile(r"[\W_]+")
HITS = "array<struct<item_id: bigint, distance: int, start_word: int, end_word: int>>"


def normalise(text: str | None) -> str:
    """Words parted by single blanks, one before and one after; a blank if there's none."""
    words = _BREAK.sub(" ", spaced((text or "").lower())).strip()
    words = " ".join(words.split()) if "  " in words else words
    return f" {words} " if words else " "


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """The least edit distance between the pattern and any run of words in the text, and where the first such run ends (exclusive)."""
    m = len(pattern)
    equal: dict[str, int] = {}
    for i, w in enumerate(pattern):
        equal[w] = equal.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        eq = equal.get(w, 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        hp, hn = minus | (full & ~(d0 | plus)), plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full  # a run may begin anywhere: no cost enters at the top
        plus, minus = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """items: (item_id, text). Those of fewer than min_words words aren't looked for."""

    def __init__(self, items: list[tuple[int, str | None]], max_error: float = MAX_ERROR, min_words: int = MIN_ITEM_WORDS) -> None:
        self.items, self.max_error, self.min_words, self.automaton = items, max_error, max(1, min_words), None

    def __getstate__(self) -> tuple:
        return self.items, self.max_error, self.min_words

    def __setstate__(self, state: tuple) -> None:
        self.items, self.max_error, self.min_words = state
        self.automaton = None

    def _build(self) -> None:
        import ahocorasick

        self.words = [normalise(t).split() for _, t in self.items]
        self.budget = [int(self.max_error * len(w)) for w in self.words]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (words, budget) in enumerate(zip(self.words, self.budget, strict=True)):
            if len(words) < self.min_words:
                continue
            n, at = budget + 1, 0
            for p in range(n):
                size = (len(words) - at) // (n - p)
                pieces.setdefault(f" {' '.join(words[at : at + size])} ", []).append((k, at))
                at += size
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start word, end word) of the best passage for each item that the text holds."""
        if self.automaton is None:
            self._build()
        if not len(self.automaton) or not text:
            return []
        norm = normalise(text)
        hits = list(self.automaton.iter(norm))
        if not hits:
            return []
        words = norm.split()
        windows: dict[int, list[tuple[int, int]]] = {}
        seen, at = 0, 0
        for last, (size, owners) in hits:  # in the order of their ends; pieces start at a blank
            start = last - size + 1
            seen, at = (seen + norm.count(" ", at, start), start) if start >= at else (norm.count(" ", 0, start), start)
            for k, offset in owners:
                begin = seen - offset - self.budget[k]
                windows.setdefault(k, []).append((max(0, begin), begin + len(self.words[k]) + 2 * self.budget[k]))
        out = []
        for k, spans in sorted(windows.items()):
            best = None
            for a, b in _merged(spans):
                distance, end = myers(self.words[k], words[a:b])
                if distance <= self.budget[k] and (best is None or distance < best[0]):
                    best = (distance, a, a + end)
            if best:
                distance, a, end = best
                _, back = myers(self.words[k][::-1], words[max(a, end - len(self.words[k]) - distance) : end][::-1])
                out.append((self.items[k][0], distance, end - back, end))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text), in blocks; equal rows once, null texts not at all."""
    held, size = [], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct().orderBy("item_id", "text")
    for item_id, text in items.toLocalIterator():
        if held and size + len(text) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    if held:
        yield held


def _finder(held):
    @F.pandas_udf(HITS)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([[{"item_id": i, "distance": d, "start_word": a, "end_word": b} for i, d, a, b in held.value.find(t)] for t in part], dtype=object)

    return found


def hits_columns(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, min_words: int = MIN_ITEM_WORDS, text: str = "text") -> list[Column]:
    """For each block of the benchmark the HITS of a row's whole text: for each item that stands in it, its best passage. Use them in tasks of
    their own."""
    context = docs.sparkSession.sparkContext
    return [_finder(context.broadcast(Matcher(block, max_error, min_words)))(F.col(text)) for block in blocks(benchmark)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, min_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word (exclusive): one row for each document and item that stands in it.

    Null and empty texts hold nothing, and items without a word are never found, nor are those of fewer than min_words words; items of fewer than
    1 / max_error words must stand as they are. Texts are read whole, however long. Repeated documents come back as often as
    they came in; equal items count once; of equally good passages the first counts. Extra columns are ignored, empty tables give no row.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [own.select("doc_id", hits.alias("hits")) for hits in hits_columns(docs, benchmark, max_error, min_words)]
    out = reduce(DataFrame.unionByName, found) if found else own.select("doc_id", F.lit([]).cast(HITS).alias("hits"))
    return out.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance", "h.start_word", "h.end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, min_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """docs without the documents in which an item stands; columns as they are. Null and empty texts and rows without doc_id are documents like
    others; repeated rows stay or go together."""
    columns = hits_columns(docs, benchmark, max_error, min_words)
    if not columns:
        return docs
    for hits in columns[:-1]:  # one block at a time: what is left is stored before the next one
        docs = cut(docs.where(F.size(hits) == 0))
    return docs.where(F.size(columns[-1]) == 0)


def query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
