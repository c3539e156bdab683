"""Full-text search: BM25 over an inverted index, and a grammar of phrases, prefixes, NEAR and OR."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bm25(tokens: DataFrame, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """symbol_id, score of the k best by BM25; ties by symbol_id. tokens: (symbol_id, text). Only postings of the terms are joined."""
    size = tokens.groupBy("symbol_id").agg(F.count("*").alias("size"))
    stats = size.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    tf = tokens.where(F.col("text").isin(*terms)).groupBy("symbol_id", "text").agg(F.count("*").alias("tf"))
    df = tf.groupBy("text").agg(F.count("*").alias("df"))
    met = tf.join(F.broadcast(df), "text").join(size, "symbol_id").crossJoin(F.broadcast(stats))  # df: a row a term; stats: one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return met.groupBy("symbol_id").agg(F.sum(part).alias("score")).orderBy(F.round("score", 9).desc(), "symbol_id").limit(k)


_TOKEN = re.compile(r'"([^"]*)"|NEAR\(\s*([^,()]*?)\s*(?:,\s*(\d+)\s*)?\)|(\bOR\b)|(\bAND\b)|(\bNOT\b)|([^\s"()]+)')


def match(text: Column, expression: str) -> Column:
    """A condition on text, case ignored: words and "phrases" are substrings, word* starts a word, NEAR(a b, n) wants both within n
    characters, OR joins alternatives, NOT excludes, side by side or AND means all."""
    low = F.lower(text)
    groups: list[list[Column]] = [[]]
    negate = False
    for m in _TOKEN.finditer(expression):
        phrase, near, within, either, _and, no, word = m.groups()
        if either:
            groups.append([])
            continue
        if _and:
            continue
        if no:
            negate = True
            continue
        if near is not None:
            a = [re.escape(x.lower()) for x in near.split()]
            gap = f".{{0,{int(within or 10)}}}?"
            cond = low.rlike("(?s)" + gap.join(a)) | low.rlike("(?s)" + gap.join(reversed(a)))
        elif phrase is not None:
            cond = low.contains(phrase.lower())
        elif word.endswith("*"):
            cond = low.rlike(r"\b" + re.escape(word[:-1].lower()))
        else:
            cond = low.contains(word.lower())
        groups[-1].append(~cond if negate else cond)
        negate = False
    out = F.lit(False)
    for g in groups:
        if g:
            every = g[0]
            for c in g[1:]:
                every = every & c
            out = out | every
    return out
