"""Line deduplication by a deletion-neighbourhood join.

A line is compared as its words, in lower case; a letter of a script without blanks is a word. Lines of MIN_WORDS words or more that are equal are one line; lines of
MIN_WORDS_EDITED words or more are also the same if one edit of a word (put in, left out or replaced) turns one into the other.
Of the same lines the earliest stays, by doc_id and place in the document. Shorter lines are left alone.

The neighbourhood of a line is what is left of it after any one deletion. Two lines are one replacement apart just if they
leave the same rest at the same place, and one insertion apart just if one is in the other's neighbourhood. So keys are hashes of

    (place, rest)    lines that share it are all one edit apart from each other: each is compared with the earliest
    (whole line)     emitted by the line itself and by lines with a deletion that leaves it: these are compared with it

Both cases need only the smallest place in each group, a pre-aggregated minimum: a group is never turned into pairs,
however large it is. The partner that a line would be dropped for is verified by its edit distance.

Neighbourhoods hold as many keys as a line has words, so they are emitted only for lines that can have a partner at all: one edit
leaves the first or the second half of a line as it was, so a line that shares neither half with another
distinct line has none. That filter is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, spaced, table

MIN_WORDS = 5
MIN_WORDS_EDITED = 10


def _digest(kind: str, words: list[str]) -> int:
    """A signed 64-bit hash of some words in a role: a line, a half, what's left after a deletion."""
    h = xxhash.xxh64_intdigest(f"{kind} {len(words)} {' '.join(words)}".encode("utf-8", "surrogatepass"), 0)
    return h - (1 << 64) if h >> 63 else h


def _halves(words: list[str]) -> tuple[int, int, int]:
    """Hashes of the halves that a line shares with a line one edit away: cut in the middle as it is, and as if it were one word shorter.
    Of the four one is said twice: even lines have one tail, odd ones one head."""
    n = len(words)
    middle, shorter = n // 2, (n - 1) // 2
    third = _digest("head", words[:shorter]) if n % 2 == 0 else _digest("tail", words[n - (n - 1 - shorter) :])
    return _digest("head", words[:middle]), _digest("tail", words[middle:]), third


def _lines(docs: DataFrame, halves: bool) -> DataFrame:
    """doc_id, version (of the text), line_no, h, and, if halves are wanted, n, k0, k1, k2, for lines long enough to be compared."""
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    names = ["line_no", "h"] + (["n", "k0", "k1", "k2"] if halves else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                rows, counts = [], []
                for text in part["text"]:
                    before = len(rows)
                    for no, line in enumerate(text.split("\n")):
                        words = spaced(line.lower()).split()
                        if len(words) >= MIN_WORDS:
                            own = (no, _digest("line", words))
                            rows.append(own + (len(words), *_halves(words)) if halves else own)
                    counts.append(len(rows) - before)
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "version", np.repeat(part["version"].to_numpy(), counts))
                out.insert(0, "doc_id", np.repeat(part["doc_id"].to_numpy(), counts))
                yield out

    kind = "doc_id long, version long, line_no int, h long" + (", n int, k0 long, k1 long, k2 long" if halves else "")
    return texts.mapInPandas(run, kind)


def _within_one(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two lists of words is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    k = 0
    while k < len(short) and short[k] == long[k]:
        k += 1
    return short[k + (len(short) == len(long)) :] == long[k + 1 :]


def same_lines(docs: DataFrame) -> DataFrame:
    """One row for each distinct line: h, first (doc_id, line_no), near: whether an earlier line is one edit away."""
    place = F.struct("doc_id", "line_no", "version")
    distinct = cut(_lines(docs, True).groupBy("h").agg(F.min(place).alias("first"), F.max("n").alias("n"), *[F.max(k).alias(k) for k in ("k0", "k1", "k2")]))
    halves = distinct.where(F.col("n") >= MIN_WORDS_EDITED - 1).select("h", F.explode(F.array("k0", "k1", "k2")).alias("key"))
    shared = halves.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("key")
    able = halves.join(shared, "key", "left_semi").select("h").distinct()
    wanted = distinct.join(able, "h", "left_semi").select("h", "first")
    texts = cut(_words_of(docs, wanted))
    near = _verified(texts, _partners(texts))
    return distinct.select("h", "first").join(near.withColumn("near", F.lit(True)), "h", "left").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (h, first) with words: the documents are joined to the places that are wanted of them, and only those lines are split."""
    places = wanted.groupBy(F.col("first.doc_id").alias("_doc_id"), F.col("first.version").alias("_version")).agg(F.collect_list(F.struct("h", "first")).alias("places"))
    met = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("text").alias("_version"), "text").join(places, ["_doc_id", "_version"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, places in zip(pdf["text"], pdf["places"], strict=True):
                lines = text.split("\n")
                rows += [(p["h"], p["first"], spaced(lines[p["first"]["line_no"]].lower()).split()) for p in places]
            yield pd.DataFrame(rows, columns=["h", "first", "words"])

    # rows of one doc_id and one text are the same document
    return met.select("text", "places").mapInPandas(run, "h long, first struct<doc_id: long, line_no: int, version: long>, words array<string>").dropDuplicates(["h"])


def _neighbourhoods(texts: DataFrame) -> DataFrame:
    """h, place_key, line_key: for each word of a line the hashes of what is left without it, with and without its place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                counts, places, line = [], [], []
                for words in part["words"]:
                    n, text, at = len(words), " ".join(words), 0
                    head = f"line {n - 1} "
                    for i, word in enumerate(words):
                        after = at + len(word) + 1
                        rest = text[:at] + text[after:] if i < n - 1 else text[: at - 1]
                        line.append(xxhash.xxh64_intdigest((head + rest).encode("utf-8", "surrogatepass"), 0))
                        at = after
                    counts.append(n)
                    places.append(np.arange(n, dtype=np.uint64))
                keys = np.array(line, dtype=np.uint64)
                # a bijection of the rest's hash for each place
                placed = (keys ^ (np.concatenate(places) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
                yield pd.DataFrame({"h": np.repeat(part["h"].to_numpy(), counts), "place_key": placed.view(np.int64), "line_key": keys.view(np.int64)})

    long_enough = texts.where(F.size("words") >= MIN_WORDS_EDITED)
    return long_enough.select("h", "words").mapInPandas(run, "h long, place_key long, line_key long")


def _partners(texts: DataFrame) -> DataFrame:
    """h and partner: of each line with an earlier one in its neighbourhood groups, the earliest such. Only h and key of a neighbourhood are
    shuffled; places are joined to what has met."""
    rests, firsts = _neighbourhoods(texts), texts.select("h", F.struct("first.doc_id", "first.line_no").alias("first"))
    # replaced: all that share a key are one edit apart, so the earliest of them is a partner of each other one
    replaced = rests.select("h", F.col("place_key").alias("key"))
    shared = replaced.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("key")
    met = replaced.join(shared, "key").join(firsts, "h")
    earliest = met.groupBy("key").agg(F.min(F.struct("first", "h")).alias("e"))
    by_place = met.join(earliest, "key").where(F.col("e.first") < F.col("first")).select("h", "e")
    # left out: line_key is the hash of the shorter line, which is there once
    pairs = rests.select(F.col("h").alias("long_h"), F.col("line_key").alias("h")).join(firsts, "h").join(firsts.select(F.col("h").alias("long_h"), F.col("first").alias("long_first")), "long_h")
    long_later = pairs.where(F.col("first") < F.col("long_first")).select(F.col("long_h").alias("h"), F.struct("first", "h").alias("e"))
    long_first = pairs.where(F.col("long_first") < F.col("first")).select("h", F.struct(F.col("long_first").alias("first"), F.col("long_h").alias("h")).alias("e"))
    return by_place.unionByName(long_later).unionByName(long_first).groupBy("h").agg(F.min("e").alias("e")).select("h", F.col("e.h").alias("partner"))


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The h of those pairs whose words are indeed one edit apart and many enough (the longer line counts)."""
    own = pairs.join(texts.select("h", "words"), "h").join(texts.select(F.col("h").alias("partner"), F.col("words").alias("others")), "partner")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [max(len(a), len(b)) >= MIN_WORDS_EDITED and _within_one(list(a), list(b)) for a, b in zip(pdf["words"], pdf["others"], strict=True)]
            yield pdf.loc[ok, ["h"]]

    return own.select("h", "words", "others").mapInPandas(run, "h long")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version, dropped: the sorted line numbers (from 0) of each document that go. Documents that lose none are left out."""
    same = same_lines(docs)
    gone = _lines(docs, False).join(same, "h").where(F.col("near") | (F.struct("doc_id", "line_no", "version") != F.col("first")))
    return gone.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def dedup_lines(docs: DataFrame, annotate: bool = True) -> DataFrame:
    """docs with the lines gone from text, less documents of which nothing but white space is left.

    annotate: keep those documents too, and add the columns lines_dropped (int) and emptied (whether it's one of those); columns of
    these names are replaced. All other columns stay as they are.

    A null or empty text, and a row without doc_id, stays as it is and repeats nothing. Rows with one doc_id and one text are one
    document: its lines are no repeats of each other across those rows. Within a document later repeats go like others.
    Ties don't occur, as (doc_id, line number) is unique but for such rows. An empty table gives no row.
    """
    gone = repeated_lines(docs).withColumnsRenamed({"doc_id": "_gone_doc_id", "version": "_gone_version", "dropped": "_gone"})
    joined = docs.join(gone, (docs["doc_id"].cast("long") == F.col("_gone_doc_id")) & (F.xxhash64(docs["text"]) == F.col("_gone_version")), "left")
    # a transform over one array binds the lines, so that the text is split once
    left = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i)), "\n")
    kept = F.get(F.transform(F.array(F.split("text", "\n", -1)), left), 0)
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
    emptied = F.col("_gone").isNotNull() & F.coalesce(F.trim(F.regexp_replace("text", "\\s+", " ")) == "", F.lit(False))
    if annotate:
        out = out.withColumn("lines_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))).withColumn("emptied", emptied)
    else:
        out = out.where(~emptied)
    return out.drop("_gone_doc_id", "_gone_version", "_gone")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_dropped", "emptied", F.length("text").cast("long").alias("chars_kept"), F.sha2("text", 256).alias("text_sha256"))
