"""Licence scan: ordered signature rules behind a keyword prefilter, with containment suppression.

Everything is a DataFrame expression on one row: no join, no shuffle, whole texts. A text is normalised to words parted by single
blanks. A rule's regular expression runs only where its keyword stands in the text; keywords are looked for once for
all rules that share them, and only where the text holds what all of their patterns need. Each match is an interval of words. Matches are sorted by start, longer ones first, and swept
once: a match that lies inside another of the same or an earlier tier is suppressed.

Sums and maxima that run along a text's matches are taken by chunks of CHUNK, so that a text with very many matches costs little more than
its length.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, table
from tessera.llm.license_rules import Rule, rules

#: ASCII but for digits and letters; what parts words.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CHUNK = 64

HIT = "struct<first: int, last: int, tier: int, rank: int, label: string, confidence: double, base: boolean>"
GROUPS = "array<struct<gate: string, groups: array<struct<keyword: string, rules: array<struct<rank: int, tier: int, label: string, pattern: string, confidence: double, base: boolean>>>>>>"


def _lowered(text: Column) -> Column:
    """Lower case. Which case letters beyond ASCII have doesn't matter here, as no rule holds one, but the two that become ASCII letters in lower
    case must stay what they are."""
    turns_ascii = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(turns_ascii, ascii_lower(text)).otherwise(F.lower(text))


def normalise(text: Column) -> Column:
    """" word word ... word ", or one blank if there's no word."""
    inner = F.trim(F.regexp_replace(_lowered(F.coalesce(text, F.lit(""))), BREAKS, " "))
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _blanks(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))


def _bound(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), 0)


def _chunks(items: Column) -> Column:
    """items, an array, as an array of arrays of CHUNK."""
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))
    return _bound(items, lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(F.filter(F.array(xs), lambda _: F.lit(False))))


def _before(values: Column, start: Column, step) -> Column:
    """For each value what step has made of start and the values before it."""
    state = F.struct(start.alias("now"), F.filter(F.array(start), lambda _: F.lit(False)).alias("seen"))
    return F.aggregate(values, state, lambda s, x: F.struct(step(s["now"], x).alias("now"), F.array_append(s["seen"], s["now"]).alias("seen")))["seen"]


def _matches(norm: Column, rule: Column) -> Column:
    """All matches of one rule, as intervals of words. The text before the nth match is the pieces and matches before it."""
    pieces, found = F.split(norm, rule["pattern"], -1), F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    # of each match: blanks in the piece before it, blanks in itself
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), found, lambda p, m: F.struct(_blanks(p).alias("gap"), _blanks(m).alias("own")))
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x["gap"] + x["own"])

    def placed(part: Column, seen: Column) -> Column:
        start = F.struct(seen.alias("seen"), F.lit([]).cast(f"array<{HIT}>").alias("hits"))
        return F.aggregate(part, start, lambda s, x: _step(s, x, rule))["hits"]

    return _bound(_chunks(steps), lambda parts: F.flatten(F.zip_with(parts, _before(F.transform(parts, total), F.lit(0), lambda s, x: s + x), placed)))


def _step(s: Column, x: Column, rule: Column) -> Column:
    first = s["seen"] + x["gap"] - 1  # the text begins with a blank
    hit = F.struct(first.alias("first"), (first + x["own"]).alias("last"), *[rule[k].alias(k) for k in ("tier", "rank", "label", "confidence", "base")])
    return F.struct((s["seen"] + x["gap"] + x["own"]).alias("seen"), F.array_append(s["hits"], hit).alias("hits"))


def detections(norm: Column, own: list[Rule]) -> Column:
    """Array of HIT: every match of every rule whose keyword the text holds."""
    gates: dict[str, dict[str, list[dict]]] = {}
    for r in own:
        gates.setdefault(r.gate, {}).setdefault(r.keyword, []).append({"rank": r.rank, "tier": r.tier, "label": r.label, "pattern": r.pattern, "confidence": r.confidence, "base": r.base})
    made = [{"gate": g, "groups": [{"keyword": k, "rules": rs} for k, rs in by_keyword.items()]} for g, by_keyword in gates.items()]
    literal = F.from_json(F.lit(json.dumps(made)), GROUPS)  # one literal
    opened = F.filter(literal, lambda x: F.contains(norm, x["gate"]))
    near = F.filter(F.flatten(F.transform(opened, lambda x: x["groups"])), lambda g: F.contains(norm, g["keyword"]))
    tried = F.filter(F.flatten(F.transform(near, lambda g: g["rules"])), lambda r: F.rlike(norm, r["pattern"]))
    return F.flatten(F.transform(tried, lambda r: _matches(norm, r)))


def unsuppressed(hits: Column, tiers: int) -> Column:
    """hits without those inside another of the same or an earlier tier; of equal intervals the earliest rule stays.

    In the order (first, longest, rank) a match lies inside an earlier one just if the furthest end so far, of its tier or an
    earlier one, reaches its own end. Equal intervals of different tiers: the earlier tier comes first.
    """
    ordered = F.transform(
        F.array_sort(F.transform(hits, lambda h: F.struct(h["first"].alias("first"), (-h["last"]).alias("minus_last"), h["rank"].alias("rank"), h.alias("hit")))),
        lambda x: x["hit"],
    )
    none = F.array(*[F.lit(-1)] * tiers)
    further = lambda ends, h: F.transform(ends, lambda e, i: F.when((i == h["tier"]) & (h["last"] > e), h["last"]).otherwise(e))
    inside = lambda ends, h: F.array_max(F.slice(ends, F.lit(1), h["tier"] + 1)) >= h["last"]
    # a suppressed match lies inside another whose tier is no later, so whether it moves its own tier's end doesn't matter to what follows
    furthest = lambda part: F.aggregate(part, none, further)
    both = lambda ends, more: F.zip_with(ends, more, lambda x, y: F.greatest(x, y))

    def kept(part: Column, ends: Column) -> Column:
        start = F.struct(ends.alias("ends"), F.lit([]).cast(f"array<{HIT}>").alias("kept"))
        return F.aggregate(part, start, lambda s, h: F.struct(further(s["ends"], h).alias("ends"), F.when(inside(s["ends"], h), s["kept"]).otherwise(F.array_append(s["kept"], h)).alias("kept")))["kept"]

    return _bound(_chunks(ordered), lambda parts: F.flatten(F.zip_with(parts, _before(F.transform(parts, furthest), none, both), kept)))


def scan(docs: DataFrame, own: list[Rule] | None = None) -> DataFrame:
    """doc_id, norm, hits (every match; array of first word, last word, tier, rank, label, confidence, base) and detections (those that aren't
    suppressed, sorted by first word).

    A null text is an empty one and has no detection; a text of any length is scanned whole. Repeated rows come back as often as they came in,
    extra columns are ignored, an empty table gives no row. Ties between rules on one interval go to the earlier rule.
    """
    own = rules() if own is None else own
    tiers = 1 + max(r.tier for r in own)
    normal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalise(F.col("text")).alias("norm"))
    return normal.withColumn("hits", detections(F.col("norm"), own)).withColumn("detections", unsuppressed(F.col("hits"), tiers))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    based = found.select("doc_id", "detections", _blanks(F.col("norm")).alias("blanks"), F.filter("hits", lambda h: h["base"]).alias("base"))
    at = F.transform("base", lambda h: h["first"])
    labels = lambda hits: F.transform(hits, lambda h: h["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return based.select(
        "doc_id",
        (F.col("blanks") - 1).cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.concat(labels("base"), labels("detections"))).alias("labels"),
        F.aggregate(F.concat("base", "detections"), F.lit(0.0), lambda s, d: F.greatest(s, d["confidence"])).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
