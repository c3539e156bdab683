"""Identifiers, paths, hybrid clocks, dates and canonical JSON, as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of names that say nothing about what is named.
STOPWORDS = ("a", "an", "and", "for", "of", "on", "or", "the", "to", "with")


def identifier_tokens(name: Column) -> Column:
    """Lower-case parts of a camel- or snake-case identifier: runs of capitals are one part but for the last before a small letter; digits are parts."""
    apart = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    apart = F.regexp_replace(apart, "([a-z])([A-Z])", "$1 $2")
    apart = F.regexp_replace(apart, "([A-Za-z])([0-9])", "$1 $2")
    apart = F.regexp_replace(apart, "([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda t: t != "")


def name_tokens(name: Column, least: int = 2) -> Column:
    """Distinct tokens of a name without stopwords and without those shorter than `least`."""
    return F.filter(F.array_distinct(identifier_tokens(name)), lambda t: (F.length(t) >= least) & ~t.isin(*STOPWORDS))


def folded(name: Column) -> Column:
    """A name without case and separators: what two spellings of it share."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def last_segment(qualified_name: Column) -> Column:
    return F.substring_index(qualified_name, "::", -1)


def folder(path: Column, level: int) -> Column:
    """The first `level` folders of a path; fewer where it has fewer."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(level), F.size(parts) - 1)), "/")


def normal_path(path: Column) -> Column:
    """With slashes one way, single, without `./` at the start or a slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(\./)+", ""), "(?<=.)/$", "")


def parameters(signature: Column) -> Column:
    """Names of the parameters in `f(a: T, b = 1)`, in order, without self and cls."""
    inside = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    names = F.transform(F.split(inside, ","), lambda p: F.regexp_extract(p, r"^\s*[*&$.]*([A-Za-z_]\w*)", 1))
    return F.filter(names, lambda n: (n != "") & ~n.isin("self", "cls"))


def doc_arity(doc: Column) -> Column:
    """Number of parameters that a docstring names by `:param x:` or `@param x`; null where it names none."""
    n = F.size(F.regexp_extract_all(doc, F.lit(r"[:@]param\s+\w+"), F.lit(0)))
    return F.when(n > 0, n)


def hlc_parse(text: Column) -> Column:
    """`physical:logical:replica` as a struct that sorts as the clock does; null for another form."""
    parts = F.split(text, ":", 3)
    ok = text.rlike("^[0-9]+:[0-9]+:.+$")
    return F.when(ok, F.struct(F.get(parts, 0).cast("long").alias("physical"), F.get(parts, 1).cast("long").alias("logical"), F.get(parts, 2).alias("replica")))


def hlc_tick(clock: Column, now: Column) -> Column:
    """The clock after a local event at wall time now: it never goes back."""
    later = now > clock["physical"]
    return F.struct(F.greatest(now, clock["physical"]).alias("physical"), F.when(later, F.lit(0).cast("long")).otherwise(clock["logical"] + 1).alias("logical"), clock["replica"].alias("replica"))


def hlc_receive(clock: Column, other: Column, now: Column) -> Column:
    """The clock after a message stamped `other` arrives at wall time now."""
    top = F.greatest(now, clock["physical"], other["physical"])
    mine, theirs = clock["physical"] == top, other["physical"] == top
    logical = F.when(mine & theirs, F.greatest(clock["logical"], other["logical"]) + 1).when(mine, clock["logical"] + 1).when(theirs, other["logical"] + 1).otherwise(F.lit(0).cast("long"))
    return F.struct(top.alias("physical"), logical.alias("logical"), clock["replica"].alias("replica"))


def iso_time(text: Column) -> Column:
    """Microseconds of an ISO date or date and time (taken as UTC without a zone); null for another form."""
    return F.unix_micros(F.try_to_timestamp(text))


def saturate(x: Column, at: float) -> Column:
    """1 - e^(-x / at)."""
    return 1 - F.exp(-x / at)


def normalised_entropy(bits: Column, n: Column) -> Column:
    """Entropy over its largest value for n classes; 0 for one class."""
    return F.when(n <= 1, F.lit(0.0)).otherwise(bits / F.log2(n))


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks, so that equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_map(m: Column) -> Column:
    """A map of strings as canonical JSON."""
    pairs = F.array_sort(F.map_entries(m))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","), F.lit("}"))
