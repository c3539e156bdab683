"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero; an error where lengths differ."""
    both = norm(a) * norm(b)
    same = F.size(a) == F.size(b)
    return F.when(same, F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(both, F.lit(0.0)))).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def l1_normalise(a: Column) -> Column:
    """Shares of the sum; a zero vector stays as it is."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.transform(a, lambda x: F.when(total == 0, F.lit(0.0)).otherwise(x / F.nullif(total, F.lit(0.0))))


def discretise(a: Column, k: Column | int, half_even: bool = True) -> Column:
    """Each share rounded to a multiple of 1 / k, as the integer multiple. The batch lane rounds half to even, the query lane half up."""
    k = F.lit(k) if isinstance(k, int) else k
    rounded = F.bround if half_even else F.round
    return F.transform(l1_normalise(a), lambda x: rounded(x * k, 0).cast("long"))


def bucket_key(a: Column, k: Column | int, half_even: bool = True) -> Column:
    return F.array_join(F.transform(discretise(a, k, half_even), lambda x: x.cast("string")), ",")


def entropy(p: Column) -> Column:
    """Aggregate: minus the sum of p log2 p over a group."""
    return -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))
