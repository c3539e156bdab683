"""Folds over event logs that don't depend on the order of arrival.

Events: key, t (effective time), hlc (struct, ordered as structs are), kind, value, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATES = ("count_regardless", "require_confirmed", "pending_only")


def gate(status: Column, how: str) -> Column:
    """Whether an event of this status counts in a projection with this gate."""
    if how not in GATES:
        raise ValueError(f"gate: {how}")
    return {"count_regardless": F.lit(True), "require_confirmed": status == "done", "pending_only": status != "done"}[how]


def fold_balance(events: DataFrame, as_of: int | None = None, how: str = "require_confirmed") -> DataFrame:
    """key, balance as of a time: the last reset in (t, hlc) order sets it, later increments add, decrements subtract.

    Two aggregations on the key, both pre-aggregated: the last reset of each key, then the sum of what comes after it. The
    reset's own value is joined, no list of events is built. A key without counted events has no row.
    """
    live = events.where(gate(F.col("status"), how) & F.col("kind").isin("reset", "increment", "decrement"))
    if as_of is not None:
        live = live.where(F.col("t") <= as_of)
    at = F.struct("t", "hlc")
    last = live.where("kind = 'reset'").groupBy("key").agg(F.max(F.struct(at.alias("at"), F.col("value").alias("value"))).alias("reset"))
    delta = F.when(F.col("kind") == "increment", F.col("value")).when(F.col("kind") == "decrement", -F.col("value")).otherwise(0)
    later = F.col("reset").isNull() | (at > F.col("reset.at"))
    summed = live.join(last, "key", "left").groupBy("key").agg(F.sum(F.when(later, delta).otherwise(0)).alias("delta"), F.max("reset.value").alias("base"))
    return summed.select("key", (F.coalesce("base", F.lit(0)) + F.col("delta")).alias("balance"))


def fold_reduce(events: DataFrame, init: Column, step, as_of: int | None = None) -> DataFrame:
    """key, state: any fold over a key's events in (t, hlc) order: step(state, event) gives the next state. Builds each key's list, so
    it's for folds that no aggregate can express."""
    live = events if as_of is None else events.where(F.col("t") <= as_of)
    listed = live.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "hlc", "kind", "value", "status"))).alias("es"))
    return listed.select("key", F.aggregate("es", init, step).alias("state"))


def pick(events: DataFrame, by: list[str], value: str, latest: bool = True) -> DataFrame:
    """Last (or first) writer wins: the value at the largest (smallest) hlc of each group."""
    f = F.max_by if latest else F.min_by
    return events.groupBy(*by).agg(f(value, "hlc").alias(value), (F.max if latest else F.min)("hlc").alias("hlc"))


def demote(events: DataFrame, by: list[str]) -> DataFrame:
    """Adds role: fact for the earliest of each group by hlc, observation for the others."""
    first = Window.partitionBy(*by)
    return events.withColumn("role", F.when(F.col("hlc") == F.min("hlc").over(first), "fact").otherwise("observation"))


def gset_merge(replicas: list[DataFrame]) -> DataFrame:
    """Union of grow-only sets keyed by hlc; of different values at one hlc the smaller stays. Idempotent and order-free."""
    out = replicas[0]
    for r in replicas[1:]:
        out = out.unionByName(r)
    return out.groupBy("hlc").agg(F.min("value").alias("value"))


def newest_as_of(events: DataFrame, value: str, as_of: int) -> DataFrame:
    """key, value of the newest record that is done and not after as_of; ties by event id."""
    return events.where((F.col("status") == "done") & (F.col("t") <= as_of)).groupBy("key").agg(F.max_by(value, F.struct("t", "event_id")).alias(value))


def order_sensitive(events: DataFrame) -> DataFrame:
    """key, t, n: where two or more writes fall on one effective time, so that their order decides."""
    return events.groupBy("key", "t").agg(F.count("*").alias("n")).where("n > 1")


def unknown_kinds(batch: DataFrame, known: list[str]) -> DataFrame:
    """kind, n of the events that make a whole batch be refused; empty if it may be appended."""
    return batch.where(~F.coalesce(F.col("kind").isin(*known), F.lit(False))).groupBy("kind").agg(F.count("*").alias("n"))
