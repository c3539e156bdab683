"""Composition of roles within modules: paths, fan-in, broken laws, unit-like roles.

typed: (src_id, dst_id, kind, module, src_role, dst_role): edges within a module, none of CONTAINS, no self-loops, both ends with a role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SUPPORT = 2


def typed_edges(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """roles: (id, module, role)."""
    a = roles.select(F.col("id").alias("src_id"), "module", F.col("role").alias("src_role"))
    b = roles.select(F.col("id").alias("dst_id"), F.col("module").alias("dst_module"), F.col("role").alias("dst_role"))
    met = edges.where((F.col("kind") != "CONTAINS") & (F.col("src_id") != F.col("dst_id"))).join(a, "src_id").join(b, "dst_id")
    return met.where(F.col("module") == F.col("dst_module")).select("src_id", "dst_id", "kind", "module", "src_role", "dst_role").distinct()


def path_ops(typed: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Recurring paths of one or two edges: roles, kinds, length, support (distinct node tuples).

    Two-edge paths are counted through their middle node: in-edges times out-edges, less the paths that return to their start.
    """
    one = typed.groupBy(F.concat_ws(">", "src_role", "dst_role").alias("roles"), F.col("kind").alias("kinds")).agg(F.count("*").alias("support")).withColumn("length", F.lit(1))
    into = typed.groupBy(F.col("dst_id").alias("mid"), "module", F.col("dst_role").alias("mid_role"), F.col("src_role").alias("a"), F.col("kind").alias("k1")).agg(F.count("*").alias("n1"))
    out = typed.groupBy(F.col("src_id").alias("mid"), "module", F.col("dst_role").alias("c"), F.col("kind").alias("k2")).agg(F.count("*").alias("n2"))
    key = [F.concat_ws(">", "a", "mid_role", "c").alias("roles"), F.concat_ws(">", "k1", "k2").alias("kinds")]
    through = into.join(out, ["mid", "module"]).groupBy(*key).agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))
    x, y = typed.alias("x"), typed.alias("y")
    back = x.join(y, (F.col("x.src_id") == F.col("y.dst_id")) & (F.col("x.dst_id") == F.col("y.src_id")) & (F.col("x.module") == F.col("y.module"))).groupBy(
        F.concat_ws(">", "x.src_role", "x.dst_role", "y.dst_role").alias("roles"), F.concat_ws(">", "x.kind", "y.kind").alias("kinds")
    ).agg(F.count("*").alias("r"))
    two = through.join(back, ["roles", "kinds"], "left").select("roles", "kinds", (F.col("n") - F.coalesce("r", F.lit(0))).alias("support"), F.lit(2).alias("length"))
    return one.select("roles", "kinds", "support", "length").unionByName(two).where(F.col("support") >= min_support)


def fan_in_ops(typed: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Sets of two or more roles, other than the target's own, that meet at targets of a role: output_role, input_roles, kinds, support (targets)."""
    per = typed.where(F.col("src_role") != F.col("dst_role")).groupBy("dst_id", "module", "dst_role").agg(F.sort_array(F.collect_set("src_role")).alias("ins"), F.sort_array(F.collect_set("kind")).alias("ks")).where(F.size("ins") >= 2)
    return per.groupBy(F.col("dst_role").alias("output_role"), F.array_join("ins", ",").alias("input_roles"), F.array_join("ks", ",").alias("kinds")).agg(F.count("*").alias("support")).where(F.col("support") >= min_support)


def generators(typed: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """i, j, support: pairs of roles with recurring edges."""
    return typed.groupBy(F.col("src_role").alias("i"), F.col("dst_role").alias("j")).agg(F.count("*").alias("support")).where(F.col("support") >= min_support)


def violations(gen: DataFrame) -> DataFrame:
    """kind, roles, support: missing_composite (i>j and j>k recur, i>k doesn't; i, j, k different) and back_call_cycle (i>j and j>i)."""
    x, y = gen.alias("x"), gen.alias("y")
    two = x.join(y, F.col("x.j") == F.col("y.i")).select(F.col("x.i").alias("i"), F.col("x.j").alias("m"), F.col("y.j").alias("j"), F.least("x.support", "y.support").alias("support"))
    two = two.where((F.col("i") != F.col("m")) & (F.col("m") != F.col("j")) & (F.col("i") != F.col("j")))
    missing = two.join(gen.select("i", "j"), ["i", "j"], "left_anti").select(F.lit("missing_composite").alias("kind"), F.concat_ws(">", "i", "m", "j").alias("roles"), "support")
    cycle = x.join(y, (F.col("x.i") == F.col("y.j")) & (F.col("x.j") == F.col("y.i"))).where(F.col("x.i") < F.col("x.j")).select(F.lit("back_call_cycle").alias("kind"), F.concat_ws(">", "x.i", "x.j").alias("roles"), F.least("x.support", "y.support").alias("support"))
    return missing.unionByName(cycle)


def unit_like(gen: DataFrame) -> DataFrame:
    """role, n: roles R with A>R>B where A>B recurs too; n counts the pairs (A, B)."""
    x, y = gen.where("i <> j").alias("x"), gen.where("i <> j").alias("y")
    two = x.join(y, F.col("x.j") == F.col("y.i")).select(F.col("x.i").alias("i"), F.col("x.j").alias("role"), F.col("y.j").alias("j")).where("i <> j")
    return two.join(gen.select("i", "j"), ["i", "j"], "left_semi").groupBy("role").agg(F.count_distinct("i", "j").alias("n"))
