"""Counts over a stored graph: summary, stats, census, freshness, correspondence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo").agg(F.count("*").alias("n_symbols"), F.max("id").alias("last_id"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section, name, n: nodes and edges in all, edges by kind, nodes by repo (null or empty repos left out)."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(name).alias("name"), "n")
    by = lambda df, col, section: df.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    return total(nodes, "nodes").unionByName(total(edges, "edges")).unionByName(by(edges, "kind", "edges_by_kind")).unionByName(by(nodes.where("coalesce(repo, '') <> ''"), "repo", "nodes_by_repo"))


def edge_census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo (of the source), kind, n, relational (all kinds but CONTAINS)."""
    own = edges.join(nodes.select("id", "repo"), edges["src_id"] == nodes["id"])
    return own.groupBy("repo", "kind").agg(F.count("*").alias("n")).withColumn("relational", F.col("kind") != "CONTAINS")


def slices(nodes: DataFrame) -> DataFrame:
    """Distinct (repo, kind) slices, without external boundary nodes."""
    return nodes.where("not (coalesce(file, '') = '')").select("repo", "kind").distinct()


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """file, fresh: whether any stored hash of the file is the current one. Both: (file, hash)."""
    known = stored.groupBy("file").agg(F.collect_set("hash").alias("hashes"))
    return current.join(known, "file", "left").select("file", F.coalesce(F.array_contains("hashes", F.col("hash")), F.lit(False)).alias("fresh"))


def correspondence(graph_files: DataFrame, source_files: DataFrame) -> DataFrame:
    """level (exact, suffix, basename, none), n: at which level each distinct source path meets a path of the graph, by semi joins."""
    mine, theirs = source_files.select("path").distinct(), graph_files.select("path").distinct()
    parts = lambda c: F.split(c, "/")
    tails = theirs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts("path"))), lambda i: F.array_join(F.slice(parts("path"), i, F.size(parts("path"))), "/"))).alias("path")).distinct()
    names = theirs.select(F.element_at(parts("path"), -1).alias("base")).distinct()
    exact, suffix = theirs.withColumn("exact", F.lit(True)), tails.withColumn("suffix", F.lit(True))
    base = names.withColumn("basename", F.lit(True))
    got = mine.withColumn("base", F.element_at(parts("path"), -1)).join(exact, "path", "left").join(suffix, "path", "left").join(base, "base", "left")
    level = F.when(F.col("exact"), "exact").when(F.col("suffix"), "suffix").when(F.col("basename"), "basename").otherwise("none")
    return got.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
