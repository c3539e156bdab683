"""Typed one-hop queries, symbol resolution, snapshot diff, search.

Every function takes and returns DataFrames with the columns of tessera.schema (or the subset that it names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.dealing import tasks
from tessera.schema import EDGE_KINDS

CALLER_KINDS = ("CALLS", "REFERENCES")
IMPLEMENTER_KINDS = ("IMPLEMENTS", "EXTENDS")
MAX_ROWS = 500
ENVELOPE = ("id", "kind", "repo", "qualified_name", "short_name", "file")


def all_of(*conditions: Column | None) -> Column:
    """Those of the optional conditions that are given, and-ed."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def resolve(nodes: DataFrame, ref: str, sha: str | None = None) -> DataFrame:
    """The one symbol that ref names by id or qualified name; of several the smallest id. One row or none: id."""
    named = all_of((F.col("id") == ref) | (F.col("qualified_name") == ref), None if sha is None else F.col("repo_commit_sha") == sha)
    return nodes.where(named).agg(F.min("id").alias("id")).where("id is not null")


def neighbors(nodes: DataFrame, edges: DataFrame, ref: str, direction: str = "both", kinds: tuple[str, ...] = EDGE_KINDS, limit: int = MAX_ROWS, sha: str | None = None) -> DataFrame:
    """Neighbours of a symbol: edge_kind, direction, then the envelope. At most limit rows of a kind and direction and in all, in the
    order of kinds, out before in, then id. Parallel edges give a row each. sha holds for the neighbour."""
    if direction not in ("in", "out", "both"):
        raise ValueError(f"direction: {direction}")
    limit = max(0, min(limit, MAX_ROWS))
    seed = F.broadcast(resolve(nodes, ref, sha).withColumnRenamed("id", "seed"))  # one row at most
    wanted = edges.where(F.col("kind").isin(*kinds))
    sides = []
    if direction in ("out", "both"):
        sides.append(wanted.join(seed, F.col("src_id") == F.col("seed")).select(F.col("kind").alias("edge_kind"), F.lit("out").alias("direction"), F.col("dst_id").alias("other")))
    if direction in ("in", "both"):
        sides.append(wanted.join(seed, F.col("dst_id") == F.col("seed")).select(F.col("kind").alias("edge_kind"), F.lit("in").alias("direction"), F.col("src_id").alias("other")))
    met = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    others = nodes if sha is None else nodes.where(F.col("repo_commit_sha") == sha)
    rows = met.join(others.select(*ENVELOPE), met["other"] == others["id"]).drop("other")
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("edge_kind"))
    order = [place, F.col("direction").desc(), F.col("id")]
    per_kind = rows.withColumn("rn", F.row_number().over(Window.partitionBy("edge_kind", "direction").orderBy("id")))
    return per_kind.where(F.col("rn") <= limit).orderBy(*order).limit(limit).drop("rn")


def callers(nodes: DataFrame, edges: DataFrame, ref: str, limit: int = MAX_ROWS, sha: str | None = None) -> DataFrame:
    return neighbors(nodes, edges, ref, "in", CALLER_KINDS, limit, sha)


def implementers(nodes: DataFrame, edges: DataFrame, ref: str, limit: int = MAX_ROWS, sha: str | None = None) -> DataFrame:
    return neighbors(nodes, edges, ref, "in", IMPLEMENTER_KINDS, limit, sha)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """qualified_name, status: added, removed, changed (ast_hash differs; null equals null) or unchanged. Of several rows
    of a name in a snapshot the one with the largest id counts."""
    one = lambda df, name: df.groupBy("qualified_name").agg(F.max_by("ast_hash", "id").alias(name), F.lit(True).alias(f"has_{name}"))
    both = one(before, "a").join(one(after, "b"), "qualified_name", "full_outer")
    status = F.when(F.col("has_a").isNull(), "added").when(F.col("has_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("unchanged")
    return both.select("qualified_name", status.alias("status"))


def code_search(tokens: DataFrame, text: str, kind: str | None = None, limit: int = 50, repo: str | None = None) -> DataFrame:
    """Tokens that hold the text, case ignored; fewer than two characters find nothing. All filters come before the limit."""
    limit = max(0, min(limit, MAX_ROWS))
    if len(text) < 2:
        return tokens.limit(0)
    found = tokens.where(all_of(F.lower("text").contains(text.lower()), None if kind is None else F.col("kind") == kind, None if repo is None else F.col("repo") == repo))
    return found.orderBy("symbol_id", "pos").limit(limit)


def load_graph(nodes: DataFrame, edges: DataFrame, repos: list[str] | None = None, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the given repos, and the edges whose ends are both among them; of repeats of (src, dst, kind) one stays, that with the
    largest count."""
    n = nodes if repos is None else nodes.where(F.col("repo").isin(*repos))
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    ids = n.select("id")
    e = e.join(ids, e["src_id"] == ids["id"], "left_semi").join(ids, F.col("dst_id") == ids["id"], "left_semi")
    return n, e.groupBy("src_id", "dst_id", "kind").agg(F.max("count").alias("count"))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, dropped: edges that a bulk load leaves out, as an end isn't there."""
    ids = nodes.select("id")
    a = edges.join(ids, edges["src_id"] == ids["id"], "left_anti")
    b = edges.join(ids, edges["src_id"] == ids["id"], "left_semi").join(ids, F.col("dst_id") == ids["id"], "left_anti")
    return a.select("kind").unionByName(b.select("kind")).groupBy("kind").agg(F.count("*").alias("dropped"))


def insert_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and those of new whose ends are both nodes; the others are left out (dangling_edges counts them)."""
    n = tasks(nodes, new)
    ids = nodes.select("id").repartition(n, "id")
    met = new.repartition(n, "src_id").join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi")
    met = met.repartition(n, "dst_id").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return edges.unionByName(met.select(*edges.columns))


def upsert_symbols(lanes: list[DataFrame], keep_structural: bool = True) -> DataFrame:
    """Lanes of symbols in the order in which they are written, merged by id: the last lane wins, but for the five structural columns (where
    present), which stay as the first lane that knows them has them."""
    structural = ("signature", "visibility", "is_abstract", "is_static", "ast_hash") if keep_structural else ()
    rows = lanes[0].withColumn("lane", F.lit(0))
    for k, lane in enumerate(lanes[1:], 1):
        rows = rows.unionByName(lane.withColumn("lane", F.lit(k)), allowMissingColumns=True)
    cols = [c for c in rows.columns if c not in ("id", "lane")]
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("lane"))) if c in structural else F.max_by(c, "lane")
    return rows.groupBy("id").agg(*[pick(c).alias(c) for c in cols])


def merge_append(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't in new, and new; columns by name."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def top_k(df: DataFrame, metric: str, k: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.col(metric).desc(), key).limit(k)
