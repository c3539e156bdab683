"""What the operators of this subpackage share: table access, checkpoints, graph components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Letters of scripts that write no blanks between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def spaced(text: str) -> str:
    """text with blanks around each letter of an unspaced script, which then counts as a word."""
    return text if text.isascii() or not UNSPACED.search(text) else UNSPACED.sub(r" \g<0> ", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to lower case; every other character as it is."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def with_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir. Only a local session may name none (tests): it gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared checkpoint folder; lost executors don't lose it."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, to be joined by sending it to all tasks if it has so few rows (a few numbers each), so that the other side's texts needn't be shuffled; beyond
    that Spark plans the join. df is counted: have it stored."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc32_mod(col, modulus: int):
    """crc32 of the id's decimal text, modulo: the folds of the contracts."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (id, component) for every id on an edge that
    joins two different ids; component is the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): O(log n) rounds for usual graphs, and edge
    counts never grow. Each round takes the smallest neighbour by a pre-aggregated groupBy, joins it back to the
    edges (a hot node's edges are a join input that adaptive execution can split) and is checkpointed. Nothing is
    gathered on the driver but one fingerprint row a round. Null ends and self loops are ignored. Raises if the
    rounds don't settle.
    """
    e = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
    )
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to u's smallest neighbour (or u, if smaller)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and every smaller neighbour are tied to u's smallest neighbour."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
