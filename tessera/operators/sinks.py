"""What writers do to a table: replace, delete, append, merge. Each takes and returns DataFrames; `write_slices` stores one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.cards import last_of


def without_nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls in these text columns become empty texts, as a round trip through CSV makes them."""
    return rows.fillna("", subset=columns)


def replace_slice(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored with the slices (by key) that new holds replaced by its rows."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of these files (repo, file) and the edges at them, those from other files too."""
    gone = nodes.join(files.select("repo", "file").distinct(), ["repo", "file"], "left_semi").select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def append_once(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored and those rows of new whose key isn't there; of several in new the one with the smallest values."""
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("_r")).select(key, "_r.*")
    return stored.unionByName(first.join(stored.select(key), key, "left_anti"), allowMissingColumns=True)


def latest(history: DataFrame, key: list[str], order: str) -> DataFrame:
    """An append-only history seen as one record for each key: the newest."""
    return last_of(history, key, order)


def merged_manifest(old: dict, new: dict) -> dict:
    """The old manifest with what the new one sets; fields that the new one doesn't know stay, at every depth."""
    return {k: merged_manifest(old[k], new[k]) if isinstance(old.get(k), dict) and isinstance(new.get(k), dict) else new.get(k, old.get(k)) for k in [*old, *[k for k in new if k not in old]]}


def write_slices(rows: DataFrame, path: str, by: list[str]) -> None:
    """Stores rows so that only the partitions they hold are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_artifact(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Stores just these columns, in this order."""
    rows.select(*columns).write.mode("overwrite").parquet(path)
