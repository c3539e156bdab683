"""Readers and writers of graph exports, artifacts and ledgers. Paths go to Spark's readers alone, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schema import EDGE, SYMBOL


def read_export(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON-lines export, in directory/ctkr/export or else in directory; schemas are given, never inferred."""
    jvm = spark.sparkContext._jvm
    for base in (f"{directory}/ctkr/export", directory):
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/nodes.jsonl")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(SYMBOL).json(f"{base}/nodes.jsonl"), spark.read.schema(EDGE).json(f"{base}/edges.jsonl")
    raise FileNotFoundError(f"no nodes.jsonl in {directory} or {directory}/ctkr/export")


def write_export(nodes: DataFrame, edges: DataFrame, directory: str) -> None:
    """JSON lines; null fields are left out, so that count stands on counted kinds only."""
    nodes.write.mode("overwrite").json(f"{directory}/nodes.jsonl")
    edges.write.mode("overwrite").json(f"{directory}/edges.jsonl")


def read_ledger(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of an append-only JSON-lines ledger with line_file and malformed; blank lines and lines that begin with // are skipped."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kept = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("line_file"), F.trim("value").alias("line")).where("line <> '' and not startswith(line, '//')")
    parsed = lines.withColumn("row", F.from_json("line", kept, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    return parsed.select("line_file", *[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields], F.col("row._bad").isNotNull().alias("malformed"))


def replace_slice(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrites only the partitions (by keys) that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_artifact(spark: SparkSession, path: str, manifest: dict, flag: str) -> DataFrame:
    """A Parquet artifact, if the manifest says that it's there."""
    if not manifest.get(flag):
        raise FileNotFoundError(f"{path}: the manifest doesn't have {flag}")
    return spark.read.parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines with just these columns and types, never inferred; what a line lacks is null."""
    return spark.read.schema(schema).json(path)


def read_packs(spark: SparkSession, root: str, schema: str, name: str = "fixtures.jsonl", key: str = "fixture_id") -> DataFrame:
    """Rows of all files of this name below root, each key once: that of the first path counts."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root).withColumn("path", F.col("_metadata.file_path"))
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "path").alias("r")).select(key, "r.*")
