"""A corpus from raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), does its work on all that its predecessor kept and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, mixing, quality, simhash
from tessera.llm.common import table, with_checkpoint_dir

#: Near-duplicate stage: shingles of five words, of which two texts must share MIN_SIMILARITY (Jaccard); 18 of 64 bits, as pairs of that similarity differ in about 10 and hardly any in more.
SHINGLE_WORDS = 5
MAX_BITS = 18
MIN_SIMILARITY = 0.8
#: Decontamination stage: a shorter item stands in many documents that have nothing to do with the benchmark.
MIN_ITEM_WORDS = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from all of docs, without labels."""
    model = quality.fit(docs)
    return docs.where(quality.score_column(docs, model) >= quality.THRESHOLD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which nothing is left. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, annotate=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs, SHINGLE_WORDS, MAX_BITS, min_similarity=MIN_SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item of MIN_ITEM_WORDS words or more stands go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), min_words=MIN_ITEM_WORDS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken (words, repeats counted)."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: SQL has no counterpart of the learned stage or of the pseudorandom permutations; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # nothing reads the folder before any more
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
