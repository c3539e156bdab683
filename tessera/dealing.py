"""How many tasks rows are dealt to where a task's memory has to stay the same as tables grow."""

from __future__ import annotations

from pyspark.sql import DataFrame

PER_TASK = 4 << 20  # bytes of the files that are read, for each task
SMALL = 256 << 10  # as many tasks as the session runs at once only if each gets this much


def tasks(*frames: DataFrame) -> int:
    """In proportion to the files that the frames are read from. Rows that come from no file count by the session's shuffle partitions."""
    spark, size, least = frames[0].sparkSession, 0, 1
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for i in range(leaves.size()):
            held = int(str(leaves.apply(i).stats().sizeInBytes()))
            if held < 1 << 60:
                size += held
            else:
                least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // PER_TASK), min(spark.sparkContext.defaultParallelism, -(-size // SMALL)))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in that many tasks; adaptive execution doesn't merge them."""
    return df.repartition(tasks(df), *keys)
