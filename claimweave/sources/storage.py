"""Tables written between the steps of a flow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# A task that makes rows makes at most so many, and few tasks make few rows.
MOST_ROWS_PER_TASK = 1_000_000
LEAST_ROWS_PER_TASK = 5_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local session without one uses its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/written"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table that later steps read several times, and read it back.

    Its lineage is cut, it outlives lost executors, and readers get columnar pruning.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    # The schema is given, as a table without rows may have no files to take it from.
    return spark.read.schema(df.schema).parquet(path)


def numbered_rows(spark: SparkSession, n: int, name: str = "id") -> DataFrame:
    """Rows 0 to n - 1 to make a table from, in tasks whose number grows with n."""
    cores = spark.sparkContext.defaultParallelism
    tasks = max(-(-n // MOST_ROWS_PER_TASK), min(cores, -(-n // LEAST_ROWS_PER_TASK)), 1)
    return spark.range(0, n, 1, tasks).withColumnRenamed("id", name)


# Tasks that an input of a few splits is spread over at most.
MOST_SPREAD = 32


def spread(df: DataFrame) -> DataFrame:
    """Let idle cores share an input that comes in fewer splits than there are cores.

    An input of many splits, as any large one is, is left as it is and not shuffled.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, MOST_SPREAD)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
