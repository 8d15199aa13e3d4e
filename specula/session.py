"""Session helpers: the shared checkpoint folder and sizes that follow the session."""

from __future__ import annotations

import math
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


TASK_ROWS = 1_000_000  # rows that a task is given to sort or to group


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def settle_round(df: DataFrame) -> DataFrame:
    """``settle`` for a table that a loop joins in every round.

    A checkpoint passes its plan's estimated size on, and joins multiply these: after a dozen rounds the
    driver would plan with numbers of millions of digits. Rows that are held have their measured size.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    held.count()
    out = settle(held.select("*"))
    held.unpersist()
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by the hash of ``keys`` in tasks of about ``TASK_ROWS``, before a join or a grouping that meets ``rows``.

    Spark judges a task by its compressed bytes, and short texts that resemble each other are millions of rows then. Rows
    are dealt before they are grouped, so that no reading task holds a table of all its keys. Few rows are left to Spark.
    """
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(shuffle_width(df.sparkSession), math.ceil(rows / TASK_ROWS)), *keys)
