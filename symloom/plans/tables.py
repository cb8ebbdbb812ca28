"""Written tables: how lineage is cut and iterative results are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast; beyond it joins shuffle.
SMALL_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder all executors share. Only where it is unset and driver and executors are one process, as in tests, a local one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="symloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a table in the shared folder, read back: no lineage, and nothing to lose with an executor. Its shuffle files go at once."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def if_small(table: DataFrame, limit: int | None = None) -> DataFrame:
    """A written or cached narrow table, marked for broadcast only if it has few rows."""
    return F.broadcast(table) if table.count() <= (SMALL_ROWS if limit is None else limit) else table


class Rounds:
    """Keeps the tables of an iteration: each is written, so that a round's plan never holds the rounds before it."""

    def __init__(self, what: str = "round"):
        self.what = what

    def keep(self, df: DataFrame) -> DataFrame:
        return written(df, self.what)
