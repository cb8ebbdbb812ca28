"""What the operators of this subpackage share: the cluster's shared folder, written tables, word classes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the inside of a character class.
WS = r"\x20\x09-\x0D"
#: The id that ends a document in token output.
END_ID = 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset and driver and executors are one process (as in tests) a local one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="symloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: While recorded() is active, the paths that fresh_path() gives out.
_record: list[str] | None = None


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _record is not None:
        _record.append(path)
    return path


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Notes the tables written inside, so that they can be removed when nothing reads them any more."""
    global _record
    before, _record = _record, paths
    try:
        yield
    finally:
        _record = before


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder and empties the list."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that run inside go when each ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, and survives lost executors. Its shuffle files go at once."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    with tidy(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, [table.written_at])


def body(col: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def local_path(uri: str) -> tuple:
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


#: Rows of a narrow table that may be broadcast; beyond it the join shuffles.
SMALL_ROWS = 1_000_000


def if_small(table: DataFrame, limit: int | None = None) -> DataFrame:
    """A written, narrow table, marked for broadcast if it has at most `limit` rows."""
    return F.broadcast(table) if table.count() <= (SMALL_ROWS if limit is None else limit) else table
