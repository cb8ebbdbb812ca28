"""A graph on disk: a base snapshot and a journal of replaced files, compacted when it grows. All Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import file_of
from ..graph import SymbolGraph

COMPACT_AT = 500


def save(graph: SymbolGraph, path: str) -> None:
    graph.base_nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> SymbolGraph:
    return SymbolGraph(spark.read.parquet(f"{path}/nodes"), spark.read.schema("src string, dst string, kind string").parquet(f"{path}/edges"))


def append(path: str, seq: int, file: str, new: SymbolGraph) -> None:
    """One journal record: what the file holds from now on (nothing: it is gone)."""
    spark = new.spark
    spark.createDataFrame([(seq, file)], "seq bigint, owner string").write.mode("append").parquet(f"{path}/records")
    new.base_nodes.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").partitionBy("seq").parquet(f"{path}/journal_nodes")
    new.edges.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").partitionBy("seq").parquet(f"{path}/journal_edges")


def latest(records: DataFrame) -> DataFrame:
    """owner, seq of each file's last record."""
    return records.withColumn("r_", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("seq")))).where("r_ = 1").select("owner", "seq")


def replay(base: SymbolGraph, records: DataFrame, nodes: DataFrame, edges: DataFrame) -> SymbolGraph:
    """The base with every journalled file as its last record has it; inbound edges to what is left stay."""
    last = latest(records)
    named = nodes.join(F.broadcast(last), "seq").withColumn("file", file_of(F.col("path")))  # journal records are few: compact() sees to that
    own = named.where("file = owner")
    far = named.where("file <> owner").join(F.broadcast(last.select(F.col("owner").alias("file"))), "file", "left_anti")
    new_nodes = own.select("path", "node_kind", "span").unionByName(far.select("path", "node_kind", "span")).dropDuplicates(["path"])
    new_edges = edges.join(F.broadcast(last), "seq").where(file_of(F.col("src")) == F.col("owner")).select("kind", "src", "dst").distinct()
    return base.replace_files(last.select(F.col("owner").alias("file")), SymbolGraph(new_nodes, new_edges))


def load_with_journal(spark: SparkSession, path: str) -> SymbolGraph:
    base = load(spark, path)
    try:
        records = spark.read.parquet(f"{path}/records")
    except Exception as e:  # no journal yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return base
    nodes = spark.read.schema(base.base_nodes.withColumn("seq", F.lit(0).cast("long")).schema).parquet(f"{path}/journal_nodes")
    edges = spark.read.schema("kind string, src string, dst string, seq bigint").parquet(f"{path}/journal_edges")
    return replay(base, records, nodes, edges)


def compact(spark: SparkSession, path: str, into: str, at: int = COMPACT_AT) -> bool:
    """Writes base and journal as a new snapshot elsewhere once there are `at` records; the caller switches over to it."""
    if spark.read.parquet(f"{path}/records").count() < at:
        return False
    save(load_with_journal(spark, path), into)
    return True


