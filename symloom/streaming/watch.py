"""The watch loop as a structured stream: change events in, one delta per non-empty batch out.

Events have file, path and op (upsert or remove); a batch's last word on a symbol counts. State is a table of
(file, path) per batch in the shared folder; a batch that is run again, or after a restart, reads the last state before it and writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import shared_dir
from ..graph import SymbolGraph
from ..sources import extract, persist
from .deltas import symbol_delta

EVENTS = "seq bigint, file string, path string, op string"


class _Stream:
    """What both watches share: states by batch in a folder that outlives the process, and the query."""

    def __init__(self, spark: SparkSession, name: str, on_batch: Callable[[int, DataFrame, object], None]):
        self.spark, self.home, self.on_batch = spark, f"{shared_dir(spark)}/watch-{name}", on_batch
        self.batches_processed, self.query = 0, None

    def _last(self, before: int | None = None) -> str | None:
        """The state of the last finished batch (before that one)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = sorted(int(n[6:]) for n in names if n.startswith("state-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{n}/_DONE")))
        done = [n for n in done if before is None or n < before]
        return f"{self.home}/state-{done[-1]}" if done else None

    def _done(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_DONE")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(where, True).close()

    def _batch(self, rows: DataFrame, batch_id: int) -> None:
        raise NotImplementedError

    def start(self, rows: DataFrame, available_now: bool = True):
        writer = rows.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.home}/checkpoint")
        self.query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
        return self.query

    def cancel(self) -> None:
        if self.query:
            self.query.stop()

    def status(self) -> dict:
        return {"watching": bool(self.query and self.query.isActive), "batches_processed": self.batches_processed}


class Watch(_Stream):
    """on_batch(batch_seq, delta, state) is called after each batch that changes something."""

    def _state(self, before: int | None = None) -> DataFrame:
        last = self._last(before)
        return self.spark.read.parquet(last) if last else self.spark.createDataFrame([], "file string, path string")

    def _batch(self, events: DataFrame, batch_id: int) -> None:
        newest = F.row_number().over(Window.partitionBy("file", "path").orderBy(F.desc("seq")))
        last = events.withColumn("r_", newest).where("r_ = 1").select("file", "path", "op").persist()
        files = last.select("file").distinct()
        old = self._state(batch_id)
        touched = old.join(files, "file", "left_semi")
        new = touched.join(last, ["file", "path"], "left_anti").unionByName(last.where("op = 'upsert'").select("file", "path"))
        path = f"{self.home}/state-{batch_id}"
        old.join(files, "file", "left_anti").unionByName(new).write.mode("overwrite").parquet(path)
        self._done(path)
        delta = symbol_delta(touched, new)
        if not last.isEmpty():
            self.batches_processed += 1
            self.on_batch(self.batches_processed, delta, self._state())
        last.unpersist()


class FileWatch(_Stream):
    """A stream of changed files (path, content; null content: the file is gone): extracts them again, resolves stubs, and keeps the graph.

    on_batch(batch_seq, delta of symbols, graph) is called after each batch that changes something. Of one path in a batch the largest content counts.
    """

    def graph(self, before: int | None = None) -> SymbolGraph:
        last = self._last(before)
        return persist.load(self.spark, last) if last else SymbolGraph.of(self.spark, [], [])

    def _batch(self, files: DataFrame, batch_id: int) -> None:
        one = files.groupBy("path").agg(F.max("content").alias("content")).persist()
        old = self.graph(batch_id)
        new, counts = extract.sync_files(old, one)
        path = f"{self.home}/state-{batch_id}"
        persist.save(new, path)
        self._done(path)
        if not counts.isEmpty():
            self.batches_processed += 1
            mine = lambda g: g.symbols.join(one.select(F.col("path").alias("file")), "file", "left_semi").select("file", "path")
            new = self.graph()
            self.on_batch(self.batches_processed, symbol_delta(mine(old), mine(new)), new)
        one.unpersist()
