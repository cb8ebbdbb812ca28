"""Graphs by number: paths as whole numbers in the order of the paths, so that the least number is the least path.

Iterations go over numbers: a round moves 8 bytes a node. Their joins are marked so that no side is ever broadcast,
which would collect it on the driver: `apart` marks a table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def apart(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides, however small they are."""
    return df.hint("merge")


class Numbers:
    """ids: path, id from 0 without gaps, known (whether it is a node) of nodes and edges' ends; links: the edges by number (src, dst). Both are written."""

    def __init__(self, ids: DataFrame, links: DataFrame):
        self.ids, self.links, self._ways = ids, links, {}

    def of(self, *paths: str) -> DataFrame:
        """path: the numbers of those that are there."""
        return self.ids.where(F.col("path").isin(*paths)).select(F.col("id").alias("path"))

    def way(self, back: bool = False) -> DataFrame:
        """The links, or their reverse, kept by source."""
        if back not in self._ways:
            links = self.links if not back else self.links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            self._ways[back] = kept_by(links, "src")
        return self._ways[back]

    def between_nodes(self) -> DataFrame:
        """The links both of whose ends are nodes."""
        if self.ids.where("NOT known").isEmpty():
            return self.links
        known = lambda end: apart(self.ids.where("known").select(F.col("id").alias(end)))
        return self.links.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi").select("src", "dst")


def numbered(paths: DataFrame, edges: DataFrame) -> Numbers:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path"), F.lit(False).alias("known"))
    every = paths.select("path", F.lit(True).alias("known")).unionByName(ends).groupBy("path").agg(F.max("known").alias("known"))
    ids = written(ranked(every, "id", "path").select("path", (F.col("id") - 1).alias("id"), "known"), "ids")
    at = lambda end: apart(ids.select(F.col("path").alias(end), F.col("id").alias(f"{end}_id")))
    links = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst")
    return Numbers(ids, written(links.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), "links"))


def named(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """df with the paths of these columns' numbers in their place."""
    for c in columns:
        df = df.join(apart(ids.select(F.col("id").alias(c), F.col("path").alias("path_"))), c).withColumn(c, F.col("path_")).drop("path_")
    return df


def kept_by(df: DataFrame, column: str) -> DataFrame:
    """df cached in shuffled and sorted order of a column: joins on it move only the other side."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, column).sortWithinPartitions(column).persist()


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """df with its place from 1 in a total order, without taking all rows into one task."""
    part = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), "ranked")
    block = F.shiftright("at_", 33)
    sizes, before = sorted(tuple(r) for r in part.groupBy(block).count().collect()), 0
    starts = []
    for b, n in sizes:
        starts.append((b, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "block_ bigint, before_ bigint")
    place = F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return part.withColumn("block_", block).join(F.broadcast(offsets), "block_").withColumn(name, place).drop("at_", "block_", "before_")


def in_one_task(links: DataFrame, kernel: Callable[[int, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """kernel(n, src, dst) -> columns, once over all links, as arrays of 4 bytes an end; n: more than the largest number."""

    def run(batches):
        ends = [b[["src", "dst"]].to_numpy(np.int32) for b in batches]
        if ends:
            both = np.concatenate(ends)
            ends.clear()
            out = kernel(int(both.max()) + 1, both[:, 0].copy(), both[:, 1].copy())
            for i in range(0, len(next(iter(out.values()))), 100_000):
                yield pd.DataFrame({k: v[i : i + 100_000] for k, v in out.items()})

    return links.select("src", "dst").coalesce(1).mapInPandas(run, schema)
