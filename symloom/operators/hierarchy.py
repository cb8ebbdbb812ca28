"""Operators on the tree of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import TOP_LIMIT


class Hierarchy:
    def ancestors(self, path: str) -> DataFrame:
        """pos (1: the parent), path of the ancestors that exist as nodes."""
        up = self.spark.range(1).select(F.posexplode(paths.ancestors_of(F.lit(path))).alias("i", "path"))
        found = up.join(self.nodes.select("path"), "path", "left_semi")
        return found.select((F.col("i") + 1).alias("pos"), "path").orderBy("pos")

    def descendants(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("path").startswith(path + paths.SEP)).select("path").orderBy("path")

    def inherited_descendants(self, path: str) -> DataFrame:
        """path, base: members of direct bases whose name no own descendant has."""
        bases = self.kind("extends").where(F.col("src") == path).select(F.col("dst").alias("base")).distinct()
        each = self.nodes.select("path", "name", F.explode(paths.ancestors_of(F.col("path"))).alias("base"))
        own = self.nodes.where(F.col("path").startswith(path + paths.SEP)).select("name")
        return each.join(bases, "base").join(own, "name", "left_anti").select("path", "base").distinct().orderBy("path", "base")

    def siblings(self, path: str) -> DataFrame:
        """Nodes with the same parent; none for a file."""
        me = self.nodes.where(F.col("path") == path).select("parent_path")
        return self.nodes.where(F.col("path") != path).join(me, "parent_path", "left_semi").select("path").orderBy("path")

    def contains_edges(self) -> DataFrame:
        return self.kind("contains").orderBy("src", "dst")

    def top_files(self, limit: int = TOP_LIMIT) -> DataFrame:
        """path, children: files by direct children."""
        n = self.nodes.where(F.col("parent_path").isNotNull() & ~paths.is_symbol(F.col("parent_path"))).groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("children"))
        return n.join(self.nodes.where("NOT is_symbol").select("path"), "path", "left_semi").orderBy(F.desc("children"), "path").limit(min(limit, TOP_LIMIT))
