"""Depth-limited trees: all walks from a root; a node met again on its own branch is a leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Rounds
from ..schema import TREE_DEPTH


class Trees:
    def _tree(self, path: str, kind: str, outgoing: bool, max_depth: int) -> DataFrame:
        """depth, path, trail (root first), one row per tree node, in depth-first order."""
        e = self.kind(kind).select(F.col("src" if outgoing else "dst").alias("a"), F.col("dst" if outgoing else "src").alias("b")).persist()
        rounds = Rounds()
        root = self.nodes.where(F.col("path") == path).select(F.lit(0).alias("depth"), "path", F.array("path").alias("trail"), F.lit(True).alias("open"))
        frontier = rounds.keep(root)
        parts = [frontier]
        for depth in range(1, min(max_depth, TREE_DEPTH) + 1):
            step = frontier.where("open").join(e, F.col("path") == F.col("a"))
            frontier = rounds.keep(step.select(F.lit(depth).alias("depth"), F.col("b").alias("path"), F.concat("trail", F.array("b")).alias("trail"), (~F.array_contains("trail", F.col("b"))).alias("open")))
            if frontier.isEmpty():
                break
            parts.append(frontier)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("depth", "path", "trail").orderBy("trail")

    def callee_tree(self, path: str, max_depth: int = 4) -> DataFrame:
        return self._tree(path, "calls", True, max_depth)

    def caller_tree(self, path: str, max_depth: int = 4) -> DataFrame:
        return self._tree(path, "calls", False, max_depth)

    def import_tree(self, path: str, max_depth: int = 4) -> DataFrame:
        return self._tree(path, "imports", True, max_depth)

    def importers_tree(self, path: str, max_depth: int = 4) -> DataFrame:
        return self._tree(path, "imports", False, max_depth)

    def extends_tree(self, path: str, max_depth: int = 4) -> DataFrame:
        return self._tree(path, "extends", True, max_depth)

    def subclasses_tree(self, path: str, max_depth: int = 4) -> DataFrame:
        return self._tree(path, "extends", False, max_depth)

    def implements_tree(self, path: str, max_depth: int = 4) -> DataFrame:
        return self._tree(path, "implements", True, max_depth)

    def implementors_tree(self, path: str, max_depth: int = 4) -> DataFrame:
        return self._tree(path, "implements", False, max_depth)
