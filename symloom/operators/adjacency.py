"""One hop along edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import QUERY_KINDS, edge_kind


class Adjacency:
    def callees(self, path: str, kind: str = "calls") -> DataFrame:
        return self.kind(edge_kind(kind)).where(F.col("src") == path).select(F.col("dst").alias("path")).distinct().orderBy("path")

    def callers(self, path: str, kind: str = "calls", include_virtual: bool = False) -> DataFrame:
        out = self.kind(edge_kind(kind)).where(F.col("dst") == path).select(F.col("src").alias("path"))
        if include_virtual and edge_kind(kind) == "calls":
            out = out.unionByName(self.virtual_dispatch_callers(path))
        return out.distinct().orderBy("path")

    def virtual_dispatch_callers(self, path: str) -> DataFrame:
        """Callers of the method of the same name on direct bases of the path's class."""
        if paths.SEP not in path:
            return self.spark.createDataFrame([], "path string")
        cls, _, name = path.rpartition(paths.SEP)
        through = self.kind("extends").where(F.col("src") == cls).select(F.concat("dst", F.lit(paths.SEP + name)).alias("method")).distinct()
        return self.kind("calls").join(through, F.col("dst") == F.col("method"), "left_semi").select(F.col("src").alias("path")).distinct().orderBy("path")

    def _both(self, path: str, kind: str, out: str, into: str) -> DataFrame:
        e = self.kind(kind)
        a = e.where(F.col("src") == path).select(F.lit(out).alias("direction"), F.col("dst").alias("path"))
        return a.unionByName(e.where(F.col("dst") == path).select(F.lit(into).alias("direction"), F.col("src").alias("path"))).orderBy("direction", "path")

    def imports_of(self, path: str) -> DataFrame:
        """direction (imports, imported_by), path."""
        return self._both(path, "imports", "imports", "imported_by")

    def get_extends(self, path: str) -> DataFrame:
        return self._both(path, "extends", "extends", "extended_by")

    def get_implements(self, path: str) -> DataFrame:
        return self._both(path, "implements", "implements", "implemented_by")

    def _grouped(self, path: str, at: str, other: str, names: dict[str, str]) -> DataFrame:
        mine = self.edges.where(F.col(at) == path)
        return mine.agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col(other)))).alias(n) for k, n in names.items()))

    def cross_refs(self, path: str) -> DataFrame:
        """One row of sorted lists: callers, importers, extended_by, implemented_by."""
        return self._grouped(path, "dst", "src", dict(zip(QUERY_KINDS, ("callers", "importers", "extended_by", "implemented_by"))))

    def outgoing_refs(self, path: str) -> DataFrame:
        """One row of sorted lists: callees, imports, extends, implements."""
        return self._grouped(path, "src", "dst", dict(zip(QUERY_KINDS, ("callees", "imports", "extends", "implements"))))

    def symbol_neighborhood(self, path: str, kind: str = "calls") -> DataFrame:
        """direction (incoming, outgoing), path."""
        return self._both(path, edge_kind(kind), "outgoing", "incoming")

    def _common(self, targets: list[str], at: str, other: str, kind: str) -> DataFrame:
        want = list(dict.fromkeys(targets))
        hits = self.kind(edge_kind(kind)).where(F.col(at).isin(want)).groupBy(F.col(other).alias("path")).agg(F.count_distinct(at).alias("n"))
        return hits.where(F.col("n") == len(want)).select("path").orderBy("path")

    def common_callers(self, targets: list[str], kind: str = "calls") -> DataFrame:
        """Nodes with an edge to every target."""
        return self._common(targets, "dst", "src", kind)

    def common_callees(self, sources: list[str], kind: str = "calls") -> DataFrame:
        return self._common(sources, "src", "dst", kind)

    def two_hop(self, path: str, kind: str = "calls") -> DataFrame:
        """Symbols exactly two steps out: neither the start nor a direct neighbour."""
        e = self.kind(edge_kind(kind))
        one = e.where(F.col("src") == path).select(F.col("dst").alias("mid")).distinct()
        two = e.join(one, F.col("src") == F.col("mid")).select(F.col("dst").alias("path")).distinct()
        far = two.where(paths.is_symbol(F.col("path")) & (F.col("path") != path))
        return far.join(one, F.col("path") == F.col("mid"), "left_anti").orderBy("path")

    def _neighbours(self, path: str, kind: str) -> DataFrame:
        e = self.kind(edge_kind(kind)).where((F.col("src") == path) | (F.col("dst") == path))
        return e.select(F.when(F.col("src") == path, F.col("dst")).otherwise(F.col("src")).alias("n")).where(F.col("n") != path).distinct()

    def neighbor_similarity(self, a: str, b: str, kind: str = "calls") -> DataFrame:
        """similarity (Jaccard of undirected neighbours, 0 if both have none), shared, total."""
        x, y = (self._neighbours(p, kind).withColumn(c, F.lit(1)) for p, c in ((a, "x"), (b, "y")))
        n = x.join(y, "n", "full").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count("*").alias("total"))
        return n.select(F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("similarity"), "shared", "total")

    def clustering_coefficient(self, path: str, kind: str = "calls") -> DataFrame:
        """coefficient, neighbors, edges: directed edges among the symbol neighbours over k (k - 1); 0 below two."""
        near = self._neighbours(path, kind).where(paths.is_symbol(F.col("n")))
        e = self.kind(edge_kind(kind)).join(near.select(F.col("n").alias("src")), "src", "left_semi").join(near.select(F.col("n").alias("dst")), "dst", "left_semi")
        k = near.agg(F.count("*").alias("neighbors")).join(e.agg(F.count("*").alias("edges")))
        return k.select(_ratio(F.col("edges"), F.col("neighbors") * (F.col("neighbors") - 1)).alias("coefficient"), "neighbors", "edges")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
