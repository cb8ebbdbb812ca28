"""Point lookups, scans and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import QUERY_KINDS, TOP_LIMIT, edge_kind


class Lookup:
    def lookup(self, path: str) -> DataFrame:
        """path, found: one row if the path exists."""
        return self.nodes.where(F.col("path") == path).select("path")

    def get_node_kind(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("path") == path).select("path", F.col("node_kind").alias("kind"))

    def get_source_span(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("path") == path).select("path", "span.*")

    def all_symbols(self, prefix: str | None = None, kind: str | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
        """Sorted; limit 0 means all."""
        out = self.symbols.where(self.under(F.col("path"), prefix))
        if kind:
            out = out.where(F.col("node_kind") == kind)
        out = out.select("path").orderBy("path")
        if offset:
            out = out.offset(offset)
        return out.limit(limit) if limit else out

    def symbols_of_kind(self, kind: str, prefix: str | None = None) -> DataFrame:
        """Over all nodes, files too."""
        return self.nodes.where((F.col("node_kind") == kind) & self.under(F.col("path"), prefix)).select("path").orderBy("path")

    def search_symbol(self, text: str, limit: int = 20) -> DataFrame:
        """Nodes whose last segment holds the text, whatever its case; sorted, cut to the limit."""
        return self.nodes.where(F.contains(F.lower("name"), F.lower(F.lit(text)))).select("path").orderBy("path").limit(limit)

    def all_file_paths(self, prefix: str | None = None) -> DataFrame:
        """Nodes without a separator: files, bare stubs and external modules."""
        return self.nodes.where(~F.col("is_symbol") & self.under(F.col("path"), prefix)).select("path").orderBy("path")

    def symbols_in_file(self, file: str) -> DataFrame:
        return self.nodes.where((F.col("file") == file) & F.col("is_symbol")).select("path").orderBy("path")

    def _without_incoming(self, kinds: tuple[str, ...], prefix: str | None) -> DataFrame:
        called = self.kind(*kinds).select(F.col("dst").alias("path")).distinct()
        return self.symbols.where(self.under(F.col("path"), prefix)).select("path").join(called, "path", "left_anti").orderBy("path")

    def entry_points(self, prefix: str | None = None) -> DataFrame:
        """Symbols that nothing calls."""
        return self._without_incoming(("calls",), prefix)

    def dead_symbols(self, prefix: str | None = None) -> DataFrame:
        """Symbols that nothing calls or imports."""
        return self._without_incoming(("calls", "imports"), prefix)

    def dead_symbols_for_kind(self, kind: str, prefix: str | None = None) -> DataFrame:
        return self._without_incoming((edge_kind(kind),), prefix)

    def isolated_symbols(self, prefix: str | None = None) -> DataFrame:
        """Symbols without any edge of the four query kinds."""
        e = self.kind(*QUERY_KINDS)
        ends = e.select(F.col("src").alias("path")).unionByName(e.select(F.col("dst").alias("path"))).distinct()
        return self.symbols.where(self.under(F.col("path"), prefix)).select("path").join(ends, "path", "left_anti").orderBy("path")

    def leaf_symbols(self, kind: str = "calls", limit: int = TOP_LIMIT) -> DataFrame:
        """Symbols without outgoing edges of the kind."""
        out = self.kind(edge_kind(kind)).select(F.col("src").alias("path")).distinct()
        return self.symbols.select("path").join(out, "path", "left_anti").orderBy("path").limit(min(limit, TOP_LIMIT))

    def singly_referenced(self, kind: str = "calls", limit: int = TOP_LIMIT) -> DataFrame:
        """path, referencer of symbols with exactly one incoming edge."""
        one = self.kind(edge_kind(kind)).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"), F.min("src").alias("referencer")).where("n = 1")
        return self.symbols.select("path").join(one, "path").select("path", "referencer").orderBy("path").limit(min(limit, TOP_LIMIT))

    def symbol_info(self, paths: list[str]) -> DataFrame:
        """In input order: found, and the sorted ancestors (nearest first), descendants, callers and callees of each."""
        from ..functions.paths import ancestors_of

        asked = self.spark.createDataFrame(list(enumerate(paths)), "pos int, path string")
        calls = self.kind("calls")
        up = asked.select("pos", F.posexplode(ancestors_of(F.col("path"))).alias("i", "a")).join(self.nodes.select(F.col("path").alias("a")), "a").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("up"))
        each = self.nodes.select(F.col("path").alias("d"), F.explode(ancestors_of(F.col("path"))).alias("path"))
        down = asked.join(each, "path").groupBy("pos").agg(F.array_sort(F.collect_list("d")).alias("descendants"))
        ins = asked.join(calls.select(F.col("dst").alias("path"), "src"), "path").groupBy("pos").agg(F.array_sort(F.collect_set("src")).alias("callers"))
        outs = asked.join(calls.select(F.col("src").alias("path"), "dst"), "path").groupBy("pos").agg(F.array_sort(F.collect_set("dst")).alias("callees"))
        found = asked.join(self.nodes.select("path", F.lit(True).alias("found")), "path", "left")
        all_ = found.join(up, "pos", "left").join(down, "pos", "left").join(ins, "pos", "left").join(outs, "pos", "left")
        none = F.array().cast("array<string>")
        return all_.select(
            "pos", "path", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce(F.transform("up", lambda x: x["a"]), none).alias("ancestors"),
            *(F.coalesce(c, none).alias(c) for c in ("descendants", "callers", "callees")),
        ).orderBy("pos")

    def edge_counts(self) -> DataFrame:
        """node_count, edge_count."""
        return self.nodes.agg(F.count("*").alias("node_count")).join(self.edges.agg(F.count("*").alias("edge_count")))

    def heap_estimate(self) -> DataFrame:
        return self.edge_counts().select((256 * F.col("node_count") + 24 * F.col("edge_count")).alias("bytes"))

    @staticmethod
    def node_id(path: Column) -> Column:
        """A path's 60-bit id, the same in every graph."""
        return F.conv(F.left(F.md5(path), F.lit(15)), 16, 10).cast("long")

    def path_of(self, ids: DataFrame) -> DataFrame:
        """id, path of those ids (one column, id) that nodes have."""
        return ids.select("id").distinct().join(self.nodes.select(self.node_id(F.col("path")).alias("id"), "path"), "id").select("id", "path")
