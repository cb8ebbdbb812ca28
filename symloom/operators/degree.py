"""Degrees, rankings and totals. Every ranking breaks ties by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.numbered import apart, kept_by, named
from ..plans.tables import Rounds
from ..schema import QUERY_KINDS, TOP_LIMIT, edge_kind


class Degree:
    def _degrees(self, *kinds: str, symbols_only: bool = False) -> DataFrame:
        """path, in_degree, out_degree of every symbol, with one shuffle of the edges' ends."""
        e = self.symbol_edges(*kinds) if symbols_only else self.kind(*kinds)
        ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        n = ends.groupBy("path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        zero = F.lit(0).cast("long")
        return self.symbols.select("path").join(n, "path", "left").select("path", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))

    def node_degree(self, inputs: list[str]) -> DataFrame:
        """In input order: in and out degree for each of the four kinds."""
        asked = self.spark.createDataFrame(list(enumerate(inputs)), "pos int, path string")
        e = self.edges.where(F.col("kind").isin(*QUERY_KINDS))
        ends = e.select("kind", F.col("src").alias("path"), F.lit("out").alias("way")).unionByName(e.select("kind", F.col("dst").alias("path"), F.lit("in").alias("way")))
        cols = [(k, w) for k in QUERY_KINDS for w in ("in", "out")]
        n = asked.join(ends, "path", "left").groupBy("pos", "path").agg(*(F.count_if((F.col("kind") == k) & (F.col("way") == w)).alias(f"{k}_{w}") for k, w in cols))
        return n.orderBy("pos")

    batch_node_degree = node_degree

    def _rank(self, col: str, kind: str, limit: int, only_symbols: bool) -> DataFrame:
        n = self.kind(edge_kind(kind)).groupBy(F.col(col).alias("path")).agg(F.count("*").alias("n"))
        if only_symbols:
            n = n.where(paths.is_symbol(F.col("path")))
        return n.orderBy(F.desc("n"), "path").limit(min(limit, TOP_LIMIT))

    def rank_symbols(self, kind: str = "calls", limit: int = 10) -> DataFrame:
        """path, n: nodes (files and stubs too) by incoming edges."""
        return self._rank("dst", kind, limit, False)

    def fan_in_rank(self, kind: str = "calls", limit: int = 10) -> DataFrame:
        return self._rank("dst", kind, limit, True)

    def fan_out_rank(self, kind: str = "calls", limit: int = 10) -> DataFrame:
        return self._rank("src", kind, limit, True)

    def most_connected(self, kind: str = "calls", limit: int = 10) -> DataFrame:
        """path, n: symbols by in- plus out-degree, those above 0."""
        n = self._degrees(edge_kind(kind)).select("path", (F.col("in_degree") + F.col("out_degree")).alias("n"))
        return n.where("n > 0").orderBy(F.desc("n"), "path").limit(min(limit, TOP_LIMIT))

    def hub_symbols(self, min_in: int = 2, min_out: int = 2, kind: str = "calls", limit: int = TOP_LIMIT) -> DataFrame:
        d = self._degrees(edge_kind(kind)).where((F.col("in_degree") >= min_in) & (F.col("out_degree") >= min_out))
        return d.orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "path").limit(min(limit, TOP_LIMIT))

    def degree_centrality(self, kind: str = "calls", sort_by: str = "in", limit: int = 0) -> DataFrame:
        """path, in_degree, out_degree, in_centrality, out_centrality over symbol-to-symbol edges, divided by n - 1."""
        d = self._degrees(edge_kind(kind), symbols_only=True)
        n = self.symbols.agg(F.count("*").alias("n"))
        over = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), (F.col("n") - 1).cast("double")), F.lit(0.0))
        out = d.join(F.broadcast(n)).select("path", "in_degree", "out_degree", over("in_degree").alias("in_centrality"), over("out_degree").alias("out_centrality"))
        first, second = ("in_degree", "out_degree") if sort_by == "in" else ("out_degree", "in_degree")
        out = out.orderBy(F.desc(first), F.desc(second), "path")
        return out.limit(limit) if limit else out

    def degree_histogram(self, kind: str = "calls") -> DataFrame:
        """direction, degree, n: frequencies of in- and out-degrees, 0 too."""
        d = self._degrees(edge_kind(kind))
        long = d.select(F.explode(F.array(F.struct(F.lit("in").alias("direction"), F.col("in_degree").alias("degree")), F.struct(F.lit("out").alias("direction"), F.col("out_degree").alias("degree")))).alias("x")).select("x.*")
        return long.groupBy("direction", "degree").agg(F.count("*").alias("n")).orderBy("direction", "degree")

    def graph_metrics(self, kind: str = "calls") -> DataFrame:
        """symbol_count, edge_count (out of symbols), density, avg_degree, max_in, max_out."""
        d = self._degrees(edge_kind(kind)).agg(F.count("*").alias("symbol_count"), F.sum("out_degree").alias("e"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"))
        n, e, zero = F.col("symbol_count"), F.coalesce("e", F.lit(0).cast("long")), F.lit(0).cast("long")
        over = lambda b: F.coalesce(F.try_divide(e.cast("double"), b.cast("double")), F.lit(0.0))
        return d.select("symbol_count", e.alias("edge_count"), over(n * (n - 1)).alias("density"), over(n).alias("avg_degree"), F.coalesce("max_in", zero).alias("max_in"), F.coalesce("max_out", zero).alias("max_out"))

    def graph_stats(self) -> DataFrame:
        """what (nodes, edges), kind (null: the total), n."""
        nodes = self.nodes.rollup("node_kind").agg(F.count("*").alias("n"), F.grouping("node_kind").alias("g")).where("g = 1 OR node_kind IS NOT NULL")
        edges = self.edges.rollup("kind").agg(F.count("*").alias("n"))
        return nodes.select(F.lit("nodes").alias("what"), F.col("node_kind").alias("kind"), "n").unionByName(edges.select(F.lit("edges").alias("what"), "kind", "n")).orderBy("what", "kind")

    def symbol_count_by_kind(self) -> DataFrame:
        return self.nodes.where("node_kind IS NOT NULL").groupBy(F.col("node_kind").alias("kind")).agg(F.count("*").alias("n")).orderBy("kind")

    def page_rank(self, kind: str = "calls", damping: float = 0.85, iterations: int = 20, limit: int = 10) -> DataFrame:
        """path, score by the power method over symbols; what nodes without outgoing edges hold is spread evenly.

        Edges stay hash-partitioned and cached, by number; each round joins the scores to them, and moves one row of numbers per node.
        """
        d = min(max(damping, 0.0), 1.0)
        n = self.symbols.count()
        if not n:
            return self.spark.createDataFrame([], "path string, score double")
        rounds, numbers = Rounds(), self.numbers(edge_kind(kind))
        links = numbers.way()
        out = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_n"))
        base = kept_by(numbers.ids.where("known").select("id").join(apart(out), "id", "left"), "id")
        scores = base.select("id", "out_n", F.lit(1.0 / n).alias("s"))
        for _ in range(iterations):
            flow = links.join(apart(scores.where("out_n IS NOT NULL").select(F.col("id").alias("src"), (F.col("s") / F.col("out_n")).alias("s"))), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("s").alias("flow"))
            loose = scores.where("out_n IS NULL").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("loose"))
            new = base.join(apart(flow), "id", "left").join(F.broadcast(loose)).select("id", "out_n", (F.lit((1 - d) / n) + d * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / n)).alias("s"))
            scores = rounds.keep(new)
        top = scores.select(F.col("id").alias("path"), F.col("s").alias("score")).orderBy(F.desc("score"), "path").limit(limit)
        return named(top, numbers.ids, "path").select("path", "score").orderBy(F.desc("score"), "path").limit(limit)
