"""Breadth-first reachability, distances and shortest paths, as frontier loops over DataFrames.

Each round joins the frontier (not what was seen before) with the edges, and drops what was seen by an anti join. The
rounds go over numbers in the paths' place, and nothing of them is broadcast, as that would pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.numbered import Numbers, apart, kept_by, named
from ..plans.tables import Rounds
from ..schema import DEPTH_LIMIT, edge_kind


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, until=None) -> DataFrame:
    """path, depth of everything reached from the seeds (one column, path: a path or a number), the seeds themselves at 0. edges: src, dst, kept by src. until: a path at whose depth it may end."""
    rounds = Rounds()
    frontier = rounds.keep(seeds.select("path").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        if until is not None and not frontier.where(F.col("path") == until).isEmpty():
            break
        depth += 1
        step = edges.join(apart(frontier.select(F.col("path").alias("src"))), "src").select(F.col("dst").alias("path")).distinct()
        frontier = rounds.keep(step.join(apart(seen.select("path")), "path", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


class Reach:
    def _rows(self, values: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in values], "path string")

    def _reached(self, starts: list[str], kind: str, back: bool = False, max_depth: int | None = None, symbols: bool = True) -> tuple[Numbers, DataFrame]:
        """path (its number), depth of what is reached, without the starts."""
        numbers = self.numbers(edge_kind(kind), symbols=symbols)
        return numbers, bfs(numbers.of(*starts), numbers.way(back), max_depth).where("depth > 0")

    def _reach(self, starts: list[str], kind: str, back: bool = False, max_depth: int | None = None, symbols: bool = True) -> DataFrame:
        numbers, found = self._reached(starts, kind, back, None if max_depth is None else min(max_depth, DEPTH_LIMIT), symbols)
        return named(found, numbers.ids, "path").select("path").orderBy("path")

    def reachable_from(self, path: str, kind: str = "calls", max_depth: int = 10) -> DataFrame:
        """Within max_depth steps out (20 at most), through files too; without the start."""
        return self._reach([path], kind, False, max_depth, False)

    def reachable_to(self, path: str, kind: str = "calls", max_depth: int = 10) -> DataFrame:
        return self._reach([path], kind, True, max_depth, False)

    def batch_reachable_from(self, starts: list[str], kind: str = "calls", max_depth: int = 10) -> DataFrame:
        return self._reach(starts, kind, False, max_depth, False)

    def batch_reachable_to(self, starts: list[str], kind: str = "calls", max_depth: int = 10) -> DataFrame:
        return self._reach(starts, kind, True, max_depth, False)

    def reachable_set(self, path: str, kind: str = "calls") -> DataFrame:
        """Everything reachable over symbols only, however far."""
        return self._reach([path], kind)

    def reaches_into(self, path: str, kind: str = "calls") -> DataFrame:
        return self._reach([path], kind, True)

    def common_reachable(self, a: str, b: str, kind: str = "calls") -> DataFrame:
        (numbers, x), (_, y) = self._reached([a], kind), self._reached([b], kind)
        return named(x.join(apart(y.select("path")), "path", "left_semi"), numbers.ids, "path").select("path").orderBy("path")

    def k_hop(self, path: str, k: int, kind: str = "calls") -> DataFrame:
        """Symbols whose distance is exactly k; none for k = 0."""
        numbers, found = self._reached([path], kind, max_depth=k)
        return named(found.where(F.col("depth") == k), numbers.ids, "path").select("path").orderBy("path")

    def distances(self, path: str, kind: str = "calls") -> DataFrame:
        """path, depth over symbols, without the start."""
        numbers, found = self._reached([path], kind)
        return named(found, numbers.ids, "path")

    def mutual_reachability(self, a: str, b: str, kind: str = "calls") -> DataFrame:
        """One row: forward and backward distance (null: none), and whether each and both exist; 0 and 0 for one symbol."""
        if a == b:
            return self.spark.range(1).select(F.lit(0).alias("forward"), F.lit(0).alias("backward"), F.lit(True).alias("forward_reachable"), F.lit(True).alias("backward_reachable"), F.lit(True).alias("mutual"))
        def way(x: str, y: str, name: str) -> DataFrame:
            numbers, found = self._reached([x], kind)
            at = numbers.of(y).first()
            return found.where(F.col("path") == F.lit(at["path"] if at else None).cast("long")).agg(F.max("depth").alias(name))

        to, back = way(a, b, "forward"), way(b, a, "backward")
        both = to.join(back)
        f, r = F.col("forward").isNotNull(), F.col("backward").isNotNull()
        return both.select("forward", "backward", f.alias("forward_reachable"), r.alias("backward_reachable"), (f & r).alias("mutual"))

    def eccentricity(self, path: str, kind: str = "calls") -> DataFrame:
        """eccentricity (largest distance, 0 if none), reachable."""
        return self._reached([path], kind)[1].agg(F.coalesce(F.max("depth"), F.lit(0)).alias("eccentricity"), F.count("*").alias("reachable"))

    def harmonic(self, path: str, kind: str = "calls") -> DataFrame:
        """score (sum of 1/distance over n - 1), reachable, n."""
        s = self._reached([path], kind)[1].agg(F.coalesce(F.sum(1.0 / F.col("depth")), F.lit(0.0)).alias("s"), F.count("*").alias("reachable"))
        n = self.symbols.agg(F.count("*").alias("n"))
        return s.join(n).select(F.coalesce(F.try_divide(F.col("s"), (F.col("n") - 1).cast("double")), F.lit(0.0)).alias("score"), "reachable", "n")

    def bfs_hops_query(self, path: str, direction: str = "callers", hops: int = 1) -> DataFrame:
        """What a subscription sees: callers or callees within so many hops, 16 at most; sorted, without the start."""
        numbers, found = self._reached([path], "calls", direction == "callers", min(max(hops, 1), 16), False)
        return named(found, numbers.ids, "path").select("path").orderBy("path")

    def impact(self, path: str, max_paths: int = 100, max_depth: int | None = None) -> DataFrame:
        """path, depth: what calls, imports or extends the start or is called so, both ways, nearest first, at most max_paths (10,000)."""
        e = self.kind("calls", "imports", "extends")
        found = bfs(self._rows([path]), kept_by(e.unionByName(_reverse(e)).distinct(), "src"), max_depth)
        return found.where("depth > 0").orderBy("depth", "path").limit(min(max_paths, 10_000))

    def dependency_depth(self, path: str, kind: str = "calls") -> DataFrame:
        """One row: depth, the longest way into the symbol among what reaches it, as far as peeling from the sources gets; null for a file.

        Peels sources round by round. A cycle is never peeled, but what peeled nodes say about their targets holds.
        """
        if paths.SEP not in path:
            return self.spark.range(1).select(F.lit(None).cast("int").alias("depth"))
        numbers = self.numbers(edge_kind(kind))
        start = numbers.of(path).first()
        if start is None:
            return self.spark.range(1).select(F.lit(0).alias("depth"))
        inside = bfs(numbers.of(path), numbers.way(back=True)).select("path")
        rounds = Rounds()
        e = kept_by(numbers.links.join(apart(inside.withColumnRenamed("path", "src")), "src", "left_semi").join(apart(inside.withColumnRenamed("path", "dst")), "dst", "left_semi").select("src", "dst"), "src")
        into = e.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("open"))
        state = rounds.keep(inside.join(apart(into), "path", "left").select("path", F.coalesce("open", F.lit(0).cast("long")).alias("open"), F.lit(0).alias("depth"), F.lit(False).alias("done")))
        while True:
            ready = state.where("NOT done AND open = 0").select("path", "depth")
            told = e.join(apart(ready.withColumnRenamed("path", "src")), "src").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("less"), (F.max("depth") + 1).alias("new"))
            if ready.isEmpty():
                break
            state = rounds.keep(state.join(apart(told), "path", "left").select("path", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"), F.greatest("depth", F.coalesce("new", F.lit(0))).alias("depth"), (F.col("done") | (F.col("open") == 0)).alias("done")))
        return state.where(F.col("path") == start["path"]).select("depth")

    def _path(self, a: str, b: str, kind: str, max_depth: int | None) -> DataFrame:
        """pos, path of the shortest way from a to b; of several the least by its sequence of paths. No rows if there is none."""
        none = self.spark.createDataFrame([], "pos int, path string")
        if self.nodes.where(F.col("path").isin(a, b)).count() < len({a, b}):
            return none
        numbers = self.numbers(edge_kind(kind), symbols=False)
        at = {r["path"]: r["id"] for r in numbers.ids.where(F.col("path").isin(a, b)).select("path", "id").collect()}
        to_b = bfs(numbers.of(b), numbers.way(back=True), max_depth, until=at[a])
        here = to_b.where(F.col("path") == at[a]).first()
        if here is None:
            return none
        trail = [at[a]]
        for depth in range(here["depth"] - 1, -1, -1):  # the least next step that comes nearer: numbers are in the order of paths
            steps = numbers.links.where(F.col("src") == trail[-1]).select(F.col("dst").alias("path"))
            trail.append(to_b.where(F.col("depth") == depth).join(F.broadcast(steps), "path").agg(F.min("path").alias("path")).first()["path"])
        order = self.spark.createDataFrame(list(enumerate(trail)), "pos int, id bigint")
        return numbers.ids.join(F.broadcast(order), "id").select("pos", "path").orderBy("pos")

    def find_call_path(self, a: str, b: str, max_depth: int = 10) -> DataFrame:
        return self._path(a, b, "calls", min(max_depth, DEPTH_LIMIT))

    def find_import_path(self, a: str, b: str, max_depth: int = 8) -> DataFrame:
        return self._path(a, b, "imports", min(max_depth, DEPTH_LIMIT))

    def find_extends_path(self, a: str, b: str, max_depth: int = 8) -> DataFrame:
        return self._path(a, b, "extends", min(max_depth, DEPTH_LIMIT))

    def find_implements_path(self, a: str, b: str, max_depth: int = 8) -> DataFrame:
        return self._path(a, b, "implements", min(max_depth, DEPTH_LIMIT))

    def shortest_path(self, a: str, b: str, kind: str = "calls") -> DataFrame:
        return self._path(a, b, kind, None)
