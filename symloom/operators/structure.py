"""Components, cycles, layers, cores, cut vertices and edges.

Loops over DataFrames, one round per level. Components, cut vertices and blocks come from arrays of numbers, 8 bytes
an edge, in one task, as long as the graph has at most LOCAL_EDGES edges (checked). Beyond that weak components come
from pointer jumping, strong ones from forward and backward colouring; the others, which have no other way here, raise.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbered import Numbers, apart, in_one_task, kept_by, named, ranked
from ..plans.tables import Rounds, written
from ..schema import edge_kind
from . import arrays

LOCAL_EDGES = 30_000_000
#: Nodes and edges of a topological order, which still goes over paths.
ORDER_ROWS = 4_000_000


class TooLarge(ValueError):
    """The graph is larger than one task may hold, and the operator has no other way."""


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, label: the least path (or number) of each weakly connected component, by least neighbours and pointer jumping."""
    rounds = Rounds()
    both = kept_by(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "dst")
    labels = rounds.keep(nodes.select("path", F.col("path").alias("label")))
    while True:
        near = both.join(apart(labels), F.col("dst") == F.col("path")).groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(apart(near), F.col("path") == F.col("src"), "left").select("path", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = hooked.select(F.col("path").alias("label"), F.col("label").alias("far"))
        new = rounds.keep(hooked.join(apart(jump), "label", "left").select("path", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("moved")))
        if new.where("moved").isEmpty():
            both.unpersist()
            return new.select("path", "label")
        labels = new.select("path", "label")


def labelled(links: DataFrame) -> DataFrame:
    """id, label: the least number of each weakly connected component of what links touch."""
    if links.count() <= LOCAL_EDGES:
        return in_one_task(links, _parts, "id bigint, label bigint")
    ends = links.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    return components(ends, links).withColumnRenamed("path", "id")


def _touched(n, src, dst) -> np.ndarray:
    there = np.zeros(n, bool)
    there[src] = there[dst] = True
    return np.flatnonzero(there)


def _parts(n, src, dst) -> dict:
    at = _touched(n, src, dst)
    return {"id": at, "label": arrays.joined(n, src, dst)[at]}


def _strong_parts(n, src, dst) -> dict:
    at = _touched(n, src, dst)
    return {"path": at, "label": arrays.strong(n, src, dst)[at]}


def _members(n, src, dst) -> tuple[np.ndarray, np.ndarray]:
    """block, node: each pair once, in order."""
    child, up, block = arrays.blocks(n, src, dst)
    keys = np.unique(np.concatenate([block, block]).astype(np.int64) * n + np.concatenate([child, up]))
    return keys // n, keys % n


def _cuts(n, src, dst) -> dict:
    return {"id": np.flatnonzero(np.bincount(_members(n, src, dst)[1], minlength=n) > 1)}


def _bridges(n, src, dst) -> dict:
    child, up, block = arrays.blocks(n, src, dst)
    alone = np.bincount(block, minlength=n)[block] == 1
    a, b = np.minimum(child, up)[alone].astype(np.int64), np.maximum(child, up)[alone].astype(np.int64)
    given = src.astype(np.int64) * n + dst
    one_way = ~(np.isin(a * n + b, given) & np.isin(b * n + a, given))
    return {"a": a[one_way], "b": b[one_way]}


def _blocks(n, src, dst) -> dict:
    """Blocks in the order of their sorted members: two blocks share one member at most, so the first two decide."""
    block, node = _members(n, src, dst)
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    rank = np.empty(len(start), np.int64)
    rank[np.lexsort((node[start + 1], node[start]))] = np.arange(1, len(start) + 1)
    return {"group_rank": np.repeat(rank, np.diff(np.concatenate([start, [len(block)]]))), "member": node}


def _groups(labels: DataFrame, ids: DataFrame, min_size: int = 1) -> DataFrame:
    """group_rank, member of id, label: groups by size, then first member; members sorted."""
    g = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_size)
    g = ranked(g, "group_rank", F.desc("n"), F.col("first")).select("label", F.col("group_rank").cast("int").alias("group_rank"))
    return named(labels.join(apart(g), "label").select("group_rank", F.col("id").alias("member")), ids, "member").select("group_rank", "member").orderBy("group_rank", "member")


class Structure:
    def wcc(self, kind: str = "calls") -> DataFrame:
        """group_rank, member of weakly connected components of symbols, single ones too."""
        numbers = self.numbers(edge_kind(kind))
        return _groups(_all_labels(numbers, labelled(numbers.between_nodes())), numbers.ids)

    def _whole(self, kind: str, kernel, schema: str) -> tuple[Numbers, DataFrame]:
        """kernel over all symbol edges, by number."""
        numbers = self.numbers(edge_kind(kind))
        if numbers.links.count() > LOCAL_EDGES:
            raise TooLarge(f"more than {LOCAL_EDGES} edges")
        return numbers, in_one_task(numbers.links, kernel, schema)

    def _strong(self, links: DataFrame) -> DataFrame:
        """path, label of strong components that a link touches, by number."""
        if links.count() <= LOCAL_EDGES:
            return in_one_task(links, _strong_parts, "path bigint, label bigint")
        return strong_by_colour(links.where("src <> dst"))

    def scc(self, kind: str = "calls", min_size: int = 1) -> DataFrame:
        """group_rank, member of strongly connected components of symbols."""
        numbers = self.numbers(edge_kind(kind))
        return _groups(_all_labels(numbers, self._strong(numbers.links).withColumnRenamed("path", "id")), numbers.ids, min_size)

    def scc_groups(self, kind: str = "calls") -> DataFrame:
        return self.scc(kind, 2)

    def _cyclic(self, numbers: Numbers) -> DataFrame:
        """path of what is in strong components of two or more."""
        s = written(self._strong(numbers.links), "strong")
        big = s.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
        return named(s.join(apart(big), "label", "left_semi"), numbers.ids, "path").select("path")

    def cycle_members(self, kind: str = "calls", prefix: str | None = None) -> DataFrame:
        """Symbols in strong components of two or more; an edge to oneself is no cycle here."""
        return self._cyclic(self.numbers(edge_kind(kind))).where(self.under(F.col("path"), prefix)).orderBy("path")

    def nodes_in_cycles(self, kind: str = "calls", prefix: str | None = None) -> DataFrame:
        """All nodes, files too, in a strong component of two or more or with an edge to themselves."""
        own = self.kind(edge_kind(kind)).where("src = dst").select(F.col("src").alias("path"))
        return self._cyclic(self.numbers(edge_kind(kind), symbols=False)).unionByName(own).distinct().where(self.under(F.col("path"), prefix)).orderBy("path")

    def _peel(self, edges: DataFrame, at: str, other: str) -> DataFrame:
        """path, layer (null: never reached): layer 0 has no edge at `at`; a node follows when all its others have gone. All symbols."""
        rounds = Rounds()
        e = edges.persist()
        n = e.groupBy(F.col(at).alias("path")).agg(F.count("*").alias("open"))
        state = rounds.keep(self.symbols.select("path").join(n, "path", "left").select("path", F.coalesce("open", F.lit(0).cast("long")).alias("open"), F.lit(None).cast("int").alias("layer")))
        layer = 0
        while True:
            ready = state.where("layer IS NULL AND open = 0").select(F.col("path").alias("gone"))
            if ready.isEmpty():
                return state.select("path", "layer")
            less = e.join(ready, F.col(other) == F.col("gone")).groupBy(F.col(at).alias("path")).agg(F.count("*").alias("less"))
            state = rounds.keep(state.join(less, "path", "left").select("path", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"), F.when(F.col("layer").isNull() & (F.col("open") == 0), F.lit(layer)).otherwise(F.col("layer")).alias("layer")))
            layer += 1

    def dependency_layers(self, kind: str = "calls") -> DataFrame:
        """layer, path: 0 depends on nothing; what cycles hold up is left out."""
        return self._peel(self.symbol_edges(edge_kind(kind)), "src", "dst").where("layer IS NOT NULL").select("layer", "path").orderBy("layer", "path")

    def topological_sort(self, kind: str = "calls") -> DataFrame:
        """pos, path, cyclic: the least order by path; nodes on cycles or behind them follow with no position.

        The order is sequential by definition and runs in one task, on a graph of at most ORDER_ROWS nodes and edges.
        """
        e = self.symbol_edges(edge_kind(kind))
        n = self.symbols.count()
        if n + e.count() > ORDER_ROWS:
            raise TooLarge(f"more than {ORDER_ROWS} nodes and edges")
        rows = e.unionByName(self.symbols.select(F.col("path").alias("src"), F.lit(None).cast("string").alias("dst")))

        def run(batches):
            pdf = pd.concat(list(batches), ignore_index=True)
            into: dict[str, int] = {}
            out: dict[str, list[str]] = {}
            for s, d in zip(pdf["src"], pdf["dst"]):
                into.setdefault(s, 0)
                if isinstance(d, str):
                    out.setdefault(s, []).append(d)
                    into[d] = into.get(d, 0) + 1
            heap, order = [p for p, k in into.items() if not k], []
            heapq.heapify(heap)
            while heap:
                p = heapq.heappop(heap)
                order.append(p)
                for d in out.get(p, ()):
                    into[d] -= 1
                    if not into[d]:
                        heapq.heappush(heap, d)
            left = sorted(p for p, k in into.items() if k)
            yield pd.DataFrame({"pos": pd.array([*range(len(order)), *([None] * len(left))], "Int64"), "path": order + left, "cyclic": [False] * len(order) + [True] * len(left)})

        return rows.coalesce(1).mapInPandas(run, "pos bigint, path string, cyclic boolean")

    def k_core(self, k: int = 2, kind: str = "calls") -> DataFrame:
        """Symbols left when all with fewer than k edge ends are peeled off, again and again."""
        rounds, numbers = Rounds(), self.numbers(edge_kind(kind))
        alive, e = numbers.ids.where("known").select("id"), numbers.links
        n = alive.count()
        while k > 0:
            ends = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
            alive = rounds.keep(alive.join(apart(ends), "id", "left_semi"))
            left = alive.count()
            if left == n:
                break
            n = left
            e = rounds.keep(e.join(apart(alive.withColumnRenamed("id", "src")), "src", "left_semi").join(apart(alive.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst"))
        return named(alive, numbers.ids, "id").select(F.col("id").alias("path")).orderBy("path")

    def articulation_points(self, kind: str = "calls") -> DataFrame:
        numbers, cuts = self._whole(kind, _cuts, "id bigint")
        return named(cuts, numbers.ids, "id").select(F.col("id").alias("path")).orderBy("path")

    def bridge_edges(self, kind: str = "calls") -> DataFrame:
        """a, b (a <= b): edges whose loss splits a component; a pair with edges both ways is none."""
        numbers, pairs = self._whole(kind, _bridges, "a bigint, b bigint")
        return named(pairs, numbers.ids, "a", "b").select("a", "b").orderBy("a", "b")

    def biconnected_components(self, kind: str = "calls") -> DataFrame:
        """group_rank, member: groups of two or more, a node may be in several; by their sorted members."""
        numbers, members = self._whole(kind, _blocks, "group_rank int, member bigint")
        return named(members, numbers.ids, "member").select("group_rank", "member").orderBy("group_rank", "member")


def _all_labels(numbers: Numbers, labels: DataFrame) -> DataFrame:
    """id, label of every symbol; one that no link touches is alone."""
    return written(numbers.ids.where("known").select("id").join(apart(labels), "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")


def strong_by_colour(edges: DataFrame) -> DataFrame:
    """path, label: the largest path that reaches a node colours it; what reaches back to that path within its colour is its component. Rounds until no edge is left."""
    rounds = Rounds()
    e = rounds.keep(edges)
    done = None
    while True:
        while True:  # nodes without edges in or out are components of their own
            ins, outs = e.select(F.col("dst").alias("path")).distinct(), e.select(F.col("src").alias("path")).distinct()
            inner = ins.join(outs, "path", "left_semi")
            n = e.count()
            kept = rounds.keep(e.join(inner.withColumnRenamed("path", "src"), "src", "left_semi").join(inner.withColumnRenamed("path", "dst"), "dst", "left_semi").select("src", "dst"))
            m, e = kept.count(), kept
            if n == m:
                break
        if not m:
            break
        colour = rounds.keep(e.select(F.col("src").alias("path")).distinct().withColumn("colour", F.col("path")))
        while True:
            into = e.join(colour, F.col("src") == F.col("path")).groupBy("dst").agg(F.max("colour").alias("near"))
            new = rounds.keep(colour.join(into, F.col("path") == F.col("dst"), "left").select("path", F.greatest("colour", "near").alias("colour"), (F.col("near") > F.col("colour")).alias("moved")))
            colour = new.select("path", "colour")
            if new.where("moved").isEmpty():
                break
        a, b = (colour.select(F.col("path").alias(c), F.col("colour").alias(f"{c}_colour")) for c in ("src", "dst"))
        same = rounds.keep(e.join(a, "src").join(b, "dst").where("src_colour = dst_colour").select(F.col("src_colour").alias("colour"), "src", "dst"))
        back = rounds.keep(colour.where("path = colour"))
        frontier = back
        while not frontier.isEmpty():
            step = frontier.join(same.select("colour", "src", "dst"), (F.col("path") == F.col("dst"))).select(F.col("src").alias("path"), same["colour"]).distinct()
            frontier = rounds.keep(step.join(back, ["path", "colour"], "left_anti").select("path", "colour"))
            back = rounds.keep(back.unionByName(frontier))
        found = back.select("path", F.col("colour").alias("label"))
        done = found if done is None else done.unionByName(found)
        gone = back.select("path")
        e = rounds.keep(e.join(gone.withColumnRenamed("path", "src"), "src", "left_anti").join(gone.withColumnRenamed("path", "dst"), "dst", "left_anti").select("src", "dst"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    if done is None:
        return ends.select("path", F.col("path").alias("label"))
    return ends.join(done, "path", "left").select("path", F.coalesce("label", "path").alias("label"))
