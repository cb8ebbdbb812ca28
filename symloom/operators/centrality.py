"""Distance-based centrality over all sources.

Each weakly connected component becomes one row, its adjacency as arrays of numbers, and goes to tasks with a share
of its nodes: neither the driver nor a task ever holds the whole graph, or more than a component of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbered import Numbers, apart
from ..plans.tables import Rounds, written
from ..schema import edge_kind
from . import arrays
from .structure import labelled

#: Shares of one component; a component has fewer if all its nodes and edges together are few.
SHARES, SHARE_STEPS = 96, 20_000_000


class Centrality:
    def all_distances(self, kind: str = "calls") -> DataFrame:
        """source, path, depth for every reachable pair of symbols, by a frontier loop."""
        e = self.symbol_edges(edge_kind(kind)).persist()
        rounds = Rounds()
        frontier = rounds.keep(self.symbols.select(F.col("path").alias("source"), "path", F.lit(0).alias("depth")))
        seen, depth = frontier, 0
        while not frontier.isEmpty():
            depth += 1
            step = frontier.join(e, F.col("path") == F.col("src")).select("source", F.col("dst").alias("path")).distinct()
            frontier = rounds.keep(step.join(seen.select("source", "path"), ["source", "path"], "left_anti").withColumn("depth", F.lit(depth)))
            seen = seen.unionByName(frontier)
        return seen.where("depth > 0")

    def closeness(self, kind: str = "calls", limit: int = 0) -> DataFrame:
        """path, score of every symbol: (r / (n - 1))^2 * r / (sum of distances to the r it reaches), 0 if none."""
        numbers, n = self.numbers(edge_kind(kind)), self.symbols.count()
        sums = _by_shares(numbers, _sums, "id bigint, r bigint, total bigint").groupBy("id").agg(F.sum("r").alias("r"), F.sum("total").alias("total"))
        r, total = F.col("r").cast("double"), F.col("total").cast("double")
        score = F.coalesce(F.try_divide(r, F.lit(float(n - 1))) ** 2 * F.try_divide(r, total), F.lit(0.0))
        out = numbers.ids.where("known").join(apart(sums), "id", "left").select("path", score.alias("score")).orderBy(F.desc("score"), "path")
        return out.limit(limit) if limit else out

    def betweenness(self, kind: str = "calls", limit: int = 0) -> DataFrame:
        """path, score: the share of shortest ways through each symbol, summed over pairs, over (n - 1)(n - 2); 0 for n < 3."""
        numbers, n = self.numbers(edge_kind(kind)), self.symbols.count()
        sums = _by_shares(numbers, _through, "id bigint, score double").groupBy("id").agg(F.sum("score").alias("score"))
        norm = float((n - 1) * (n - 2)) if n > 2 else None
        score = F.coalesce(F.col("score") / F.lit(norm), F.lit(0.0)) if norm else F.lit(0.0)
        out = numbers.ids.where("known").join(apart(sums), "id", "left").select("path", score.alias("score")).orderBy(F.desc("score"), "path")
        return out.limit(limit) if limit else out


def _by_shares(numbers: Numbers, kernel, schema: str) -> DataFrame:
    """kernel(ids, first, to, low, high) -> rows, for each share low to high of each component's nodes."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, src, dst = arrays.dense(pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64))
        first, to = arrays.adjacency(src, dst, len(ids))
        shares = min(SHARES, -(-len(ids) * len(to) // SHARE_STEPS))
        return pd.DataFrame({"label": pdf["label"][:1], "shares": shares, "ids": ids.tobytes(), "first": first.astype(np.int64).tobytes(), "to": to.tobytes()})

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.iloc[0]
        ids, first, to = np.frombuffer(c["ids"], np.int64), np.frombuffer(c["first"], np.int64), np.frombuffer(c["to"], np.int32)
        low, high = (len(ids) * (c["share"] + i) // c["shares"] for i in (0, 1))
        return kernel(ids, first, to, int(low), int(high))

    labels = labelled(numbers.links)
    parts = numbers.links.join(apart(labels.select(F.col("id").alias("src"), "label")), "src").groupBy("label").applyInPandas(packed, "label bigint, shares bigint, ids binary, first binary, to binary")
    parts = written(parts, "components")
    parts = parts.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    return parts.groupBy("label", "share").applyInPandas(share, schema)


def _sums(ids, first, to, low, high) -> pd.DataFrame:
    r, total = arrays.reach_sums(first, to, low, high)
    at = np.flatnonzero(r)
    return pd.DataFrame({"id": ids[at], "r": r[at], "total": total[at]})


def _through(ids, first, to, low, high) -> pd.DataFrame:
    score = arrays.dependencies(first, to, low, high)
    at = np.flatnonzero(score)
    return pd.DataFrame({"id": ids[at], "score": score[at]})
