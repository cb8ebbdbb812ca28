"""The array algorithms against plain ones, and that neither the driver nor a broadcast takes part in them."""

import random

import numpy as np
import pytest

from symloom.graph import SymbolGraph
from symloom.operators import arrays, centrality, kernels, structure
from symloom.plans.numbered import ranked


def edges_of(seed):
    rng = random.Random(seed)
    n, m = rng.choice([5, 9, 14, 30]), rng.choice([3, 10, 20, 45])
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    return n, edges, np.array([a for a, _ in edges], np.int32), np.array([b for _, b in edges], np.int32)


@pytest.mark.parametrize("seed", range(60))
def test_structure(seed):
    n, edges, src, dst = edges_of(seed)
    a, b = [f"{x:02}" for x, _ in edges], [f"{x:02}" for _, x in edges]
    name = lambda xs: [f"{x:02}" for x in xs]
    assert name(structure._cuts(n, src, dst)["id"]) == kernels.cut_vertices(a, b)["path"].tolist()
    pairs = structure._bridges(n, src, dst)
    assert sorted(zip(name(pairs["a"]), name(pairs["b"]))) == list(kernels.bridges(a, b).itertuples(index=False, name=None))
    found, groups = structure._blocks(n, src, dst), {}
    for rank, x in zip(found["group_rank"].tolist(), name(found["member"])):
        groups.setdefault(rank, []).append(x)
    assert [groups[k] for k in sorted(groups)] == sorted(kernels.biconnected(a, b)["members"].tolist())
    label, same = arrays.strong(n, src, dst), dict(kernels.strong(a, b).itertuples(index=False, name=None))
    assert all((same[x] == same[y]) == (label[int(x)] == label[int(y)]) for x in same for y in same)


@pytest.mark.parametrize("seed", range(60))
def test_distances(seed):
    n, edges, src, dst = edges_of(seed)
    first, to = arrays.adjacency(src, dst, n)
    r, total, through = np.zeros(n, int), np.zeros(n, int), np.zeros(n)
    for low, high in ((0, n // 3), (n // 3, n)):
        x, y = arrays.reach_sums(first, to, low, high)
        r, total, through = r + x, total + y, through + arrays.dependencies(first, to, low, high)
    dist, ways = np.full((n, n), -1), np.zeros((n, n))
    for s in range(n):
        dist[s, s], ways[s, s], queue = 0, 1, [s]
        for v in queue:
            for w in to[first[v] : first[v + 1]].tolist():
                if dist[s, w] < 0:
                    dist[s, w] = dist[s, v] + 1
                    queue.append(w)
                if dist[s, w] == dist[s, v] + 1:
                    ways[s, w] += ways[s, v]
    assert r.tolist() == (dist > 0).sum(1).tolist() and total.tolist() == np.where(dist > 0, dist, 0).sum(1).tolist()
    for v in range(n):
        want = sum(ways[s, v] * ways[v, t] / ways[s, t] for s in range(n) for t in range(n) if v not in (s, t) and s != t and min(dist[s, v], dist[v, t]) > 0 and dist[s, v] + dist[v, t] == dist[s, t])
        assert through[v] == pytest.approx(want)


def test_places_are_whole(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(4)
    rows = ranked(df, "place", "k", "id").collect()
    assert [r["place"] for r in sorted(rows, key=lambda r: (r["k"], r["id"]))] == list(range(1, 1001))


def chain(spark, n=30):
    names = [f"f>n{i:02}" for i in range(n)]
    edges = [("calls", a, b) for a, b in zip(names, names[1:])] + [("calls", names[9], names[4]), ("calls", names[20], names[20])]
    return names, SymbolGraph.of(spark, [(x, "function") for x in names], edges).written()


def test_whole_beyond_one_task(spark, monkeypatch):
    """Strong and weak components have another way beyond the bound, with the same rows."""
    _, g = chain(spark)
    ask = lambda: [[tuple(r) for r in df.collect()] for df in (g.wcc(), g.scc(), g.cycle_members())]
    here = ask()
    monkeypatch.setattr(structure, "LOCAL_EDGES", 0)
    assert ask() == here and here[2] == [(f"f>n{i:02}",) for i in range(4, 10)]


def test_centrality_in_shares(spark, monkeypatch):
    """The graph goes to tasks without the driver, and in how many shares changes no score."""
    _, g = chain(spark)
    assert not hasattr(centrality, "_adjacency")
    ask = lambda: [[(r["path"], round(r["score"], 12)) for r in df.collect()] for df in (g.closeness(), g.betweenness())]
    one = ask()
    monkeypatch.setattr(centrality, "SHARE_STEPS", 50)
    assert ask() == one
