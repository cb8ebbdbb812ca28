"""Depth-first and distance algorithms against naive versions on random graphs."""

import itertools
import random
from collections import deque

import pytest

from symloom.graph import SymbolGraph
from symloom.operators import kernels
from symloom.operators.structure import strong_by_colour


def graph(seed, n=9, m=14):
    rng = random.Random(seed)
    names = [f"f>n{i}" for i in range(n)]
    return names, sorted({(rng.choice(names), rng.choice(names)) for _ in range(m)})


def reach(edges, a, without=None, undirected=False):
    seen, queue = {a: 0}, deque([a])
    while queue:
        x = queue.popleft()
        for s, d in edges:
            for u, v in ((s, d), (d, s)) if undirected else ((s, d),):
                if u == x and v not in seen and v != without:
                    seen[v] = seen[x] + 1
                    queue.append(v)
    return seen


def parts(nodes, edges, without=None):
    left, n = {x for x in nodes if x != without}, 0
    while left:
        left -= set(reach(edges, next(iter(left)), without, True))
        n += 1
    return n


@pytest.mark.parametrize("seed", range(30))
def test_kernels(seed):
    _, edges = graph(seed)
    nodes = {x for e in edges for x in e}
    src, dst = [a for a, _ in edges], [b for _, b in edges]
    cuts = [x for x in sorted(nodes) if parts(nodes, edges, x) > parts(nodes, edges) - (set(reach(edges, x, undirected=True)) == {x})]
    assert kernels.cut_vertices(src, dst)["path"].tolist() == cuts
    plain = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    both = {e for e in plain if e in edges and e[::-1] in edges}
    bridges = sorted(e for e in plain - both if parts(nodes, [x for x in edges if tuple(sorted(x)) != e]) > parts(nodes, edges))
    assert list(kernels.bridges(src, dst).itertuples(index=False, name=None)) == bridges
    out = {x: reach(edges, x) for x in nodes}
    same = {x: min(y for y in nodes if y in out[x] and x in out[y]) for x in nodes}
    assert dict(kernels.strong(src, dst).itertuples(index=False, name=None)) == same
    blocks = kernels.biconnected(src, dst)["members"].tolist()
    assert sorted(e for b in blocks for e in itertools.combinations(b, 2) if e in plain) == sorted(plain)


def test_strong_by_colour_and_distances(spark):
    names, edges = graph(3, 12, 22)
    g = SymbolGraph.of(spark, [(x, "function") for x in names], [("calls", a, b) for a, b in edges]).written()
    out = {x: reach(edges, x) for x in names}
    group = lambda x: sorted(y for y in names if y in out[x] and x in out[y])
    coloured: dict = {}
    for r in strong_by_colour(g.kind("calls").where("src <> dst")).collect():
        coloured.setdefault(r["label"], []).append(r["path"])
    assert sorted(map(tuple, map(sorted, coloured.values()))) == sorted({tuple(group(x)) for x in {y for e in edges if e[0] != e[1] for y in e}})
    want = {(a, b, d) for a in names for b, d in out[a].items() if d}
    assert {tuple(r) for r in g.all_distances().collect()} == want
    n = len(names)
    close = {a: (sum(d > 0 for d in out[a].values()), sum(out[a].values())) for a in names}
    for r in g.closeness().collect():
        k, total = close[r["path"]]
        assert r["score"] == pytest.approx((k / (n - 1)) ** 2 * k / total if total else 0)
    score = dict.fromkeys(names, 0.0)
    for a in names:
        ways = {a: 1}
        for x in sorted(out[a], key=out[a].get):
            for u, v in edges:
                if u == x and out[a][v] == out[a][x] + 1:
                    ways[v] = ways.get(v, 0) + ways[x]
        for v in names:
            for b in out[a]:
                if v not in (a, b) and v in out[a] and b in out[v] and out[a][v] + out[v][b] == out[a][b]:
                    through = {v: 1}
                    for x in sorted(out[v], key=out[v].get):
                        for s, t in edges:
                            if s == x and out[v][t] == out[v][x] + 1:
                                through[t] = through.get(t, 0) + through[x]
                    score[v] += ways[v] * through[b] / ways[b]
    for r in g.betweenness().collect():
        assert r["score"] == pytest.approx(score[r["path"]] / ((n - 1) * (n - 2)))
