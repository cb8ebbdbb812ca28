"""The queries over the whole calls graph against naive versions on the small tables."""

import os
from collections import defaultdict, deque

import pytest

from symloom.plans import catalog
from symloom.sources.derived import derived_graph

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def calls(spark):
    g = derived_graph(spark, DIR).written()
    edges = sorted((r["src"], r["dst"]) for r in g.kind("calls").collect())
    return g, edges, {r["path"] for r in g.symbols.select("path").collect()}


def near(edges, both=False):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        if both:
            out[b].add(a)
    return out


def distances(out, a, without=None):
    seen, queue = {a: 0}, deque([a])
    while queue:
        x = queue.popleft()
        for y in out[x]:
            if y not in seen and y != without:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


def ask(spark, name):
    return catalog.QUERIES[name](spark, DIR).collect()


def test_cuts_and_bridges(spark, calls):
    _, edges, _ = calls
    out = near(edges, True)
    cuts = []
    for v in out:
        around = sorted(out[v] - {v})
        if around and not set(around) <= set(distances(out, around[0], v)):
            cuts.append(v)
    assert [r["path"] for r in ask(spark, "articulation_points__calls")] == sorted(cuts)
    pairs = sorted({tuple(sorted(e)) for e in edges if e[0] != e[1]})
    both = {e for e in edges if e[::-1] in set(edges)}
    bridges = [(a, b) for a, b in pairs if (a, b) not in both and b not in distances(near([e for e in edges if tuple(sorted(e)) != (a, b)], True), a)]
    assert [tuple(r) for r in ask(spark, "bridge_edges__calls")] == bridges


def test_distances(spark, calls):
    g, edges, symbols = calls
    out, back, n = near(edges), near([e[::-1] for e in edges]), len(symbols)
    a, b = catalog.pick(g, "caller"), catalog.pick(g, "callee")
    d, e, i = distances(out, a), distances(out, b), distances(back, b)
    assert [r["path"] for r in ask(spark, "reachable_set__calls")] == sorted(set(d) - {a})
    assert [r["path"] for r in ask(spark, "reaches_into__calls")] == sorted(set(i) - {b})
    assert [r["path"] for r in ask(spark, "common_reachable__calls")] == sorted((set(d) - {a}) & (set(e) - {b}))
    assert tuple(ask(spark, "eccentricity__calls")[0]) == (max(d.values()), len(d) - 1)
    assert ask(spark, "harmonic__calls")[0]["score"] == pytest.approx(sum(1 / x for x in d.values() if x) / (n - 1))
    assert tuple(ask(spark, "mutual_reachability__calls")[0])[:2] == (d.get(b), e.get(a))
    assert len(ask(spark, "shortest_path__calls")) == max(d.values()) + 1
    for r in ask(spark, "closeness__calls"):
        x = distances(out, r["path"])
        k, t = len(x) - 1, sum(x.values())
        assert r["score"] == pytest.approx((k / (n - 1)) ** 2 * k / t if t else 0, abs=1e-11)
