"""Operators on small hand-built graphs."""

import pytest

from symloom.graph import SymbolGraph
from symloom.schema import edge_kind

F = "src/lib.rs"


def p(x):
    return f"{F}>{x}"


def rows(df):
    return [tuple(v.replace(F + ">", "") if isinstance(v, str) else v for v in r) for r in df.collect()]


@pytest.fixture(scope="module")
def diamond(spark):
    return SymbolGraph.of(spark, [(F, "file")] + [(p(x), "function") for x in "abcde"], [("calls", p(a), p(b)) for a, b in ("ab", "bc", "be", "cd")]).written()


@pytest.fixture(scope="module")
def cycle(spark):
    return SymbolGraph.of(spark, [(F, "file")] + [(p(x), "function") for x in "abcd"], [("calls", p(a), p(b)) for a, b in ("ab", "ba", "cd")]).written()


def test_lookups(diamond):
    assert rows(diamond.callees(p("b"))) == [("c",), ("e",)]
    assert rows(diamond.callers(p("d"))) == [("c",)]
    assert rows(diamond.entry_points()) == [("a",)]
    assert rows(diamond.leaf_symbols()) == [("d",), ("e",)]
    assert rows(diamond.dead_symbols()) == [("a",)]
    assert rows(diamond.rank_symbols()) == [("b", 1), ("c", 1), ("d", 1), ("e", 1)]
    assert rows(diamond.most_connected()) == [("b", 3), ("c", 2), ("a", 1), ("d", 1), ("e", 1)]
    assert rows(diamond.hub_symbols(1, 1)) == [("b", 1, 2), ("c", 1, 1)]
    assert rows(diamond.callees("nowhere")) == []


def test_edge_kinds_are_checked(diamond):
    assert edge_kind("CALLS") == "calls"
    with pytest.raises(ValueError):
        diamond.callees(p("a"), "uses")


def test_reach_and_paths(diamond):
    assert rows(diamond.two_hop(p("a"))) == [("c",), ("e",)]
    assert rows(diamond.k_hop(p("a"), 3)) == [("d",)]
    assert rows(diamond.k_hop(p("a"), 0)) == []
    assert rows(diamond.reachable_set(p("a"))) == [("b",), ("c",), ("d",), ("e",)]
    assert rows(diamond.reaches_into(p("d"))) == [("a",), ("b",), ("c",)]
    assert rows(diamond.shortest_path(p("a"), p("d"))) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert rows(diamond.find_call_path(p("a"), p("d"), 2)) == []
    assert rows(diamond.shortest_path(p("d"), p("a"))) == []
    assert rows(diamond.eccentricity(p("a"))) == [(3, 4)]
    assert rows(diamond.harmonic(p("a")))[0][0] == pytest.approx(0.583333333)
    assert rows(diamond.dependency_depth(p("d"))) == [(3,)]
    assert rows(diamond.mutual_reachability(p("a"), p("d"))) == [(3, None, True, False, False)]


def test_tree_marks_a_repeat_as_leaf(cycle):
    assert [r[:2] for r in rows(cycle.callee_tree(p("a"), 4))] == [(0, "a"), (1, "b"), (2, "a")]


def test_structure(diamond, cycle):
    assert rows(diamond.dependency_layers()) == [(0, "d"), (0, "e"), (1, "c"), (2, "b"), (3, "a")]
    assert [r[1] for r in rows(diamond.topological_sort())] == list("abcde")
    assert rows(diamond.articulation_points()) == [("b",), ("c",)]
    assert rows(diamond.bridge_edges()) == [("a", "b"), ("b", "c"), ("b", "e"), ("c", "d")]
    assert rows(diamond.k_core(2)) == []
    assert len(rows(diamond.k_core(1))) == 5
    assert rows(cycle.scc()) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert rows(cycle.cycle_members()) == [("a",), ("b",)]
    assert rows(cycle.topological_sort()) == [(0, "c", False), (1, "d", False), (None, "a", True), (None, "b", True)]
    assert rows(cycle.wcc()) == [(1, "a"), (1, "b"), (2, "c"), (2, "d")]
    assert rows(cycle.bridge_edges()) == [("c", "d")]


def test_totals(diamond):
    assert rows(diamond.graph_metrics()) == [(5, 4, 0.2, 0.8, 1, 2)]
    assert rows(diamond.degree_histogram()) == [("in", 0, 1), ("in", 1, 4), ("out", 0, 2), ("out", 1, 2), ("out", 2, 1)]
    assert rows(diamond.closeness())[0] == ("a", 0.5)
    assert dict(rows(diamond.betweenness()))["b"] == pytest.approx(0.25)
    assert sum(s for _, s in rows(diamond.page_rank())) == pytest.approx(1.0)


def test_empty_graph(spark):
    g = SymbolGraph(spark.createDataFrame([], "path string, node_kind string"), spark.createDataFrame([], "kind string, src string, dst string"))
    for df in (g.entry_points(), g.rank_symbols(), g.wcc(), g.scc(), g.page_rank(), g.dependency_layers(), g.closeness(), g.select("*")):
        assert df.collect() == []
    assert g.graph_metrics().first()["symbol_count"] == 0
