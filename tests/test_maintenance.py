import pytest

from symloom.graph import SymbolGraph


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("a.py", "file"), ("a.py>f", "function"), ("a.py>C", "class"), ("a.py>C>m", "method"), ("b.py", "file"), ("b.py>g", "function"), ("h", None)]
    edges = [("calls", "b.py>g", "a.py>f"), ("calls", "a.py>f", "a.py>C>m"), ("calls", "b.py>g", "h"), ("imports", "b.py", "a.py")]
    return SymbolGraph.of(spark, nodes, edges).written()


def paths(x):
    return sorted(r["path"] for r in x.nodes.collect())


def edges(x):
    return sorted(tuple(r) for r in x.edges.collect())


def test_merge_is_idempotent_and_the_other_wins(spark, g):
    other = SymbolGraph.of(spark, [("a.py>f", "method"), ("b.py>g", None)], [("calls", "a.py>f", "a.py>f")])
    once, twice = g.merge(other), g.merge(other).merge(other)
    assert paths(once) == paths(twice) and edges(once) == edges(twice)
    kinds = {r["path"]: r["node_kind"] for r in once.nodes.collect()}
    assert kinds["a.py>f"] == "method" and kinds["b.py>g"] == "function"


def test_removal(g):
    assert paths(g.remove_node("a.py>C")) == [x for x in paths(g) if x != "a.py>C"]
    assert paths(g.remove_file("a.py")) == ["b.py", "b.py>g", "h"]
    assert edges(g.remove_file("a.py")) == [("calls", "b.py>g", "h")]


def test_replace_keeps_inbound_edges_to_what_stays(spark, g):
    new = SymbolGraph.of(spark, [("a.py", "file"), ("a.py>f", "function")], [("calls", "a.py>f", "b.py>g")])
    out = g.replace_file("a.py", new)
    assert paths(out) == ["a.py", "a.py>f", "b.py", "b.py>g", "h"]
    assert edges(out) == [("calls", "a.py>f", "b.py>g"), ("calls", "b.py>g", "a.py>f"), ("calls", "b.py>g", "h"), ("imports", "b.py", "a.py")]
    again = out.replace_file("a.py", new)
    assert edges(again) == edges(out) and paths(again) == paths(out)


def test_stubs(spark, g):
    one = g.upsert_node("a.py>h", "function").resolve_stubs()
    assert ("calls", "b.py>g", "a.py>h") in edges(one) and "h" not in paths(one)
    two = g.upsert_node("a.py>h", "function").upsert_node("c.py>h", "function").resolve_stubs()
    assert ("calls", "b.py>g", "a.py>h") in edges(two)


def test_redirect_drops_new_loops(spark, g):
    out = g.redirect(spark.createDataFrame([("a.py>C>m", "a.py>f")], "old string, new string"))
    assert edges(out) == [("calls", "b.py>g", "a.py>f"), ("calls", "b.py>g", "h"), ("imports", "b.py", "a.py")]
