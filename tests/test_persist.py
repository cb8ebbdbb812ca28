from symloom.graph import SymbolGraph
from symloom.sources import persist


def test_snapshot_and_journal(spark, tmp_path):
    home = str(tmp_path / "g")
    g = SymbolGraph.of(spark, [("a.py", "file"), ("a.py>f", "function"), ("b.py", "file"), ("b.py>g", "function")], [("calls", "b.py>g", "a.py>f")])
    persist.save(g, home)
    same = persist.load_with_journal(spark, home)
    assert sorted(map(tuple, same.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    one = SymbolGraph.of(spark, [("a.py", "file"), ("a.py>old", "function")], [("calls", "a.py>old", "b.py>g")])
    two = SymbolGraph.of(spark, [("a.py", "file"), ("a.py>f", "function"), ("a.py>new", "function")], [("calls", "a.py>new", "b.py>g")])
    persist.append(home, 1, "a.py", one)
    persist.append(home, 2, "a.py", two)
    now = persist.load_with_journal(spark, home)
    assert sorted(r["path"] for r in now.nodes.collect()) == ["a.py", "a.py>f", "a.py>new", "b.py", "b.py>g"]
    assert sorted(map(tuple, now.edges.collect())) == [("calls", "a.py>new", "b.py>g"), ("calls", "b.py>g", "a.py>f")]
    assert not persist.compact(spark, home, str(tmp_path / "h"))
    assert persist.compact(spark, home, str(tmp_path / "h"), at=2)
    assert persist.load(spark, str(tmp_path / "h")).nodes.count() == 5
