"""What the rounds of reachability and ranks are made of: numbers, joined without a broadcast."""

from symloom.graph import SymbolGraph
from symloom.plans.tables import Rounds


def test_rounds_move_numbers_and_send_nothing(spark, monkeypatch):
    names = [f"f>n{i}" for i in range(6)]
    g = SymbolGraph.of(spark, [(x, "function") for x in names], [("calls", a, b) for a, b in zip(names, names[1:])]).written()
    kept, keep = [], Rounds.keep

    def watched(self, df):
        kept.append((df.schema.simpleString(), df._jdf.queryExecution().executedPlan().toString()))
        return keep(self, df)

    monkeypatch.setattr(Rounds, "keep", watched)
    assert [tuple(r) for r in g.eccentricity("f>n0").collect()] == [(5, 5)]
    assert [r["path"] for r in g.shortest_path("f>n0", "f>n2").collect()] == names[:3]
    assert len(kept) > 8 and not any("string" in schema or "Broadcast" in plan for schema, plan in kept)
    kept.clear()
    assert len(g.page_rank(iterations=2).collect()) == 6
    assert not any("string" in schema for schema, _ in kept)
