import pytest

from symloom.streaming import deltas
from symloom.streaming.subscriptions import Subscriptions, SubscriptionError
from symloom.streaming.watch import EVENTS, Watch


def test_globs():
    import re

    ok = lambda g, p: re.search(deltas.glob_regex(g), p) is not None
    assert ok("src/*.py", "src/a.py") and not ok("src/*.py", "src/b/a.py")
    assert ok("src/**", "src/b/a.py") and ok("**/a.py", "a.py") and ok("**/a.py", "x/y/a.py") and not ok("a?.py", "a.py")


def test_delta_and_caps(spark):
    old = spark.createDataFrame([("f", "f>a"), ("f", "f>b")], "file string, path string")
    new = spark.createDataFrame([("f", "f>b"), ("f", "f>c"), ("f", "f>d")], "file string, path string")
    d = deltas.symbol_delta(old, new)
    assert sorted(tuple(r) for r in d.collect()) == [("f", "f>a", "removed"), ("f", "f>b", "modified"), ("f", "f>c", "added"), ("f", "f>d", "added")]
    caps = {r["change"]: (r["total"], r["paths"]) for r in deltas.delta_caps(d, 1).collect()}
    assert caps["added"] == (2, ["f>c"])
    assert deltas.set_summary(old, new).first()["n_added"] == 2
    assert deltas.result_hash(old).first() == deltas.result_hash(old.union(old)).first()


def test_watch_replays_files_one_by_one(spark, tmp_path):
    rows = [(1, "f.py", "f.py>a", "upsert"), (2, "f.py", "f.py>b", "upsert"), (3, "f.py", "f.py>a", "remove"), (4, "g.py", "g.py>x", "upsert")]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    seen = []
    w = Watch(spark, tmp_path.name, lambda n, delta, state: seen.append((n, sorted(tuple(r) for r in delta.collect()), sorted(r["path"] for r in state.collect()))))
    w.start(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))).awaitTermination()
    assert w.status() == {"watching": False, "batches_processed": 2}
    assert seen[-1][2] == ["f.py>b", "g.py>x"] or seen[-1][2] == ["f.py>a", "f.py>b", "g.py>x"]
    assert sum(len(d) for _, d, _ in seen) >= 4


def test_subscription_limits_and_gates():
    s = Subscriptions()
    a = s.subscribe("c1", "query", "callers", now=0, id_="q")
    for bad in (("c1", "other", ""), ("c1", "selector", "not a selector")):
        with pytest.raises(ValueError):
            s.subscribe(*bad, now=0)
    with pytest.raises(SubscriptionError):
        s.subscribe("c1", "files", "*", now=0, ttl=10**6)
    gate = lambda now, paths, ms=1, changed=True: s.gate(a.id, now, changed, lambda: (paths, ms))[0]
    assert gate(0, ["x"]) == "emitted"
    assert gate(1, ["y"]) == "too_soon"
    assert gate(3, ["y"], changed=False) == "unchanged_graph"
    assert gate(3, ["x", "x"]) == "same_result"
    assert gate(4, ["y"], ms=500) == "over_budget"
    assert gate(10, ["y"]) == "paused"
    assert gate(70, ["y"]) == "emitted"
    assert s.status(71)[0]["seconds_until_expiry"] == 3599
    assert s.evict(10_000) == ["q"] and not s.unsubscribe("q")
    for i in range(32):
        s.subscribe("c2", "files", "*", now=0)
    with pytest.raises(SubscriptionError):
        s.subscribe("c2", "files", "*", now=0)
    assert len(s.drop_client("c2")) == 32


def test_a_watch_goes_on_after_a_restart(spark, tmp_path):
    """A second watch of the same name reads the first one's last state, not an empty one; so does one of files."""
    from symloom.streaming.watch import FileWatch

    def events(rows, where):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(where)

    home, deltas = str(tmp_path / "events"), []
    for rows in ([(1, "a.py", "a.py>x", "upsert"), (2, "b.py", "b.py>y", "upsert")], [(3, "a.py", "a.py>x", "remove"), (4, "a.py", "a.py>z", "upsert")]):
        events(rows, home)
        w = Watch(spark, f"restart-{tmp_path.name}", lambda n, delta, state: deltas.append(sorted(tuple(r) for r in delta.collect())))
        w.start(spark.readStream.schema(EVENTS).parquet(home)).awaitTermination()
    assert sorted(r["path"] for r in w._state().collect()) == ["a.py>z", "b.py>y"]
    assert deltas[1] == [("a.py", "a.py>x", "removed"), ("a.py", "a.py>z", "added")]

    home, seen = str(tmp_path / "files"), []
    batches = [[("m.py", b"def f():\n    g()\n"), ("n.py", b"def h(): ...\n")], [("k.py", b"def g(): ...\n")], [("n.py", None)]]
    for batch in batches:
        spark.createDataFrame(batch, "path string, content binary").coalesce(1).write.mode("append").parquet(home)
        w = FileWatch(spark, f"files-{tmp_path.name}", lambda n, delta, graph: seen.append(sorted(r["path"] for r in delta.collect())))
        w.start(spark.readStream.schema("path string, content binary").parquet(home)).awaitTermination()
    graph = w.graph()
    assert sorted(r["path"] for r in graph.symbols.collect()) == ["k.py>g", "m.py>f"]
    assert ("calls", "m.py>f", "k.py>g") in {tuple(r) for r in graph.edges.collect()}  # a stub until its file came
    assert seen == [["m.py>f", "n.py>h"], ["k.py>g"], ["n.py>h"]]
