from symloom.functions.imports import alias_target, chain, python_relative, typescript_relative
from symloom.sources import extract, render


def edges(rows, kind):
    return sorted((r[1], r[5]) for r in rows if r[0] == "edge" and r[4] == kind)


def test_import_functions():
    assert python_relative("pkg/sub/foo.py", ".models") == "pkg/sub/models.py"
    assert python_relative("pkg/sub/foo.py", "..utils.x") == "pkg/utils/x.py"
    assert python_relative("pkg/a.py", "typing") is None
    assert typescript_relative("src/a/b.ts", "../c") == "src/c.ts" and typescript_relative("src/b.js", "./d.json") == "src/d.json" and typescript_relative("a.ts", "react") is None
    assert alias_target("p/a.py", "m", "X", "Y") == "m>X" and alias_target("p/a.py", ".", "m", "m") == "p/m.py" and alias_target("p/a.py", "m", None, "Y") == "m"
    assert chain({"a": "b", "b": "c>d"}, "a>f") == "c>d>f" and chain({"a": "a"}, "a") == "a"


PY = b"""
from __future__ import annotations
import os
from .util import helper as h
if TYPE_CHECKING:
    from .types import T

class Base: ...

class A(Base):
    def run(self):
        self.step()
        h()
        top(inner)
        unknown.thing()

    def step(self): ...

def top(x): return x
def inner(): ...
top(inner)
"""


def test_python():
    rows = extract.extract("p/a.py", PY)
    kinds = {r[1]: r[2] for r in rows if r[0] == "node"}
    assert kinds == {"p/a.py": "file", "p/a.py>Base": "class", "p/a.py>A": "class", "p/a.py>A>run": "method", "p/a.py>A>step": "method", "p/a.py>top": "function", "p/a.py>inner": "function"}
    calls = edges(rows, "calls")
    run = "p/a.py>A>run"
    for dst in ("p/a.py>A>step", "p/util.py>helper", "p/a.py>top", "p/a.py>inner", "thing"):
        assert (run, dst) in calls
    assert ("p/a.py", "p/a.py>top") in calls
    assert edges(rows, "extends") == [("p/a.py>A", "p/a.py>Base")]
    assert ("p/a.py", "p/types.py") in edges(rows, "type_imports") and ("p/a.py", "p/util.py") in edges(rows, "imports")


def test_patterns():
    rows = extract.extract("s/l.rs", b"use std::io;\nstruct App;\nimpl App {\n    fn go(&self) { login(); }\n}\nfn login() {}\n")
    assert {r[1]: r[2] for r in rows if r[0] == "node" and r[1] != "s/l.rs"} == {"s/l.rs>App": "struct", "s/l.rs>App>go": "method", "s/l.rs>login": "function"}
    assert edges(rows, "imports") == [("s/l.rs", "std::io")] and ("s/l.rs>App>go", "s/l.rs>login") in edges(rows, "calls")
    java = extract.extract("A.java", b"import a.b.C;\nclass A extends B implements I, J {\n    public void run() {\n        go();\n    }\n}\n")
    assert edges(java, "extends") == [("A.java>A", "B")] and edges(java, "implements") == [("A.java>A", "I"), ("A.java>A", "J")]
    assert extract.extract("m.ts.py", b"x=1") == [] and extract.extract("bad.py", b"def (")[0][0] == "error"


def test_index(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("from .b import f\ndef g():\n    f()\n    lonely()\n")
    (tmp_path / "pkg" / "b.py").write_text("def f(): ...\ndef lonely(): ...\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (")
    (tmp_path / "skip.py").write_text("x = 1")
    (tmp_path / "target" / "t.py").write_text("x = 1")
    (tmp_path / ".gitignore").write_text("skip.py\n")
    graph, errors = extract.index(spark, str(tmp_path))
    calls = sorted(tuple(r) for r in graph.kind("calls").collect())
    assert calls == [("pkg/a.py>g", "pkg/b.py>f"), ("pkg/a.py>g", "pkg/b.py>lonely")]
    assert [r["path"] for r in errors.collect()] == ["pkg/bad.py"]
    assert not any("skip" in r["path"] or "target" in r["path"] for r in graph.nodes.collect())


def test_render():
    v = {"a": [1, {"b": None, "c": "x: y"}], "e": {}, "t": "true", "f": 1.5}
    assert render.to_text(v) == 'a:\n  - 1\n  - b: null\n    c: "x: y"\ne: {}\nt: "true"\nf: 1.5'
    assert render.to_msgpack({"a": [1, -1, 300, True, None, "é"]}).hex() == "81a1619601ffcd012cc3c0a2c3a9"
    assert render.tree([{"depth": 0, "path": "a"}, {"depth": 1, "path": "b"}, {"depth": 1, "path": "c"}], "callees") == {"path": "a", "callees": [{"path": "b", "callees": []}, {"path": "c", "callees": []}]}
