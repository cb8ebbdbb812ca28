import pytest

from symloom.graph import SymbolGraph
from symloom.plans.selector import Combined, SelectorError, parse

F = "src/lib.rs"


@pytest.fixture(scope="module")
def g(spark):
    names = {"login": "function", "logout": "function", "App": "struct", "App>render": "method", "App>login_helper": "method"}
    return SymbolGraph.of(spark, [(F, "file")] + [(f"{F}>{n}", k) for n, k in names.items()], [("calls", f"{F}>App>render", f"{F}>login"), ("calls", f"{F}>login", f"{F}>logout")]).written()


@pytest.mark.parametrize(
    ("expression", "names"),
    [
        ("#login", ["login"]), (".function", ["login", "logout"]), (".function, .struct", ["App", "login", "logout"]), (".struct > .method", ["App>login_helper", "App>render"]),
        (".struct .method:calls(#login)", ["App>render"]), ("*:callers(.method)", ["login"]), (".function:not(#login)", ["logout"]), ("*:has(#render)", ["App"]),
        ("*:in(src/lib.rs):first-child", ["App", "App>login_helper"]), ("*:in(src/)", []), (".method:nth-child(2)", ["App>render"]), (".method:nth-child(0)", []), ("*[language=rust][kind=method]", ["App>login_helper", "App>render"]),
        ("*[color=red]", []), ("*:hover", []), (".nothing", []), ("#render ~ .method", ["App>login_helper", "App>render"]), ("*:only-child", []), ("*:calls", ["App>render", "login"]),
    ],
)
def test_matches(g, expression, names):
    assert [r["path"].removeprefix(F + ">") for r in g.select(expression).collect()] == names


@pytest.mark.parametrize("bad", ["", "  ", "function:calls(#a)", ".function >", "#a:not(", "#a)", ".a[b]", "!", "#a b", ":nth-child(2)", "*:nth-child(x)"])
def test_errors(bad):
    with pytest.raises(SelectorError):
        parse(bad)


def test_space_is_a_combinator_only_before_a_simple_selector():
    (s,) = parse(" .a  .b > #c ")
    assert isinstance(s, Combined) and s.how == ">" and s.left.how == " "
