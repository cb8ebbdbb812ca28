"""The selector language: a lexer and a parser for a syntax tree, and a compiler from the tree to one lazy DataFrame.

    .function:calls(#login)       functions that call something named login
    .class > .method, #main       methods right in a class, and everything named main
    *[language=python]:not(.method):in(src/auth)

Combinators become semi joins, :not an anti join, child positions one window; nothing is materialised on the way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

_TOKENS = [
    ("name", r"#([A-Za-z_][\w-]*)"), ("kind", r"\.([A-Za-z_][\w-]*)"), ("pseudo", r":([A-Za-z_][\w-]*)"), ("punct", r"[>~()\[\]=,*]"),
    ("number", r"[0-9]+"), ("ident", r"[A-Za-z_][\w./-]*"), ("space", r"[ \t\r\n]+"),
]
_LEX = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _TOKENS), re.ASCII)
KIND_ALIASES = {
    "function": "function", "method": "method", "class": "class", "struct": "struct", "enum": "enum", "interface": "interface", "trait": "interface", "module": "module",
    "variable": "variable", "constant": "constant", "const": "constant", "type": "type_alias", "import": "import",
}
EDGE_PSEUDO = {"calls": ("calls", False), "callers": ("calls", True), "imports": ("imports", False), "extends": ("extends", False), "implements": ("implements", False)}


class SelectorError(ValueError):
    """A selector that can't be read; position is an offset into it."""

    def __init__(self, what: str, position: int):
        super().__init__(f"{what} at {position}")
        self.position = position


@dataclass
class Pseudo:
    name: str
    argument: object = None  # None, an int, a path or a list of selectors


@dataclass
class Simple:
    base: tuple[str, str]
    attributes: list[tuple[str, str]] = field(default_factory=list)
    pseudos: list[Pseudo] = field(default_factory=list)


@dataclass
class Combined:
    left: object
    how: str
    right: Simple


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, position)."""
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise SelectorError("unknown sign", at)
        kind = m.lastgroup if m.lastgroup in dict(_TOKENS) else next(n for n, _ in _TOKENS if m[n] is not None)
        value = m[0][1:] if kind in ("name", "kind", "pseudo") else m[0]
        out.append((value if kind == "punct" else kind, value, at))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.items, self.at, self.end = tokens(text), 0, len(text)

    def peek(self) -> str | None:
        return self.items[self.at][0] if self.at < len(self.items) else None

    def take(self, *kinds: str) -> str:
        if self.at == len(self.items):
            raise SelectorError("unexpected end", self.end)
        kind, value, where = self.items[self.at]
        if kinds and kind not in kinds:
            raise SelectorError(f"unexpected {value!r}", where)
        self.at += 1
        return value

    def space(self) -> bool:
        had = self.peek() == "space"
        self.at += had
        return had

    def whole(self) -> list:
        self.space()
        out = self.list()
        self.space()
        if self.peek() is not None:
            self.take("nothing more")
        return out

    def list(self) -> list:
        out = [self.selector()]
        while True:
            self.space()
            if self.peek() != ",":
                return out
            self.take()
            self.space()
            out.append(self.selector())

    def selector(self):
        left: object = self.simple()
        while True:
            spaced, how = self.space(), self.peek()
            if how in (">", "~"):
                self.take()
                self.space()
            elif spaced and how in ("name", "kind", "*"):
                how = " "
            else:
                return left
            left = Combined(left, how, self.simple())

    def simple(self) -> Simple:
        kind = self.peek()
        out = Simple((kind or "", self.take("name", "kind", "*")))
        while self.peek() == "[":
            self.take()
            name = self.take("ident")
            self.take("=")
            out.attributes.append((name, self.take("ident", "number")))
            self.take("]")
        while self.peek() == "pseudo":
            pseudo = Pseudo(self.take())
            if self.peek() == "(":
                self.take()
                self.space()
                if self.peek() != ")":
                    pseudo.argument = int(self.take("number")) if pseudo.name == "nth-child" else self.take("ident") if pseudo.name == "in" else self.list()
                    self.space()
                self.take(")")
            out.pseudos.append(pseudo)
        return out


def parse(text: str) -> list:
    """The selectors of a list."""
    return _Parser(text).whole()


class Selector:
    def select(self, expression: str) -> DataFrame:
        """path of every symbol that the selector list matches, sorted."""
        return self._matches(parse(expression)).select("path").orderBy("path")

    query_tool = select

    def _matches(self, selectors: list) -> DataFrame:
        found = [self._selector(s) for s in selectors]
        out = found[0].select("path")
        for f in found[1:]:
            out = out.unionByName(f.select("path"))
        return out.distinct() if len(found) > 1 else out

    def _selector(self, s) -> DataFrame:
        if isinstance(s, Simple):
            return self._simple(s)
        left, right = self._selector(s.left), self._simple(s.right)
        if s.how == ">":
            return right.join(left.select(F.col("path").alias("parent_path")).distinct(), "parent_path", "left_semi")
        if s.how == "~":
            return right.join(left.where("parent_path IS NOT NULL").select("parent_path").distinct(), "parent_path", "left_semi")
        ups = right.select("path", F.explode(paths.ancestors_of(F.col("path"))).alias("up"))
        return right.join(ups.join(left.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("path").distinct(), "path", "left_semi")

    def _simple(self, s: Simple) -> DataFrame:
        kind, value = s.base
        out = self.symbols
        if kind == "name":
            out = out.where(F.col("name") == value)
        elif kind == "kind":
            out = out.where(F.col("node_kind") == KIND_ALIASES[value]) if value in KIND_ALIASES else out.where(F.lit(False))
        for name, value in s.attributes:
            column = {"language": "language", "kind": "node_kind", "file": "file"}.get(name)
            out = out.where(F.col(column) == value) if column else out.where(F.lit(False))
        for p in s.pseudos:
            out = self._pseudo(out, p)
        return out

    def _pseudo(self, rows: DataFrame, p: Pseudo) -> DataFrame:
        inner = self._matches(p.argument).select("path") if isinstance(p.argument, list) else None
        if p.name in EDGE_PSEUDO:
            kind, into = EDGE_PSEUDO[p.name]
            other, own = ("src", "dst") if into else ("dst", "src")
            target = inner if inner is not None else self.symbols.select("path")
            hit = self.kind(kind).join(target, F.col(other) == F.col("path"), "left_semi").select(F.col(own).alias("path")).distinct()
            return rows.join(hit, "path", "left_semi")
        if p.name == "not":
            return rows if inner is None else rows.join(inner, "path", "left_anti")
        if p.name == "has" and inner is not None:
            return rows.join(inner.select(F.explode(paths.ancestors_of(F.col("path"))).alias("path")).distinct(), "path", "left_semi")
        if p.name == "in" and isinstance(p.argument, str):
            return rows.where((F.col("path") == p.argument) | F.col("path").startswith(p.argument + ">") | F.col("path").startswith(p.argument + "/"))
        position = {"first-child": F.col("nth_") == 1, "last-child": F.col("nth_") == F.col("of_"), "only-child": F.col("of_") == 1}.get(p.name)
        if p.name == "nth-child" and isinstance(p.argument, int):
            position = F.col("nth_") == p.argument
        if position is None:
            return rows.where(F.lit(False))
        family = Window.partitionBy("parent_path")
        placed = self.symbols.select("path", F.row_number().over(family.orderBy("path")).alias("nth_"), F.count("*").over(family).alias("of_"))
        return rows.join(placed.where(position).select("path"), "path", "left_semi")
