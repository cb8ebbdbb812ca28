"""Source files to nodes and edges.

Python is parsed with its own parser, other languages with a pack of patterns (definitions, imports, calls). A
pack is a callable (path, text) -> rows; register() adds one. Files are read with the binaryFile source and
extracted by the piece; a file that can't be read or parsed gives an error row and stops nothing.
"""

from __future__ import annotations

import ast
import fnmatch
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.imports import alias_target, chain, python_relative, typescript_relative
from ..graph import SymbolGraph
from ..schema import SPAN

Rows = list[tuple]
#: Rows that leave a task at once.
ROWS = 20_000
ROW = f"what string, path string, node_kind string, span {SPAN}, kind string, dst string"
#: Suffix of a definition to a node kind; others give none.
DEFINITION_KINDS = {
    "module": "module", "mod": "module", "function": "function", "method": "method", "class": "class", "struct": "struct", "enum": "enum", "interface": "interface", "trait": "interface",
    "type_alias": "type_alias", "associated_type": "type_alias", "const": "constant", "constant": "constant", "static": "constant", "associated_const": "constant", "variable": "variable", "template_function": "function",
}


def _node(path: str, kind: str | None, span: tuple | None) -> tuple:
    return ("node", path, kind, span, None, None)


def _edge(kind: str, src: str, dst: str) -> tuple:
    return ("edge", src, None, None, kind, dst)


class _Python(ast.NodeVisitor):
    def __init__(self, path: str, aliases: dict[str, str], defined: dict[str, str]):
        self.path, self.rows, self.scope = path, [], []  # scope: (name, kind)
        self.aliases, self.defined = aliases, defined
        self.typing = 0
        self.line, self.starts = 0, [0]  # lines before this piece; its lines' first bytes

    def at(self, piece: str) -> None:
        """The next piece of the text."""
        self.line, starts = self.line + len(self.starts) - 1, [self.starts[-1]]
        for line in piece.encode().splitlines(keepends=True):
            starts.append(starts[-1] + len(line))
        self.starts = starts

    def span(self, n) -> tuple:
        return (self.line + n.lineno, n.col_offset, self.line + n.end_lineno, n.end_col_offset, self.starts[n.lineno - 1] + n.col_offset, self.starts[n.end_lineno - 1] + n.end_col_offset)

    def here(self) -> str:
        return ">".join([self.path, *(n for n, _ in self.scope)])

    def caller(self) -> str:
        """The nearest enclosing function with its classes, or the file."""
        for i in range(len(self.scope), 0, -1):
            if self.scope[i - 1][1] == "function":
                return ">".join([self.path, *(n for n, _ in self.scope[:i])])
        return self.path

    def _define(self, n, kind: str) -> None:
        in_class = bool(self.scope) and self.scope[-1][1] == "class"
        path, parent = f"{self.here()}>{n.name}", self.here()
        self.rows += [_node(path, "method" if kind == "function" and in_class else kind, self.span(n)), _edge("contains", parent, path)]
        self.scope.append((n.name, kind))
        self.generic_visit(n)
        self.scope.pop()

    def visit_FunctionDef(self, n) -> None:
        self._define(n, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, n) -> None:
        for b in n.bases:
            name = _dotted(b)
            if name:
                self.rows.append(_edge("extends", f"{self.here()}>{n.name}", self.target(name)))
        self._define(n, "class")

    def visit_If(self, n) -> None:
        checking = _dotted(n.test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING")
        self.typing += checking
        for x in n.body:
            self.visit(x)
        self.typing -= checking
        for x in n.orelse:
            self.visit(x)
        self.visit(n.test)

    def visit_Import(self, n) -> None:
        for a in n.names:
            self.rows.append(_edge(self.import_kind(), self.path, a.name))

    def visit_ImportFrom(self, n) -> None:
        module = "." * n.level + (n.module or "")
        for a in n.names:
            if a.name == "*" or n.module:
                self.rows.append(_edge(self.import_kind(), self.path, python_relative(self.path, module) or module))
            if a.name != "*":
                self.rows.append(_edge(self.import_kind(), self.path, self.aliases[a.asname or a.name]))

    def import_kind(self) -> str:
        return "type_imports" if self.typing else "imports"

    def target(self, name: str) -> str:
        """Path for a dotted name: through the import aliases, then this file's own names, else a bare stub of its last part."""
        head, _, rest = name.partition(".")
        if head in self.aliases:
            return chain(self.aliases, ">".join([head, *filter(None, rest.split("."))]))
        if not rest and head in self.defined:
            return self.defined[head]
        return name.rpartition(".")[2]

    def visit_Call(self, n) -> None:
        name = _dotted(n.func)
        if name:
            head, _, rest = name.partition(".")
            classes = [i for i, (_, k) in enumerate(self.scope) if k == "class"]
            if head in ("self", "cls") and rest and "." not in rest and classes:
                dst = ">".join([self.path, *(s for s, _ in self.scope[: classes[-1] + 1]), rest])
            else:
                dst = self.target(name)
            self.rows.append(_edge("calls", self.caller(), dst))
        for a in [*n.args, *(k.value for k in n.keywords)]:
            if isinstance(a, ast.Name) and (a.id in self.defined or a.id in self.aliases):
                self.rows.append(_edge("calls", self.caller(), self.target(a.id)))
        self.generic_visit(n)


def _dotted(n) -> str | None:
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    if isinstance(n, ast.Name):
        return ".".join([n.id, *reversed(parts)])
    return parts[0] if parts else None


#: Signs of a piece of Python source that is parsed at once; trees deeper than this may be too deep to visit.
PIECE, DEEP = 200_000, 100
_TOP = re.compile(r"^(?:class|def|async|import|from|@)\b|^@", re.MULTILINE)


def _pieces(text: str) -> Iterator[tuple[str, ast.Module]]:
    """The text in pieces of whole top-level statements, with their trees: a piece that can't be parsed grows, to the end if need be."""
    at, size = 0, PIECE
    while at < len(text):
        m = _TOP.search(text, at + size) if at + size < len(text) else None
        piece = text[at : m.start()] if m else text[at:]
        try:
            tree = ast.parse(piece)
        except SyntaxError:
            if not m:
                ast.parse(text)  # for the error's place in the whole text
                raise
            size *= 2
            continue
        yield piece, tree
        at, size = at + len(piece), PIECE


def _by_depth(tree: ast.AST) -> Iterator[tuple[int, ast.AST]]:
    """Nodes with their depth, in the order of ast.walk."""
    level, depth = [tree], 0
    while level:
        yield from ((depth, n) for n in level)
        level, depth = [c for n in level for c in ast.iter_child_nodes(n)], depth + 1


def python_rows(path: str, text: str) -> Iterator[Rows]:
    """The rows of a Python file by piece. The first pass takes names and finds all errors, the second yields rows: no more than a piece's tree is held."""
    imported: list[tuple[int, dict[str, str]]] = []
    defined: dict[str, str] = {}
    deepest = 0
    for _, tree in _pieces(text):
        for depth, n in _by_depth(tree):
            if isinstance(n, ast.Import):
                imported.append((depth, {a.asname: a.name for a in n.names if a.asname} | {a.name: a.name for a in n.names if not a.asname and "." not in a.name}))
            elif isinstance(n, ast.ImportFrom):
                imported.append((depth, {a.asname or a.name: alias_target(path, "." * n.level + (n.module or ""), a.name, a.asname or a.name) for a in n.names if a.name != "*"}))
            deepest = max(deepest, depth)
        defined |= {n.name: f"{path}>{n.name}" for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}
    aliases: dict[str, str] = {}
    for _, names in sorted(imported, key=lambda x: x[0]):
        aliases |= names
    v = _Python(path, aliases, defined)
    for piece, tree in _pieces(text):
        v.at(piece)
        v.visit(tree)
        if deepest <= DEEP:
            yield v.rows
            v.rows = []
    yield v.rows


def extract_python(path: str, text: str) -> Rows:
    return [r for rows in python_rows(path, text) for r in rows]


_NAME = r"([A-Za-z_]\w*)"
#: Language: (definition kind, pattern) pairs, import patterns, whether braces nest definitions.
PATTERNS = {
    "rust": ([("function", rf"\bfn\s+{_NAME}"), ("struct", rf"\bstruct\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("trait", rf"\btrait\s+{_NAME}"), ("mod", rf"\bmod\s+{_NAME}"), ("type_alias", rf"\btype\s+{_NAME}"), ("const", rf"\bconst\s+{_NAME}\s*:"), ("static", rf"\bstatic\s+(?:mut\s+)?{_NAME}")], [r"\buse\s+([\w:]+)"]),
    "javascript": ([("function", rf"\bfunction\s*\*?\s*{_NAME}"), ("class", rf"\bclass\s+{_NAME}"), ("method", rf"^[ \t]+(?:async\s+|static\s+)*{_NAME}\s*\([^)\n]*\)\s*\{{")], [r"\bimport\s+(?:[^'\";\n]*?\bfrom\s+)?['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]"]),
    "go": ([("function", rf"\bfunc\s+(?:\([^)]*\)\s*)?{_NAME}"), ("type", rf"\btype\s+{_NAME}"), ("const", rf"\bconst\s+{_NAME}"), ("variable", rf"\bvar\s+{_NAME}")], [r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"]),
    "java": ([("class", rf"\bclass\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("method", rf"^[ \t]+(?:[\w<>\[\],]+[ \t]+)+{_NAME}\s*\([^)\n]*\)\s*(?:throws[^{{\n]*)?\{{")], [r"\bimport\s+(?:static\s+)?([\w.]+)\s*;"]),
    "c": ([("function", rf"^(?:[\w*]+[ \t]+)+\**{_NAME}\s*\([^;\n]*\)\s*\{{"), ("type", rf"\b(?:struct|enum|union)\s+{_NAME}\s*\{{")], [r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"]),
    "cpp": ([("class", rf"\bclass\s+{_NAME}"), ("struct", rf"\bstruct\s+{_NAME}"), ("enum", rf"\benum\s+(?:class\s+)?{_NAME}"), ("namespace", rf"\bnamespace\s+{_NAME}"), ("function", rf"^(?:[\w:*&<>]+[ \t]+)+[*&]*{_NAME}\s*\([^;\n]*\)\s*(?:const\s*)?\{{")], [r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"]),
    "csharp": ([("class", rf"\bclass\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("struct", rf"\bstruct\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("namespace", rf"\bnamespace\s+([\w.]+)"), ("method", rf"^[ \t]+(?:[\w<>\[\],]+[ \t]+)+{_NAME}\s*\([^)\n]*\)\s*\{{?$")], [r"\busing\s+([\w.]+)\s*;"]),
    "ruby": ([("module", rf"^\s*module\s+{_NAME}"), ("class", rf"^\s*class\s+{_NAME}"), ("method", rf"^[ \t]+def\s+(?:self\.)?{_NAME}"), ("function", rf"^def\s+{_NAME}")], [r"\brequire(?:_relative)?\s+['\"]([^'\"]+)['\"]"]),
}
PATTERNS["typescript"] = ([*PATTERNS["javascript"][0], ("interface", rf"\binterface\s+{_NAME}"), ("type_alias", rf"\btype\s+{_NAME}\s*[<=]")], PATTERNS["javascript"][1])
_EXTENDS = re.compile(rf"\bclass\s+{_NAME}\s+extends\s+{_NAME}")
_IMPLEMENTS = re.compile(rf"\bclass\s+{_NAME}[^{{\n]*\bimplements\s+([\w\s,]+?)\s*\{{")
_CALL = re.compile(rf"(?<![\w.]){_NAME}\s*\(|\.{_NAME}\s*\(")
_KEYWORDS = set("if for while switch catch return match fn func function def class struct enum sizeof new super self this elif else loop unless until not and or in print assert".split())


def extract_patterns(language: str) -> Callable[[str, str], Rows]:
    """A pack from patterns: definitions by line, a method under the last class or struct above it that is less indented."""
    definitions, imports = PATTERNS[language]
    compiled = [(k, re.compile(p, re.MULTILINE | re.ASCII)) for k, p in definitions]

    def extract(path: str, text: str) -> Rows:
        rows: Rows = []
        found: dict[int, tuple[str, str, int]] = {}
        for kind, pattern in compiled:
            for m in pattern.finditer(text):
                if m[1] not in _KEYWORDS and m.start(1) not in found:
                    line = text.rfind("\n", 0, m.start(1)) + 1
                    found[m.start(1)] = (kind, m[1], len(text[line:]) - len(text[line:].lstrip(" \t")))
        holders: list[tuple[int, str]] = []
        scopes: list[tuple[int, str]] = []
        names: dict[str, str] = {}
        for at in sorted(found):
            kind, name, indent = found[at]
            while holders and holders[-1][0] >= indent:
                holders.pop()
            inside = holders[-1][1] if holders and (kind in ("method", "function")) else path
            node = f"{inside}>{name}"
            span = _line_span(text, at, name)
            wire = DEFINITION_KINDS.get(kind)
            rows += [_node(node, "method" if wire == "function" and inside != path else wire, span), _edge("contains", inside, node)]
            if kind in ("class", "struct", "trait", "interface", "enum", "mod", "module"):
                holders.append((indent, node))
            if kind in ("function", "method"):
                scopes.append((at, node))
            names.setdefault(name, node)
        for pattern in imports:
            for m in re.finditer(pattern, text, re.MULTILINE):
                kind = "type_imports" if language == "typescript" and re.match(r"import\s+type\b", m[0]) else "imports"
                rows.append(_edge(kind, path, (typescript_relative(path, m[1]) if language in ("javascript", "typescript") else None) or m[1]))
        if language in ("java", "typescript", "javascript"):
            rows += [_edge("extends", names.get(m[1], m[1]), names.get(m[2], m[2])) for m in _EXTENDS.finditer(text)]
            rows += [_edge("implements", names.get(m[1], m[1]), names.get(i.strip(), i.strip())) for m in _IMPLEMENTS.finditer(text) for i in m[2].split(",") if i.strip()]
        i = 0
        for m in _CALL.finditer(text):
            name, at = m[1] or m[2], m.start(1) if m[1] else m.start(2)
            if name in _KEYWORDS or at in found:
                continue
            while i + 1 < len(scopes) and scopes[i + 1][0] < at:
                i += 1
            caller = scopes[i][1] if scopes and scopes[i][0] < at else path
            rows.append(_edge("calls", caller, names.get(name, name)))
        return rows

    return extract


def _line_span(text: str, at: int, name: str) -> tuple:
    line, start = text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at) - 1
    first = len(text[:at].encode())
    return (line, start, line, start + len(name), first, first + len(name.encode()))


PACKS: dict[str, Callable[[str, str], Rows]] = {"py": extract_python, "pyi": extract_python}
for _language, _extensions in {"javascript": "js jsx", "typescript": "ts tsx", "rust": "rs", "go": "go", "java": "java", "c": "c h", "ruby": "rb", "cpp": "cpp cc cxx hpp", "csharp": "cs"}.items():
    PACKS |= dict.fromkeys(_extensions.split(), extract_patterns(_language))


def register(extension: str, pack: Callable[[str, str], Rows]) -> None:
    """Adds or replaces the pack of an extension."""
    PACKS[extension] = pack


def extract_parts(path: str, content: bytes) -> Iterator[Rows]:
    """The rows of a file by and by: its own node first, or one error row alone. An unknown or compound extension gives none."""
    base = path.rpartition("/")[2]
    ext = base.rpartition(".")[2]
    if base.count(".") != 1 or ext not in PACKS:
        return
    try:
        text = content.decode()
        file = _node(path, "file", (1, 0, text.count("\n") + 1, len(text) - text.rfind("\n") - 1, 0, len(content)))
        parts = python_rows(path, text) if PACKS[ext] is extract_python else iter([PACKS[ext](path, text)])
        first = next(parts)
    except (SyntaxError, UnicodeDecodeError, ValueError, RecursionError) as e:
        yield [("error", path, type(e).__name__, None, None, str(e)[:200])]
        return
    yield [file, *first]
    yield from parts


def extract(path: str, content: bytes) -> Rows:
    """All rows of a file."""
    return [r for rows in extract_parts(path, content) for r in rows]


def _ignored(path: str, rules: list[str]) -> bool:
    parts = path.split("/")
    if "target" in parts[:-1] or ".git" in parts[:-1]:
        return True
    hit = False
    for rule in rules:
        keep, rule = rule.startswith("!"), rule.lstrip("!").rstrip("/")
        names = [path] if "/" in rule.strip("/") else parts
        prefixes = ["/".join(parts[: i + 1]) for i in range(len(parts))] if "/" in rule else names
        if any(fnmatch.fnmatch(n, rule.lstrip("/")) for n in prefixes):
            hit = not keep
    return hit


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative, with /), content of a tree's files that have a pack; the root's ignore file is honoured."""
    root = root.rstrip("/")
    rules: list[str] = []
    ignore = os.path.join(root.removeprefix("file://"), ".gitignore")
    if os.path.exists(ignore):
        with open(ignore) as f:
            rules = [r.strip() for r in f if r.strip() and not r.startswith("#")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(sorted(PACKS)) + "}").load(root)
    bare = root.removeprefix("file://")
    relative = F.substring_index("path", bare + "/", -1)
    skip = F.udf(lambda p: _ignored(p, rules), "boolean")
    return files.select(relative.alias("path"), "content").where(~skip("path"))


def extracted(files: DataFrame) -> DataFrame:
    """Node, edge and error rows of files (path, content)."""

    def frame(rows: Rows) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["what", "path", "node_kind", "span", "kind", "dst"], dtype="object")
        names = ("start_line", "start_col", "end_line", "end_col", "start_byte", "end_byte")
        out["span"] = [None if s is None else dict(zip(names, s)) for s in out["span"]]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: Rows = []
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"]):
                for more in extract_parts(p, bytes(c)):
                    rows += more
                    if len(rows) >= ROWS:
                        yield from (frame(rows[i : i + ROWS]) for i in range(0, len(rows), ROWS))
                        rows = []
        if rows:
            yield frame(rows)

    return files.mapInPandas(run, ROW)


def graph_of(files: DataFrame) -> tuple[SymbolGraph, DataFrame]:
    """(graph with stubs resolved, errors: path, error, message) of files (path, content). What an edge names becomes a node."""
    from ..plans.tables import written

    rows = written(extracted(files), "extracted")
    edges = rows.where("what = 'edge'").select("kind", F.col("path").alias("src"), "dst").distinct()
    nodes = rows.where("what = 'node'").select("path", "node_kind", "span").dropDuplicates(["path"])
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct().join(nodes.select("path"), "path", "left_anti")
    loose = ends.select("path", F.lit(None).cast("string").alias("node_kind"), F.lit(None).cast(SPAN).alias("span"))
    graph = SymbolGraph(nodes.unionByName(loose), edges).written()
    return graph.resolve_stubs().written(), rows.where("what = 'error'").select("path", F.col("node_kind").alias("error"), F.col("dst").alias("message"))


def index(spark: SparkSession, root: str) -> tuple[SymbolGraph, DataFrame]:
    """graph_of() a folder."""
    return graph_of(source_files(spark, root))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content differs from known (path, digest): only these need extraction again."""
    digest = files.withColumn("digest", F.sha2("content", 256))
    return digest.join(known.select("path", "digest"), ["path", "digest"], "left_anti")


def sync_files(graph: SymbolGraph, files: DataFrame) -> tuple[SymbolGraph, DataFrame]:
    """Takes up changed files (path, content; null content: the file is gone) at once: (the new graph, file, symbols before, symbols after)."""
    from ..plans.tables import written

    names = written(files.select(F.col("path").alias("file")).distinct(), "synced")
    new, _ = graph_of(files.where("content IS NOT NULL"))
    out = graph.replace_files(names, new).written().resolve_stubs().written()
    count = lambda g, c: g.symbols.join(names, "file", "left_semi").groupBy("file").agg(F.count("*").alias(c))
    zero = F.lit(0).cast("long")
    counts = names.join(count(graph, "before"), "file", "left").join(count(out, "after"), "file", "left")
    return out, counts.select("file", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))
