"""Fixed vocabularies and limits of the data model."""

from __future__ import annotations

NODE_KINDS = (
    "file", "module", "class", "struct", "interface", "function", "method", "property", "field", "variable", "constant", "enum", "enum_member", "type_alias",
    "parameter", "import", "export", "route", "component",
)
EDGE_KINDS = (
    "contains", "calls", "imports", "type_imports", "exports", "extends", "implements", "references", "type_of", "returns", "instantiates", "overrides",
    "decorates", "aggregates", "composes", "uses",
)
#: Kinds that queries take.
QUERY_KINDS = ("calls", "imports", "extends", "implements")
SPAN = "struct<start_line:int,start_col:int,end_line:int,end_col:int,start_byte:int,end_byte:int>"
NODES = f"path string, node_kind string, span {SPAN}"
EDGES = "kind string, src string, dst string"
TOP_LIMIT, DEPTH_LIMIT, TREE_DEPTH = 100, 20, 10


def edge_kind(kind: str, of: tuple[str, ...] = QUERY_KINDS) -> str:
    """The kind in lower case; an error if queries don't take it."""
    low = kind.lower()
    if low not in of:
        raise ValueError(f"unknown edge kind {kind!r}: one of {', '.join(of)}")
    return low
