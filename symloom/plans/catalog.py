"""The registered queries over the derived graph, each with its DuckDB statement where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..graph import SymbolGraph
from ..sources.derived import DERIVED_SQL, derived_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: End of an edge and its kind, by the name that the statements use for the path most often there.
_PICKS = {"caller": ("calls", "src"), "callee": ("calls", "dst"), "sub": ("extends", "src"), "sup": ("extends", "dst"), "impr": ("imports", "src"), "impd": ("imports", "dst"), "imple": ("implements", "src"), "iface": ("implements", "dst")}


def pick(g: SymbolGraph, name: str) -> str:
    """The path that is most often at that end of an edge: a parameter that holds at every scale. One row."""
    kind, end = _PICKS[name]
    known = g.__dict__.setdefault("picked", {})
    if name not in known:
        known[name] = g.kind(kind).groupBy(end).agg(F.count("*").alias("n")).orderBy(F.desc("n"), end).first()[end]
    return known[name]


def _add(name: str, run: Callable, sql: str | None, *picks: str) -> None:
    """run(graph, *picked paths) -> DataFrame."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = derived_graph(spark, sf_dir)
        return run(g, *(pick(g, p) for p in picks))

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = DERIVED_SQL + sql


def _flat(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({a: F.array_join(a, " | ") for a in arrays})


# Lookups
_add("lookup", lambda g, p: g.lookup(p), "SELECT path FROM nodes WHERE path = (SELECT p FROM caller)", "caller")
_add("get_node_kind", lambda g, p: g.get_node_kind(p), "SELECT path, node_kind AS kind FROM nodes WHERE path = (SELECT p FROM caller)", "caller")
_add("get_source_span", lambda g, p: g.get_source_span(p), "SELECT path, CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS start_col, CAST(NULL AS INTEGER) AS end_line, CAST(NULL AS INTEGER) AS end_col, CAST(NULL AS INTEGER) AS start_byte, CAST(NULL AS INTEGER) AS end_byte FROM nodes WHERE path = (SELECT p FROM caller)", "caller")
_add("all_symbols", lambda g: g.all_symbols("src/b1", "function"), "SELECT path FROM sym WHERE starts_with(path, 'src/b1') AND node_kind = 'function'")
_add("all_symbols__page", lambda g: g.all_symbols(offset=10, limit=25), "SELECT path FROM sym ORDER BY path LIMIT 25 OFFSET 10")
_add("symbols_of_kind", lambda g: g.symbols_of_kind("method"), "SELECT path FROM nodes WHERE node_kind = 'method'")
_add("search_symbol", lambda g: g.search_symbol("PROMO"), "SELECT path FROM nodes WHERE contains(lower(name), 'promo') ORDER BY path LIMIT 20")
_add("all_file_paths", lambda g: g.all_file_paths(), "SELECT path FROM nodes WHERE NOT is_symbol")
_add("symbols_in_file", lambda g, p: g.symbols_in_file(p), "SELECT path FROM sym WHERE file = (SELECT p FROM impd)", "impd")
_add("entry_points", lambda g: g.entry_points(), "SELECT path FROM sym WHERE path NOT IN (SELECT dst FROM calls)")
_add("dead_symbols", lambda g: g.dead_symbols(), "SELECT path FROM sym WHERE path NOT IN (SELECT dst FROM calls UNION ALL SELECT dst FROM imports)")
_add("dead_symbols_for_kind", lambda g: g.dead_symbols_for_kind("extends"), "SELECT path FROM sym WHERE path NOT IN (SELECT dst FROM ext)")
_add("isolated_symbols", lambda g: g.isolated_symbols(), "SELECT path FROM sym WHERE path NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges)")
_add("leaf_symbols", lambda g: g.leaf_symbols(), "SELECT path FROM sym WHERE path NOT IN (SELECT src FROM calls) ORDER BY path LIMIT 100")
_add("singly_referenced", lambda g: g.singly_referenced(), "SELECT path, (SELECT src FROM calls WHERE dst = path) AS referencer FROM deg WHERE i = 1 ORDER BY path LIMIT 100")
_INFO = """, asked(pos, path) AS (SELECT 0, p FROM caller UNION ALL SELECT 1, p FROM callee UNION ALL SELECT 2, 'no such path' UNION ALL SELECT 3, p FROM sup)
SELECT pos, path, path IN (SELECT path FROM nodes) AS found,
  coalesce((SELECT string_agg(n.path, ' | ' ORDER BY length(n.path) DESC) FROM nodes n WHERE starts_with(asked.path, n.path || '>')), '') AS ancestors,
  coalesce((SELECT string_agg(n.path, ' | ' ORDER BY n.path) FROM nodes n WHERE starts_with(n.path, asked.path || '>')), '') AS descendants,
  coalesce((SELECT string_agg(src, ' | ' ORDER BY src) FROM calls WHERE dst = asked.path), '') AS callers,
  coalesce((SELECT string_agg(dst, ' | ' ORDER BY dst) FROM calls WHERE src = asked.path), '') AS callees FROM asked"""
_add("batch_symbol_info", lambda g, a, b, c: _flat(g.symbol_info([a, b, "no such path", c]), "ancestors", "descendants", "callers", "callees"), _INFO, "caller", "callee", "sup")
_add("symbol_info", lambda g, a: _flat(g.symbol_info([a]), "ancestors", "descendants", "callers", "callees"), _INFO + " WHERE pos = 0", "caller")
_add("edge_counts", lambda g: g.edge_counts(), "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
_add("server_status", lambda g: g.edge_counts().withColumn("is_loaded", F.lit(True)), "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, true AS is_loaded")
_add("heap_estimate", lambda g: g.heap_estimate(), "SELECT 256 * (SELECT count(*) FROM nodes) + 24 * (SELECT count(*) FROM edges) AS bytes")

# Hierarchy
_add("ancestors", lambda g, p: g.ancestors(p), "SELECT CAST(row_number() OVER (ORDER BY length(path) DESC) AS INTEGER) AS pos, path FROM nodes WHERE starts_with((SELECT p FROM caller), path || '>')", "caller")
_add("descendants", lambda g, p: g.descendants(p), "SELECT path FROM nodes WHERE starts_with(path, (SELECT p FROM sup) || '>')", "sup")
_add("inherited_descendants", lambda g, p: g.inherited_descendants(p), "SELECT DISTINCT n.path, e.dst AS base FROM ext e JOIN nodes n ON starts_with(n.path, e.dst || '>') WHERE e.src = (SELECT p FROM sub) AND n.name NOT IN (SELECT name FROM nodes WHERE starts_with(path, (SELECT p FROM sub) || '>'))", "sub")
_add("siblings", lambda g, p: g.siblings(p), "SELECT path FROM nodes WHERE parent_path = (SELECT parent_path FROM nodes WHERE path = (SELECT p FROM caller)) AND path <> (SELECT p FROM caller)", "caller")
_add("contains_edges", lambda g: g.contains_edges(), "SELECT src, dst FROM edges WHERE kind = 'contains'")
_add("top_files", lambda g: g.top_files(), "SELECT parent_path AS path, count(*) AS children FROM nodes WHERE depth = 2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
_add("remove_subtree", lambda g, p: g.remove_subtree(p).nodes.select("path", "node_kind"), "SELECT path, node_kind FROM nodes WHERE path <> (SELECT p FROM sup) AND NOT starts_with(path, (SELECT p FROM sup) || '>')", "sup")

# One hop
_add("callees", lambda g, p: g.callees(p), "SELECT dst AS path FROM calls WHERE src = (SELECT p FROM caller)", "caller")
_add("callers", lambda g, p: g.callers(p), "SELECT src AS path FROM calls WHERE dst = (SELECT p FROM callee)", "callee")
_VIRTUAL = "SELECT c.src AS path FROM calls c WHERE c.dst IN (SELECT e.dst || '>' || n.name FROM ext e JOIN nodes n ON n.parent_path = e.src WHERE n.path = (SELECT p FROM callee))"
_add("callers__virtual", lambda g, p: g.callers(p, include_virtual=True), "SELECT src AS path FROM calls WHERE dst = (SELECT p FROM callee) UNION " + _VIRTUAL, "callee")
_add("virtual_dispatch_callers", lambda g, p: g.virtual_dispatch_callers(p), "SELECT DISTINCT path FROM (" + _VIRTUAL + ")", "callee")
for _name, _p, _k, _out, _in in (("imports_of", "impd", "imports", "imports", "imported_by"), ("get_extends", "sup", "ext", "extends", "extended_by"), ("get_implements", "iface", "impl", "implements", "implemented_by")):
    _add(_name, lambda g, p, n=_name: getattr(g, n)(p), f"SELECT '{_out}' AS direction, dst AS path FROM {_k} WHERE src = (SELECT p FROM {_p}) UNION ALL SELECT '{_in}', src FROM {_k} WHERE dst = (SELECT p FROM {_p})", _p)
_LISTS = ", ".join("coalesce(string_agg(%s, ' | ' ORDER BY %s) FILTER (kind = '{0}'), '') AS {1}".format(k, n) for k, n in zip(("calls", "imports", "extends", "implements"), ("{0}", "{1}", "{2}", "{3}")))
_add("cross_refs", lambda g, p: _flat(g.cross_refs(p), "callers", "importers", "extended_by", "implemented_by"), "SELECT " + _LISTS.replace("%s", "src").format("callers", "importers", "extended_by", "implemented_by") + " FROM edges WHERE dst = (SELECT p FROM sup)", "sup")
_add("outgoing_refs", lambda g, p: _flat(g.outgoing_refs(p), "callees", "imports", "extends", "implements"), "SELECT " + _LISTS.replace("%s", "dst").format("callees", "imports", "extends", "implements") + " FROM edges WHERE src = (SELECT p FROM caller)", "caller")
_add("symbol_neighborhood", lambda g, p: g.symbol_neighborhood(p), "SELECT 'outgoing' AS direction, dst AS path FROM calls WHERE src = (SELECT p FROM caller) UNION ALL SELECT 'incoming', src FROM calls WHERE dst = (SELECT p FROM caller)", "caller")
_add("common_callers", lambda g, a, b: g.common_callers([a, b]), "SELECT src AS path FROM calls WHERE dst IN (SELECT p FROM caller UNION SELECT p FROM callee) GROUP BY src HAVING count(DISTINCT dst) = (SELECT count(*) FROM (SELECT p FROM caller UNION SELECT p FROM callee))", "caller", "callee")
_add("common_callees", lambda g, a, b: g.common_callees([a, b], "extends"), "SELECT dst AS path FROM ext WHERE src IN (SELECT p FROM sub UNION SELECT p FROM sup) GROUP BY dst HAVING count(DISTINCT src) = (SELECT count(*) FROM (SELECT p FROM sub UNION SELECT p FROM sup))", "sub", "sup")
_add("two_hop", lambda g, p: g.two_hop(p), "SELECT DISTINCT b.dst AS path FROM calls a JOIN calls b ON a.dst = b.src WHERE a.src = (SELECT p FROM caller) AND contains(b.dst, '>') AND b.dst <> (SELECT p FROM caller) AND b.dst NOT IN (SELECT dst FROM calls WHERE src = (SELECT p FROM caller))", "caller")
_NEAR = "(SELECT DISTINCT CASE WHEN src = (SELECT p FROM {0}) THEN dst ELSE src END AS n FROM calls WHERE ((SELECT p FROM {0}) IN (src, dst)) AND src <> dst)"
_add("neighbor_similarity", lambda g, a, b: g.neighbor_similarity(a, b), f", x AS {_NEAR.format('caller')}, y AS {_NEAR.format('callee')}, c AS (SELECT (SELECT count(*) FROM x WHERE n IN (SELECT n FROM y)) AS shared, (SELECT count(*) FROM (SELECT n FROM x UNION SELECT n FROM y)) AS total) SELECT coalesce(shared / nullif(total, 0), 0.0) AS similarity, shared, total FROM c", "caller", "callee")
_add("clustering_coefficient", lambda g, p: g.clustering_coefficient(p), f", x AS {_NEAR.format('caller')}, c AS (SELECT (SELECT count(*) FROM x WHERE contains(n, '>')) AS neighbors, (SELECT count(*) FROM calls WHERE src IN (SELECT n FROM x) AND dst IN (SELECT n FROM x)) AS edges) SELECT coalesce(edges / nullif(neighbors * (neighbors - 1), 0), 0.0) AS coefficient, neighbors, edges FROM c", "caller")

# Degrees
_DEG = ", ".join(f"(SELECT count(*) FROM edges WHERE kind = '{k}' AND {e} = asked.path) AS {k}_{w}" for k in ("calls", "imports", "extends", "implements") for w, e in (("in", "dst"), ("out", "src")))
_add("node_degree", lambda g, p: g.node_degree([p]), f", asked(pos, path) AS (SELECT 0, p FROM caller) SELECT pos, path, {_DEG} FROM asked", "caller")
_add("batch_node_degree", lambda g, a, b: g.batch_node_degree([b, a, "no such path"]), f", asked(pos, path) AS (SELECT 0, p FROM sup UNION ALL SELECT 1, p FROM caller UNION ALL SELECT 2, 'no such path') SELECT pos, path, {_DEG} FROM asked", "caller", "sup")
_add("rank_symbols", lambda g: g.rank_symbols(), "SELECT dst AS path, count(*) AS n FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("rank_symbols__imports", lambda g: g.rank_symbols("IMPORTS"), "SELECT dst AS path, count(*) AS n FROM imports GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("fan_in_rank", lambda g: g.fan_in_rank(), "SELECT dst AS path, count(*) AS n FROM calls WHERE contains(dst, '>') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("fan_out_rank", lambda g: g.fan_out_rank(), "SELECT src AS path, count(*) AS n FROM calls WHERE contains(src, '>') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("most_connected", lambda g: g.most_connected(), "SELECT path, i + o AS n FROM deg WHERE i + o > 0 ORDER BY 2 DESC, 1 LIMIT 10")
_add("hub_symbols", lambda g: g.hub_symbols(), "SELECT path, i AS in_degree, o AS out_degree FROM deg WHERE i >= 2 AND o >= 2 ORDER BY i + o DESC, path LIMIT 100")
_add("degree_centrality", lambda g: g.degree_centrality(), "SELECT path, i AS in_degree, o AS out_degree, i / ((SELECT count(*) FROM sym) - 1) AS in_centrality, o / ((SELECT count(*) FROM sym) - 1) AS out_centrality FROM deg")
_add("degree_histogram", lambda g: g.degree_histogram(), "SELECT 'in' AS direction, i AS degree, count(*) AS n FROM deg GROUP BY i UNION ALL SELECT 'out', o, count(*) FROM deg GROUP BY o")
_add("graph_metrics", lambda g: g.graph_metrics(), "SELECT count(*) AS symbol_count, CAST(sum(o) AS BIGINT) AS edge_count, sum(o) / (count(*) * (count(*) - 1)) AS density, sum(o) / count(*) AS avg_degree, max(i) AS max_in, max(o) AS max_out FROM deg")
_add("graph_stats", lambda g: g.graph_stats(), "SELECT 'nodes' AS what, node_kind AS kind, count(*) AS n FROM nodes GROUP BY GROUPING SETS ((node_kind), ()) UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY GROUPING SETS ((kind), ())")
_add("symbol_count_by_kind", lambda g: g.symbol_count_by_kind(), "SELECT node_kind AS kind, count(*) AS n FROM nodes GROUP BY 1")
_add("page_rank", lambda g: g.page_rank().select("path", F.round("score", 12).alias("score")), """, n AS (SELECT count(*) AS n FROM sym), w AS (SELECT src, count(*) AS k FROM calls GROUP BY src),
pr(i, path, s) AS (SELECT 0, path, 1.0::DOUBLE / n FROM sym, n UNION ALL
  SELECT i, path, sum(s) FROM (
    SELECT pr.i + 1 AS i, c.dst AS path, 0.85 * pr.s / w.k AS s FROM pr JOIN calls c ON c.src = pr.path JOIN w ON w.src = pr.path WHERE pr.i < 20
    UNION ALL SELECT t.i, sym.path, t.s FROM (SELECT pr.i + 1 AS i, 0.15 / max(n.n) + 0.85 * coalesce(sum(pr.s) FILTER (w.k IS NULL), 0) / max(n.n) AS s FROM pr LEFT JOIN w ON w.src = pr.path CROSS JOIN n WHERE pr.i < 20 GROUP BY pr.i) t CROSS JOIN sym) GROUP BY i, path)
SELECT path, round(s, 12) AS score FROM pr WHERE i = 20 ORDER BY s DESC, path LIMIT 10""")

# Reachability
_DOWN = ", r(path, d) AS (SELECT p, 0 FROM {0} UNION SELECT e.{2}, d + 1 FROM r JOIN {4} e ON e.{1} = r.path WHERE d < {3})"
_ALL = ", r(path) AS (SELECT p FROM {0} UNION SELECT e.{2} FROM r JOIN {3} e ON e.{1} = r.path)"
_add("reachable_from", lambda g, p: g.reachable_from(p, max_depth=3), _DOWN.format("caller", "src", "dst", 3, "calls") + " SELECT DISTINCT path FROM r WHERE path NOT IN (SELECT p FROM caller)", "caller")
_add("reachable_to", lambda g, p: g.reachable_to(p, max_depth=3), _DOWN.format("callee", "dst", "src", 3, "calls") + " SELECT DISTINCT path FROM r WHERE path NOT IN (SELECT p FROM callee)", "callee")
_BOTH = "(SELECT p FROM caller UNION SELECT p FROM callee)"
_add("batch_reachable_from", lambda g, a, b: g.batch_reachable_from([a, b], max_depth=2), _DOWN.format(_BOTH, "src", "dst", 2, "calls") + f" SELECT DISTINCT path FROM r WHERE path NOT IN {_BOTH}", "caller", "callee")
_add("batch_reachable_to", lambda g, a, b: g.batch_reachable_to([a, b], max_depth=2), _DOWN.format(_BOTH, "dst", "src", 2, "calls") + f" SELECT DISTINCT path FROM r WHERE path NOT IN {_BOTH}", "caller", "callee")
_add("reachable_set", lambda g, p: g.reachable_set(p, "extends"), _ALL.format("sub", "src", "dst", "ext") + " SELECT path FROM r WHERE path NOT IN (SELECT p FROM sub)", "sub")
_add("reaches_into", lambda g, p: g.reaches_into(p, "extends"), _ALL.format("sup", "dst", "src", "ext") + " SELECT path FROM r WHERE path NOT IN (SELECT p FROM sup)", "sup")
_add("common_reachable", lambda g, a, b: g.common_reachable(a, b, "extends"), ", a(path) AS (SELECT p FROM sub UNION SELECT e.dst FROM a JOIN ext e ON e.src = a.path), b(path) AS (SELECT p FROM sup UNION SELECT e.dst FROM b JOIN ext e ON e.src = b.path) SELECT path FROM a WHERE path IN (SELECT path FROM b) AND path NOT IN (SELECT p FROM sub UNION ALL SELECT p FROM sup)", "sub", "sup")
_add("k_hop", lambda g, p: g.k_hop(p, 2), _DOWN.format("caller", "src", "dst", 2, "calls") + " SELECT path FROM r GROUP BY path HAVING min(d) = 2", "caller")
_add("mutual_reachability", lambda g, a, b: g.mutual_reachability(a, b, "extends"), ", a(path, d) AS (SELECT p, 0 FROM sub UNION SELECT e.dst, d + 1 FROM a JOIN ext e ON e.src = a.path), b(path, d) AS (SELECT p, 0 FROM sup UNION SELECT e.dst, d + 1 FROM b JOIN ext e ON e.src = b.path), m AS (SELECT (SELECT min(d) FROM a WHERE path = (SELECT p FROM sup)) AS forward, (SELECT min(d) FROM b WHERE path = (SELECT p FROM sub)) AS backward) SELECT forward, backward, forward IS NOT NULL AS forward_reachable, backward IS NOT NULL AS backward_reachable, forward IS NOT NULL AND backward IS NOT NULL AS mutual FROM m", "sub", "sup")
_DIST = _DOWN.format("sub", "src", "dst", 100, "ext") + ", dist AS (SELECT path, min(d) AS d FROM r GROUP BY path HAVING min(d) > 0)"
_add("eccentricity", lambda g, p: g.eccentricity(p, "extends"), _DIST + " SELECT coalesce(max(d), 0) AS eccentricity, count(*) AS reachable FROM dist", "sub")
_add("harmonic", lambda g, p: g.harmonic(p, "extends"), _DIST + " SELECT coalesce(sum(1.0::DOUBLE / d), 0) / ((SELECT count(*) FROM sym) - 1) AS score, count(*) AS reachable, (SELECT count(*) FROM sym) AS n FROM dist", "sub")
_add("bfs_hops_query", lambda g, p: g.bfs_hops_query(p, "callers", 2), _DOWN.format("callee", "dst", "src", 2, "calls") + " SELECT DISTINCT path FROM r WHERE path NOT IN (SELECT p FROM callee)", "callee")
_add("query_callers", lambda g, p: g.bfs_hops_query(p, "callers", 1), "SELECT src AS path FROM calls WHERE dst = (SELECT p FROM callee) AND src <> dst", "callee")
_add("query_callees", lambda g, p: g.bfs_hops_query(p, "callees", 2), _DOWN.format("caller", "src", "dst", 2, "calls") + " SELECT DISTINCT path FROM r WHERE path NOT IN (SELECT p FROM caller)", "caller")
_UND = ", und AS (SELECT src, dst FROM edges WHERE kind <> 'implements' UNION SELECT dst, src FROM edges WHERE kind <> 'implements')"
for _name in ("impact", "query_impact"):
    _add(_name, lambda g, p: g.impact(p, max_depth=3), _UND + _DOWN.format("caller", "src", "dst", 3, "und") + " SELECT path, min(d) AS depth FROM r GROUP BY path HAVING min(d) > 0 ORDER BY 2, 1 LIMIT 100", "caller")
_add("dependency_depth", lambda g, p: g.dependency_depth(p, "extends"), ", r(path, d) AS (SELECT p, 0 FROM sup UNION SELECT e.src, d + 1 FROM r JOIN ext e ON e.dst = r.path) SELECT max(d) AS depth FROM r", "sup")

# Paths: from the busiest end to the last by (distance, path) reachable
_WAY = ", r(path, d) AS (SELECT p, 0 FROM {0} UNION SELECT e.dst, d + 1 FROM r JOIN {1} e ON e.src = r.path WHERE d < {2}), far AS (SELECT path FROM r GROUP BY path ORDER BY min(d) DESC, path LIMIT 1), w(path, trail) AS (SELECT p, [p] FROM {0} UNION ALL SELECT e.dst, list_append(trail, e.dst) FROM w JOIN {1} e ON e.src = w.path WHERE len(trail) <= (SELECT min(d) FROM r WHERE path = (SELECT path FROM far))), best AS (SELECT min(trail) AS t FROM w WHERE path = (SELECT path FROM far) AND len(trail) = 1 + (SELECT min(d) FROM r WHERE path = (SELECT path FROM far))) SELECT CAST(i - 1 AS INTEGER) AS pos, t[i] AS path FROM best, generate_series(1, len(t)) s(i)"


def _farthest(g: SymbolGraph, start: str, kind: str, depth: int | None) -> str:
    from ..operators.reach import bfs

    numbers = g.numbers(kind, symbols=False)
    last = bfs(numbers.of(start), numbers.way(), depth).orderBy(F.desc("depth"), "path").first()["path"]
    return numbers.ids.where(F.col("id") == last).first()["path"]


for _name, _p, _table, _kind in (("find_call_path", "caller", "calls", "calls"), ("find_import_path", "impr", "imports", "imports"), ("find_extends_path", "sub", "ext", "extends"), ("find_implements_path", "imple", "impl", "implements")):
    _add(_name, lambda g, p, n=_name, k=_kind: getattr(g, n)(p, _farthest(g, p, k, 3)), _WAY.format(_p, _table, 3), _p)
_add("shortest_path", lambda g, p: g.shortest_path(p, _farthest(g, p, "extends", 4), "extends"), _WAY.format("sub", "ext", 4), "sub")

# Trees
_TREE = ", t(depth, path, trail, again) AS (SELECT 0, p, [p], false FROM {0} UNION ALL SELECT depth + 1, e.{2}, list_append(trail, e.{2}), list_contains(trail, e.{2}) FROM t JOIN {3} e ON e.{1} = t.path WHERE depth < {4} AND NOT again) SELECT depth, path, array_to_string(trail, ' | ') AS trail FROM t"
for _name, _p, _table, _out, _depth in (
    ("callee_tree", "caller", "calls", True, 3), ("caller_tree", "callee", "calls", False, 3), ("import_tree", "impr", "imports", True, 2), ("importers_tree", "impd", "imports", False, 2),
    ("extends_tree", "sub", "ext", True, 4), ("subclasses_tree", "sup", "ext", False, 4), ("implements_tree", "imple", "impl", True, 4), ("implementors_tree", "iface", "impl", False, 4),
):
    _add(_name, lambda g, p, n=_name, d=_depth: _flat(getattr(g, n)(p, d), "trail"), _TREE.format(_p, *(("src", "dst") if _out else ("dst", "src")), _table, _depth), _p)

# Structure
_WCC = """, und(a, b) AS (SELECT src, dst FROM {0} UNION SELECT dst, src FROM {0}),
cc(id, l) USING KEY (id) AS (SELECT path, path FROM sym UNION SELECT u.id, min(v.l) FROM cc v JOIN und x ON x.b = v.id JOIN recurring.cc u ON u.id = x.a WHERE v.l < u.l GROUP BY u.id, u.l),
g AS (SELECT l, count(*) AS n, min(id) AS f FROM cc GROUP BY l), gr AS (SELECT l, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS group_rank FROM g)
SELECT group_rank, id AS member FROM cc JOIN gr USING (l)"""
_add("wcc", lambda g: g.wcc(), _WCC.format("calls"))
_add("wcc__extends", lambda g: g.wcc("extends"), _WCC.format("ext"))
_CLOSURE = ", c(a, b) AS (SELECT src, dst FROM calls UNION SELECT c.a, e.dst FROM c JOIN calls e ON e.src = c.b), rep AS (SELECT x.a AS path, min(least(x.a, x.b)) AS l FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"
_SCC = _CLOSURE + ", s AS (SELECT path, coalesce(l, path) AS l FROM sym LEFT JOIN rep USING (path)), g AS (SELECT l, count(*) AS n, min(path) AS f FROM s GROUP BY l HAVING count(*) >= {0}), gr AS (SELECT l, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS group_rank FROM g) SELECT group_rank, path AS member FROM s JOIN gr USING (l)"
_add("scc", lambda g: g.scc(), _SCC.format(1))
_add("scc_groups", lambda g: g.scc_groups(), _SCC.format(2))
_add("cycle_members", lambda g: g.cycle_members(), _CLOSURE + " SELECT path FROM rep WHERE path IN (SELECT a FROM c x WHERE a <> b AND EXISTS (SELECT 1 FROM c y WHERE y.a = x.b AND y.b = x.a))")
_add("nodes_in_cycles", lambda g: g.nodes_in_cycles("imports"), ", c(a, b) AS (SELECT src, dst FROM imports UNION SELECT c.a, e.dst FROM c JOIN imports e ON e.src = c.b) SELECT a AS path FROM c WHERE a = b")
_add("dependency_layers", lambda g: g.dependency_layers("extends"), ", r(path, d) AS (SELECT path, 0 FROM sym WHERE path NOT IN (SELECT src FROM ext) UNION SELECT e.src, d + 1 FROM r JOIN ext e ON e.dst = r.path) SELECT max(d) AS layer, path FROM r GROUP BY path")
_add("topological_sort", lambda g: g.topological_sort(), None)
_add("topological_sort__cyclic", lambda g: g.topological_sort().where("cyclic").select("path"), ", c(a, b) AS (SELECT src, dst FROM calls UNION SELECT c.a, e.dst FROM c JOIN calls e ON e.src = c.b) SELECT DISTINCT path FROM (SELECT a AS path FROM c WHERE a = b UNION SELECT y.b FROM c x JOIN c y ON y.a = x.a WHERE x.a = x.b)")
_CORE = ", a(i, path) AS (SELECT 0, path FROM sym UNION ALL SELECT i + 1, path FROM (SELECT x.i, x.path FROM a x JOIN {0} e ON x.path IN (e.src, e.dst) JOIN a y ON y.path = CASE WHEN e.src = x.path THEN e.dst ELSE e.src END GROUP BY x.i, x.path HAVING count(*) >= {1}) WHERE i < 40) SELECT path FROM a WHERE i = 40"
_add("k_core", lambda g: g.k_core(2, "extends"), _CORE.format("ext", 2))
_add("k_core__calls", lambda g: g.k_core(3), _CORE.format("calls", 3))
_UNDE = ", und(a, b) AS (SELECT src, dst FROM ext UNION SELECT dst, src FROM ext)"
_add("articulation_points", lambda g: g.articulation_points("extends"), _UNDE + ", r(v, n) AS (SELECT a, min(b) FROM und GROUP BY a UNION SELECT r.v, u.b FROM r JOIN und u ON u.a = r.n WHERE u.b <> r.v) SELECT DISTINCT a AS path FROM und WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.v = und.a AND r.n = und.b)")
_add("bridge_edges", lambda g: g.bridge_edges("extends"), _UNDE + ", r(x, y, v) AS (SELECT a, b, a FROM und WHERE a < b UNION SELECT r.x, r.y, u.b FROM r JOIN und u ON u.a = r.v WHERE NOT (least(u.a, u.b) = r.x AND greatest(u.a, u.b) = r.y)) SELECT a, b FROM und WHERE a < b AND NOT EXISTS (SELECT 1 FROM r WHERE r.x = und.a AND r.y = und.b AND r.v = und.b)")
_add("biconnected_components", lambda g: g.biconnected_components("extends"), _UNDE + """, r(v, s, n) AS (SELECT a, b, b FROM und UNION SELECT r.v, r.s, u.b FROM r JOIN und u ON u.a = r.n WHERE u.b <> r.v),
same AS (SELECT DISTINCT least(r.v, r.s) || ' ' || greatest(r.v, r.s) AS e, least(r.v, r.n) || ' ' || greatest(r.v, r.n) AS f FROM r JOIN und u ON u.a = r.v AND u.b = r.n),
c(e, f) AS (SELECT e, f FROM same UNION SELECT c.e, same.f FROM c JOIN same ON same.e = c.f), blk AS (SELECT e, min(f) AS l FROM c GROUP BY e),
mem AS (SELECT DISTINCT l, m FROM (SELECT l, unnest([a, b]) AS m FROM und JOIN blk ON e = least(a, b) || ' ' || greatest(a, b))),
g AS (SELECT l, CAST(row_number() OVER (ORDER BY list_sort(list(m))) AS INTEGER) AS group_rank FROM mem GROUP BY l) SELECT group_rank, m AS member FROM mem JOIN g USING (l)""")

# Centrality
_PAIRS = ", r(a, b, d) AS (SELECT src, dst, 1 FROM ext UNION SELECT r.a, e.dst, d + 1 FROM r JOIN ext e ON e.src = r.b), dist AS (SELECT a, b, min(d) AS d FROM r WHERE a <> b GROUP BY a, b)"
_add("closeness", lambda g: g.closeness("extends").select("path", F.round("score", 12).alias("score")), _PAIRS + ", c AS (SELECT a, count(*) AS k, sum(d) AS t FROM dist GROUP BY a) SELECT path, round(coalesce((k / ((SELECT count(*) FROM sym) - 1)) ** 2 * (k / t), 0), 12) AS score FROM sym LEFT JOIN c ON a = path")
_add("betweenness", lambda g: g.betweenness("extends").select("path", F.round("score", 12).alias("score")), _PAIRS + """, w(a, b, d, n) AS (SELECT src, dst, 1, 1::DOUBLE FROM ext UNION ALL SELECT a, b, d, sum(n) FROM (SELECT w.a, e.dst AS b, w.d + 1 AS d, w.n FROM w JOIN ext e ON e.src = w.b JOIN dist x ON x.a = w.a AND x.b = e.dst AND x.d = w.d + 1) GROUP BY a, b, d),
ways AS (SELECT w.a, w.b, w.d, w.n FROM w JOIN dist USING (a, b, d)),
s AS (SELECT l.b AS path, sum(l.n * r.n / t.n) AS s FROM ways l JOIN ways r ON r.a = l.b JOIN ways t ON t.a = l.a AND t.b = r.b AND t.d = l.d + r.d WHERE l.a <> r.b GROUP BY l.b)
SELECT path, round(coalesce(s, 0) / (((SELECT count(*) FROM sym) - 1) * ((SELECT count(*) FROM sym) - 2)), 12) AS score FROM sym LEFT JOIN s USING (path)""")

# The same over the whole calls graph, the operators' default; a statement only where it stays cheap there
_add("articulation_points__calls", lambda g: g.articulation_points(), None)
_add("bridge_edges__calls", lambda g: g.bridge_edges(), None)
_add("biconnected_components__calls", lambda g: g.biconnected_components(), None)
_add("closeness__calls", lambda g: g.closeness().select("path", F.round("score", 12).alias("score")), None)
_add("betweenness__calls", lambda g: g.betweenness().select("path", F.round("score", 12).alias("score")), None)
_add("reachable_set__calls", lambda g, p: g.reachable_set(p), _ALL.format("caller", "src", "dst", "calls") + " SELECT path FROM r WHERE path NOT IN (SELECT p FROM caller)", "caller")
_add("reaches_into__calls", lambda g, p: g.reaches_into(p), _ALL.format("callee", "dst", "src", "calls") + " SELECT path FROM r WHERE path NOT IN (SELECT p FROM callee)", "callee")
_add("common_reachable__calls", lambda g, a, b: g.common_reachable(a, b), ", a(path) AS (SELECT p FROM caller UNION SELECT e.dst FROM a JOIN calls e ON e.src = a.path), b(path) AS (SELECT p FROM callee UNION SELECT e.dst FROM b JOIN calls e ON e.src = b.path) SELECT path FROM a WHERE path IN (SELECT path FROM b) AND path NOT IN (SELECT p FROM caller UNION ALL SELECT p FROM callee)", "caller", "callee")
_add("mutual_reachability__calls", lambda g, a, b: g.mutual_reachability(a, b), None, "caller", "callee")
_add("eccentricity__calls", lambda g, p: g.eccentricity(p), None, "caller")
_add("harmonic__calls", lambda g, p: g.harmonic(p), None, "caller")
_add("dependency_layers__calls", lambda g: g.dependency_layers(), None)
_add("dependency_depth__calls", lambda g, p: g.dependency_depth(p), None, "callee")
_add("shortest_path__calls", lambda g, p: g.shortest_path(p, _farthest(g, p, "calls", None)), None, "caller")

# Selectors
_ROW = ", nth AS (SELECT path, row_number() OVER (PARTITION BY parent_path ORDER BY path) AS k, count(*) OVER (PARTITION BY parent_path) AS n FROM sym)"
for _name, _expr, _sql in (
    ("sel_list", ".function, .method", "SELECT path FROM sym WHERE node_kind IN ('function', 'method')"),
    ("sel_universal", "*", "SELECT path FROM sym"),
    ("sel_name", "#m7", "SELECT path FROM sym WHERE name = 'm7'"),
    ("sel_kind", ".const", "SELECT path FROM sym WHERE node_kind = 'constant'"),
    ("attr_filter", "*[language=python][kind=method]", "SELECT path FROM sym WHERE ends_with(file, '.py') AND node_kind = 'method'"),
    ("attr_filter__file", "*[file=src/b11.go]", "SELECT path FROM sym WHERE file = 'src/b11.go'"),
    ("comb_child", ".class > .function", "SELECT path FROM sym WHERE node_kind = 'function' AND parent_path IN (SELECT path FROM sym WHERE node_kind = 'class')"),
    ("comb_descendant", ".class .method", "SELECT path FROM sym b WHERE node_kind = 'method' AND EXISTS (SELECT 1 FROM sym a WHERE node_kind = 'class' AND starts_with(b.path, a.path || '>'))"),
    ("comb_sibling", ".function ~ .method", "SELECT path FROM sym WHERE node_kind = 'method' AND parent_path IN (SELECT parent_path FROM sym WHERE node_kind = 'function')"),
    ("ps_edge", ".method:calls(.function)", "SELECT path FROM sym WHERE node_kind = 'method' AND path IN (SELECT src FROM calls WHERE dst IN (SELECT path FROM sym WHERE node_kind = 'function'))"),
    ("ps_edge__callers", "*:callers(.constant)", "SELECT path FROM sym WHERE path IN (SELECT dst FROM calls WHERE src IN (SELECT path FROM sym WHERE node_kind = 'constant'))"),
    ("ps_edge__extends", ".class:extends", "SELECT path FROM sym WHERE node_kind = 'class' AND path IN (SELECT src FROM ext)"),
    ("ps_edge__implements", "*:implements(.class)", "SELECT path FROM sym WHERE path IN (SELECT src FROM impl)"),
    ("ps_edge__imports", "*:imports", "SELECT path FROM sym WHERE path IN (SELECT src FROM imports WHERE contains(dst, '>'))"),
    ("ps_not", "*:not(.method):not(.class)", "SELECT path FROM sym WHERE node_kind NOT IN ('method', 'class')"),
    ("ps_has", ".class:has(.constant)", "SELECT path FROM sym a WHERE node_kind = 'class' AND EXISTS (SELECT 1 FROM sym b WHERE b.node_kind = 'constant' AND starts_with(b.path, a.path || '>'))"),
    ("ps_in", "*:in(src/b11.go)", "SELECT path FROM sym WHERE file = 'src/b11.go'"),
    ("ps_first_child", "*:first-child", _ROW + " SELECT path FROM nth WHERE k = 1"),
    ("ps_last_child", "*:last-child", _ROW + " SELECT path FROM nth WHERE k = n"),
    ("ps_only_child", "*:only-child", _ROW + " SELECT path FROM nth WHERE n = 1"),
    ("ps_nth_child", ".method:nth-child(2)", _ROW + " SELECT path FROM nth JOIN sym USING (path) WHERE k = 2 AND node_kind = 'method'"),
    ("ps_unknown", "*:hover", "SELECT path FROM sym WHERE false"),
    ("query_tool", ".class > .function:calls(.method:not(:first-child)), #m3".replace(":not(:first-child)", ":not(*:first-child)"), _ROW + " SELECT path FROM sym WHERE name = 'm3' OR (node_kind = 'function' AND parent_path IN (SELECT path FROM sym WHERE node_kind = 'class') AND path IN (SELECT src FROM calls WHERE dst IN (SELECT path FROM sym JOIN nth USING (path) WHERE node_kind = 'method' AND k <> 1)))"),
    ("query_selector", ".class:extends(.class)", "SELECT path FROM sym WHERE node_kind = 'class' AND path IN (SELECT src FROM ext)"),
):
    _add(_name, lambda g, e=_expr: g.select(e), _sql)

# Changes
_EDGES = "SELECT kind, src, dst FROM edges"
_add("remove_node", lambda g, p: g.remove_node(p).edges, _EDGES + " WHERE (SELECT p FROM caller) NOT IN (src, dst)", "caller")
_add("remove_file", lambda g, p: g.remove_file(p).edges, _EDGES + " WHERE (SELECT p FROM impd) NOT IN (split_part(src, '>', 1), split_part(dst, '>', 1))", "impd")
_add("extract_file_substore", lambda g, p: g.extract_file(p).nodes.select("path", "node_kind"), "SELECT path, node_kind FROM nodes WHERE file = (SELECT p FROM impd) OR path IN (SELECT dst FROM edges WHERE split_part(src, '>', 1) = (SELECT p FROM impd))", "impd")
_add("upsert_node", lambda g: g.upsert_node("src/new.py>f", "function").nodes.select("path", "node_kind"), "SELECT path, node_kind FROM nodes UNION ALL SELECT 'src/new.py>f', 'function'")
_add("upsert_edge", lambda g, p: g.upsert_edge("calls", p, p).edges, _EDGES + " UNION SELECT 'calls', p, p FROM caller", "caller")


def _merged_whole(g: SymbolGraph) -> DataFrame:
    """Nodes and edges of three merged parts that cover the graph: each file is in two of them, an edge where its source is."""
    def part(k: int) -> SymbolGraph:
        mine = lambda c: F.pmod(F.crc32(paths.file_of(F.col(c))), F.lit(3)).isin(k, (k + 1) % 3)
        return SymbolGraph(g.base_nodes.where(mine("path")), g.edges.where(mine("src")))

    out = part(0).merge(part(1)).merge(part(2))
    nodes = out.nodes.select(F.lit("node").alias("what"), F.col("node_kind").alias("kind"), F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"))
    return nodes.unionByName(out.edges.select(F.lit("edge").alias("what"), "kind", "src", "dst"))


_add("merge", _merged_whole, "SELECT 'node' AS what, node_kind AS kind, path AS src, NULL AS dst FROM nodes UNION ALL SELECT 'edge', kind, src, dst FROM edges")


def _stubbed(g: SymbolGraph) -> SymbolGraph:
    """Calls to members whose number ends in 7 go to a bare stub of the same name."""
    name = paths.name_of(F.col("dst"))
    bare = (F.col("kind") == "calls") & F.col("dst").endswith("7")
    edges = g.edges.select("kind", "src", F.when(bare, name).otherwise(F.col("dst")).alias("dst")).distinct()
    stubs = g.edges.where(bare).select(name.alias("path")).distinct()
    return SymbolGraph(g.base_nodes.select("path", "node_kind").unionByName(stubs.withColumn("node_kind", F.lit(None).cast("string"))), edges)


_add("resolve_stubs_simple", lambda g: _stubbed(g).redirect(_stubbed(g).stub_moves_by_name()).edges, _EDGES + " WHERE NOT (src = dst AND kind = 'calls' AND right(dst, 1) = '7')")

def _ambiguous(g: SymbolGraph) -> SymbolGraph:
    """What members implement is called instead, by the class's bare name, which classes of several files bear."""
    name = paths.name_of(F.col("dst"))
    calls = g.kind("implements").select(F.lit("calls").alias("kind"), "src", name.alias("dst")).distinct()
    stubs = calls.select(F.col("dst").alias("path"), F.lit(None).cast("string").alias("node_kind")).distinct()
    return SymbolGraph(g.base_nodes.select("path", "node_kind").unionByName(stubs), g.edges.where("kind = 'imports'").unionByName(calls))


_AMBIGUOUS = """, st AS (SELECT DISTINCT split_part(dst, '>', -1) AS old, src, split_part(src, '>', 1) AS f FROM impl),
v AS (SELECT old, d.path AS new, count(DISTINCT st.src) AS votes FROM st JOIN sym d ON d.name = old JOIN imports i ON i.src = st.f AND i.dst IN (d.path, d.file) GROUP BY ALL),
mv AS (SELECT old, new FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY votes DESC, new) AS r FROM v) WHERE r = 1)"""
_add("resolve_stubs_import", lambda g: (lambda a: a.redirect(a.stub_moves_by_imports()).edges)(_ambiguous(g)), _AMBIGUOUS + " SELECT kind, src, dst FROM edges WHERE kind = 'imports' UNION SELECT 'calls', st.src, coalesce(mv.new, st.old) FROM st LEFT JOIN mv USING (old) WHERE st.src <> coalesce(mv.new, st.old)")
_ID = "CAST('0x' || left(md5(path), 15) AS BIGINT)"
_add("path_of", lambda g: g.path_of(g.symbols.where("node_kind = 'constant'").select(g.node_id(F.col("path")).alias("id"))), f"SELECT {_ID} AS id, path FROM sym WHERE node_kind = 'constant'")
_add("redirect_node", lambda g, a, b: g.redirect(g.spark.createDataFrame([(a, b)], "old string, new string")).edges, ", m AS (SELECT (SELECT p FROM caller) AS a, (SELECT p FROM callee) AS b) SELECT DISTINCT kind, CASE WHEN src = m.a THEN m.b ELSE src END AS src, CASE WHEN dst = m.a THEN m.b ELSE dst END AS dst FROM edges, m WHERE NOT (m.a IN (src, dst) AND CASE WHEN src = m.a THEN m.b ELSE src END = CASE WHEN dst = m.a THEN m.b ELSE dst END)", "caller", "callee")


def _replaced(g: SymbolGraph, file: str) -> DataFrame:
    mine = g.extract_file(file)
    gone = paths.file_of(F.col("path")) != file
    new = SymbolGraph(mine.base_nodes.where(gone | ~F.col("path").endswith("3")), mine.edges.where(~F.col("src").endswith("3")))
    return g.replace_file(file, new).edges


_add("replace_file", _replaced, _EDGES + " WHERE NOT (split_part(src, '>', 1) = (SELECT p FROM impd) AND ends_with(src, '3')) AND NOT (split_part(dst, '>', 1) = (SELECT p FROM impd) AND ends_with(dst, '3'))", "impd")

# Context and budgets
_add("ctx_seed", lambda g: g.ctx_seed(["PROMO", "m1"], 30), """, asked(c, w) AS (VALUES (0, 'promo'), (1, 'm1')), h AS (SELECT c, path, row_number() OVER (PARTITION BY c ORDER BY path) AS r FROM nodes JOIN asked ON contains(lower(name), w)),
f AS (SELECT path, min((c, r)) AS o_ FROM h WHERE r <= 10 GROUP BY path ORDER BY o_ LIMIT 30) SELECT CAST(row_number() OVER (ORDER BY o_) - 1 AS INTEGER) AS pos, path FROM f""")
_add("ctx_expand", lambda g, a, b: g.ctx_expand(g.spark.createDataFrame([(0, a), (1, b)], "pos int, path string"), 12, ("calls", "extends"))[0], """, eps(pos, path) AS (SELECT 0, p FROM caller UNION ALL SELECT 1, p FROM sup),
x AS (SELECT pos, kind, 0 AS way, dst AS other FROM eps JOIN edges ON src = path WHERE kind IN ('calls', 'extends') UNION ALL SELECT pos, kind, 1, src FROM eps JOIN edges ON dst = path WHERE kind IN ('calls', 'extends')),
o AS (SELECT *, row_number() OVER (ORDER BY pos, kind, way, other) AS o_ FROM x WHERE other NOT IN (SELECT path FROM eps)), f AS (SELECT other, min(o_) AS o_ FROM o GROUP BY other ORDER BY o_ LIMIT 10)
SELECT pos, path FROM eps UNION ALL SELECT CAST(1 + row_number() OVER (ORDER BY o_) AS INTEGER), other FROM f""", "caller", "sup")
_add("ctx_related_files", lambda g, p: g.ctx_related_files(g.callees(p).select((F.row_number().over(_by_path()) - 1).alias("pos"), "path")), ", n AS (SELECT dst AS path, row_number() OVER (ORDER BY dst) - 1 AS pos FROM calls WHERE src = (SELECT p FROM caller)) SELECT split_part(path, '>', 1) AS file, CAST(min(pos) AS INTEGER) AS pos FROM n GROUP BY 1", "caller")
_add("ctx_blocks", lambda g, p: g.ctx_blocks(g.callers(p).select((F.row_number().over(_by_path()) - 1).alias("pos"), "path")).drop("span"), ", n AS (SELECT src AS path, row_number() OVER (ORDER BY src) - 1 AS pos FROM calls WHERE dst = (SELECT p FROM callee)) SELECT CAST(min(pos) AS INTEGER) AS pos, split_part(path, '>', 1) AS file, arg_min(split_part(path, '>', -1), pos) AS symbol FROM n GROUP BY 2 ORDER BY 1 LIMIT 6", "callee")
_add("context", lambda g: _flat(g.context("how does PROMO burnished flow into m12"), "candidates", "entry_points", "nodes", "edges", "related_files", "code_blocks"), None)
_add("context__selector", lambda g: _flat(g.context(".class:extends"), "candidates", "entry_points", "nodes", "edges", "related_files", "code_blocks"), None)
_add("query_context", lambda g: g.context("trace m15").select("routing", F.array_join("entry_points", " | ").alias("entry_points")), None)
_add("budget_resolve", lambda g: g.budget_resolve(), "SELECT CASE WHEN count(*) < 500 THEN 'small' WHEN count(*) < 5000 THEN 'medium' ELSE 'large' END AS mode, CASE WHEN count(*) < 500 THEN 15 WHEN count(*) < 5000 THEN 30 ELSE 50 END AS max_nodes, CASE WHEN count(*) < 500 THEN 30 WHEN count(*) < 5000 THEN 60 ELSE 100 END AS max_edges FROM nodes")


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")


def _budgeted(g: SymbolGraph) -> DataFrame:
    from ..operators.agent import apply_budget, budget

    row = g.symbols.agg(F.array_sort(F.collect_list("path")).alias("symbols"))
    return apply_budget(row, budget(0)).select(F.array_join("symbols", " | ").alias("symbols"), "truncated", F.col("total_available").cast("long").alias("total_available"), F.array_join("truncated_fields", " | ").alias("truncated_fields"))


_add("budget_apply", _budgeted, "SELECT (SELECT string_agg(path, ' | ' ORDER BY path) FROM (SELECT path FROM sym ORDER BY path LIMIT 15)) AS symbols, count(*) > 15 AS truncated, count(*) AS total_available, 'symbols' AS truncated_fields FROM sym")


def ctx_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.agent import task_candidates

    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return task_candidates(docs).select("conv_id", "turn", F.array_join("candidates", " ").alias("candidates"))


def ctx_is_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.agent import is_selector

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(is_selector(F.col("text")), F.lit(False)).alias("selector"))


def ext_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("src/p."), F.element_at(F.array(*map(F.lit, ("js", "pyi", "tsx", "rs", "go", "java", "h", "rb", "hpp", "cs", "txt"))), F.pmod("page_id", F.lit(11)).cast("int") + 1)).alias("path"))
    return pages.select("page_id", paths.language_of(F.col("path")).alias("language"))


_WORDS = "'" + "', '".join("a an and are as at by call calls does flow for from how in into is of on or through to trace what when where which why with work works".split()) + "'"
QUERIES |= {f.__name__: f for f in (ctx_candidates, ctx_is_selector, ext_dispatch)}
SQL |= {
    "ctx_candidates": rf"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) AS t, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), 1) AS i FROM conversations),
g AS (SELECT conv_id, turn, t, min(i) AS i FROM w WHERE NOT regexp_matches(t, '^[0-9]') AND length(t) >= 3 AND lower(t) NOT IN ({_WORDS}) AND (regexp_matches(t, '[A-Z_]') OR length(t) >= 4) GROUP BY ALL),
c AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY i) AS s FROM g GROUP BY ALL)
SELECT x.conv_id, x.turn, coalesce(s, '') AS candidates FROM conversations x LEFT JOIN c ON c.conv_id = x.conv_id AND c.turn = x.turn""",
    "ctx_is_selector": "SELECT doc_id, coalesce(contains(text, '#') OR contains(text, '[') OR regexp_matches(text, '^[^:]*:[A-Za-z]'), false) AS selector FROM documents",
    "ext_dispatch": "SELECT page_id, (['javascript', 'python', 'typescript', 'rust', 'go', 'java', 'c', 'ruby', 'cpp', 'csharp', NULL])[CAST(page_id % 11 AS INTEGER) + 1] AS language FROM pages",
}
