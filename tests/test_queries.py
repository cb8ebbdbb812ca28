"""Registered queries beside their SQL on the small tables."""

import os

import duckdb
import pytest

from symloom.plans import catalog

DIR = "/root/testdata/sf0.001"
SOME = [
    "lookup", "all_symbols", "entry_points", "isolated_symbols", "batch_symbol_info", "ancestors", "inherited_descendants", "top_files", "callers__virtual", "cross_refs", "two_hop",
    "clustering_coefficient", "batch_node_degree", "rank_symbols", "degree_centrality", "graph_stats", "reachable_from", "find_call_path", "callee_tree", "wcc", "scc_groups",
    "dependency_layers", "closeness", "betweenness", "comb_descendant", "ps_has", "ps_nth_child", "query_tool", "merge", "replace_file", "ctx_seed", "ctx_expand", "budget_apply", "ctx_candidates",
]


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    theirs = duck.execute(catalog.SQL[name])
    cols = [c[0] for c in theirs.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in theirs.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_every_statement_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
