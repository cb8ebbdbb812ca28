"""Queries over the whole graph and all events beside their SQL; no node, edge or event is left out."""

import os

import duckdb
import pytest

from symloom.plans import catalog, catalog_changes

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
NAMES = [
    "merge", "symbol_delta", "match_files", "match_symbols", "delta_caps", "push_graph_changed", "set_summary", "resolve_stubs_import", "path_of", "load_with_journal", "journal_append", "journal_compact", "snapshot_save",
    "extract_refs", "extract_alias", "type_imports", "ingest_parallel", "kind_map_capture", "sync_file", "replace_from_store", "watch_attach", "watch_drive", "py_rel_import", "ts_rel_import",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = (catalog.QUERIES | catalog_changes.QUERIES)[name](spark, DIR)
    theirs = duck.execute((catalog.SQL | catalog_changes.SQL)[name])
    cols = [c[0] for c in theirs.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


def test_every_event_is_in_a_state(spark):
    old, new = catalog_changes._states(spark, DIR)
    assert old.select("seq").union(new.select("seq")).distinct().count() == catalog_changes._events(spark, DIR).count()
