"""Registered queries over changes, extraction and persistence.

Change events come from the events table: file src/u<user>.py, symbol <file>><type>_<event_id % 7>, removed when the type is error.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imports, paths
from ..sources import extract, persist
from ..sources.derived import DERIVED_SQL, derived_graph
from ..streaming import deltas
from .tables import shared_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    file = F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py"))
    return e.select(F.col("event_id").alias("seq"), file.alias("file"), F.concat(file, F.lit(">"), "event_type", F.lit("_"), (F.col("event_id") % 7).cast("string")).alias("path"), F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"))


_EVENTS = """WITH ev AS (SELECT event_id AS seq, 'src/u' || user_id || '.py' AS file, 'src/u' || user_id || '.py>' || event_type || '_' || (event_id % 7) AS path, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS op FROM events),
o AS (SELECT DISTINCT file, path FROM ev WHERE seq <= (SELECT max(seq) // 2 FROM ev) OR op = 'remove'), n AS (SELECT DISTINCT file, path FROM ev WHERE op = 'upsert'),
d AS (SELECT coalesce(o.file, n.file) AS file, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path)
"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The states before and after, of all events: before, what came up to the middle of seq and all that is removed; after, all that is upserted."""
    e = _events(spark, sf_dir)
    middle = e.agg(F.floor(F.max("seq") / 2).alias("m")).first()["m"]
    return e.where(F.coalesce(F.col("seq") <= F.lit(middle), F.lit(False)) | (F.col("op") == "remove")), e.where("op = 'upsert'")


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.symbol_delta(*_states(spark, sf_dir))


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_add("symbol_delta", _delta, _EVENTS + "SELECT file, path, change FROM d")
_add("match_files", lambda s, d: deltas.match_files(_delta(s, d), ["src/u1*.py"]), _EVENTS + "SELECT file, path, change FROM d WHERE regexp_matches(file, '^src/u1[^/]*\\.py$')")
_add("match_symbols", lambda s, d: deltas.match_symbols(_delta(s, d), ["src/*>click_?"]), _EVENTS + "SELECT file, path, change FROM d WHERE regexp_matches(path, '^src/[^/]*>click_[^/]$')")
_add("delta_caps", lambda s, d: deltas.delta_caps(_delta(s, d), 3, 16).withColumn("paths", F.array_join("paths", " | ")), _EVENTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY file, change ORDER BY path) AS k FROM d WHERE file IN (SELECT DISTINCT file FROM d ORDER BY file LIMIT 16)) SELECT file, change, count(*) AS total, string_agg(path, ' | ' ORDER BY path) FILTER (k <= 3) AS paths FROM r GROUP BY file, change")
_add("push_graph_changed", lambda s, d: deltas.graph_changed(_delta(s, d).withColumn("batch_seq", F.lit(1))).withColumn("changed_files", F.array_join("changed_files", " | ")), _EVENTS + ", f AS (SELECT file, row_number() OVER (ORDER BY file) AS k FROM (SELECT DISTINCT file FROM d)) SELECT 1 AS batch_seq, string_agg(file, ' | ' ORDER BY file) FILTER (k <= 50) AS changed_files, count(*) AS n_files, count(*) > 50 AS truncated FROM f")


def set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deltas.set_summary(*(s.select("path") for s in _states(spark, sf_dir)))
    return out.withColumns({c: F.array_join(c, " | ") for c in ("added", "removed")})


_add("set_summary", set_summary, _EVENTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY path) AS k FROM d) SELECT count(*) FILTER (change = 'added') AS n_added, count(*) FILTER (change = 'removed') AS n_removed, string_agg(path, ' | ' ORDER BY path) FILTER (change = 'added' AND k <= 50) AS added, string_agg(path, ' | ' ORDER BY path) FILTER (change = 'removed' AND k <= 50) AS removed FROM r")


_add("result_hash", lambda s, d: deltas.result_hash(_events(s, d).select("path")), _EVENTS + "SELECT sha256(string_agg(path, chr(10) ORDER BY path)) AS hash FROM (SELECT DISTINCT path FROM ev)")


def match_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selector's results before and after a file is cut down, against what was touched."""
    g = derived_graph(spark, sf_dir).written()
    file = g.symbols.agg(F.min("file")).first()[0]
    after = type(g)(g.base_nodes.where(~((paths.file_of(F.col("path")) == file) & F.col("path").endswith("3"))), g.edges)
    delta = deltas.symbol_delta(g.symbols_in_file(file), after.symbols_in_file(file), ("path",))
    return deltas.match_selector(g.select(".method"), after.select(".method"), delta)


_add("match_selector", match_selector, DERIVED_SQL + "SELECT path, CASE WHEN ends_with(path, '3') THEN 'removed' ELSE 'modified' END AS change FROM sym WHERE node_kind = 'method' AND file = (SELECT min(file) FROM sym)")
_add("watch_filter", lambda s, d: _events(s, d).select("file").distinct().where(deltas.watch_filter(F.col("file"), ("py", "rs"), ("src/u1*",))), _EVENTS + "SELECT DISTINCT file FROM ev WHERE NOT regexp_matches(file, '^src/u1[^/]*$')")


def watch_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after the whole event table has gone through the watch stream in four batches."""
    from ..streaming.watch import EVENTS, Watch

    home = f"{shared_dir(spark)}/watch-in-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    events = _events(spark, sf_dir).select("seq", "file", "path", "op")
    events.repartitionByRange(4, "seq").write.mode("overwrite").parquet(home)
    w = Watch(spark, uuid.uuid4().hex, lambda n, delta, state: None)
    w.start(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(home)).awaitTermination()
    return w._state()


_add("watch_drive", watch_drive, _EVENTS + "SELECT file, path FROM ev GROUP BY file, path HAVING arg_max(op, seq) = 'upsert'")


def _records(spark: SparkSession, sf_dir: str):
    """The derived graph and three journal records over it: one file twice, its last record empty, and one cut down."""
    g = derived_graph(spark, sf_dir)
    a, b = (r["file"] for r in g.symbols.select("file").distinct().orderBy("file").limit(2).collect())
    less = g.extract_file(b)
    none = type(g)(g.base_nodes.limit(0), g.edges.limit(0))
    return g, [(1, a, type(g)(g.extract_file(a).base_nodes, none.edges)), (2, b, type(g)(less.base_nodes.where(~F.col("path").endswith("7")), none.edges)), (3, a, none)]


def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, made = _records(spark, sf_dir)
    records = spark.createDataFrame([(n, file) for n, file, _ in made], "seq bigint, owner string")
    nodes = functools.reduce(DataFrame.unionByName, (new.base_nodes.withColumn("seq", F.lit(n).cast("long")) for n, _, new in made))
    return persist.replay(g, records, nodes, g.edges.limit(0).withColumn("seq", F.lit(3).cast("long"))).nodes.select("path", "node_kind")


def _journalled(spark: SparkSession, sf_dir: str) -> str:
    g, made = _records(spark, sf_dir)
    path = f"{shared_dir(spark)}/journalled-{uuid.uuid4().hex}"
    persist.save(g, path)
    for n, file, new in made:
        persist.append(path, n, file, new)
    return path


def journal_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _journalled(spark, sf_dir)
    if not persist.compact(spark, path, f"{path}-compact", 3):
        raise ValueError("three records are enough here")
    return persist.load(spark, f"{path}-compact").nodes.select("path", "node_kind")


_REPLAYED = DERIVED_SQL + ", two AS (SELECT DISTINCT file FROM sym ORDER BY file LIMIT 2), c AS (SELECT path FROM nodes WHERE file = (SELECT max(file) FROM two) AND NOT ends_with(path, '7')) SELECT path, node_kind FROM nodes WHERE file NOT IN (SELECT file FROM two) OR path IN (SELECT path FROM c)"
_add("journal_replay", journal_replay, _REPLAYED)
_add("load_with_journal", lambda s, d: persist.load_with_journal(s, _journalled(s, d)).nodes.select("path", "node_kind"), _REPLAYED)
_add("journal_append", lambda s, d: s.read.parquet(f"{_journalled(s, d)}/records").select("seq", "owner"), DERIVED_SQL + ", two AS (SELECT DISTINCT file FROM sym ORDER BY file LIMIT 2) SELECT 1 AS seq, min(file) AS owner FROM two UNION ALL SELECT 2, max(file) FROM two UNION ALL SELECT 3, min(file) FROM two")
_add("journal_compact", journal_compact, _REPLAYED)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived graph's Python files written out as source: a class per type, a function per member."""
    g = derived_graph(spark, sf_dir)
    members = g.symbols.where((F.col("depth") == 3) & F.col("file").endswith(".py")).select("file", F.regexp_replace(paths.name_of(F.col("parent_path")), r"\W", "_").alias("cls"), "name")
    body = F.concat(F.lit("class "), "cls", F.lit(":\n"), F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda n: F.concat(F.lit("    def "), n, F.lit("(self): ...\n"))), ""))
    classes = members.groupBy("file", "cls").agg(body.alias("body"))
    return classes.groupBy(F.col("file").alias("path")).agg(F.encode(F.array_join(F.array_sort(F.collect_list("body")), ""), "UTF-8").alias("content"))


_PY = DERIVED_SQL + ", py AS (SELECT DISTINCT file, regexp_replace(split_part(path, '>', 2), '\\W', '_', 'g') AS cls, name FROM nodes WHERE depth = 3 AND ends_with(file, '.py'))"
_add("extract_defs", lambda s, d: extract.extracted(_sources(s, d)).where("what = 'node'").select("path", "node_kind"), _PY + " SELECT DISTINCT file AS path, 'file' AS node_kind FROM py UNION SELECT file || '>' || cls, 'class' FROM py UNION SELECT file || '>' || cls || '>' || name, 'method' FROM py")
_add("extract", lambda s, d: extract.extracted(_sources(s, d)).where("what = 'edge'").select("kind", F.col("path").alias("src"), "dst"), _PY + " SELECT DISTINCT 'contains' AS kind, file AS src, file || '>' || cls AS dst FROM py UNION SELECT 'contains', file || '>' || cls, file || '>' || cls || '>' || name FROM py")


def cortex_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that need extraction again: those whose content differs from what is on record."""
    files = written(_sources(spark, sf_dir), "sources")
    known = files.select("path", F.when(F.contains("path", F.lit("1")), F.sha2(F.lit("older"), 256)).otherwise(F.sha2("content", 256)).alias("digest"))
    return extract.changed(files, known).select("path")


_add("cortex_memo", cortex_memo, _PY + " SELECT DISTINCT file AS path FROM py WHERE contains(file, '1')")


def snapshot_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by kind after a snapshot was saved and loaded."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    persist.save(derived_graph(spark, sf_dir), path)
    return persist.load_with_journal(spark, path).edges.groupBy("kind").agg(F.count("*").alias("n"))


_add("snapshot_load", snapshot_load, DERIVED_SQL + "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
_add("snapshot_save", lambda s, d: _saved(s, d).base_nodes.select("path", "node_kind"), DERIVED_SQL + "SELECT path, node_kind FROM nodes")


def _saved(spark: SparkSession, sf_dir: str):
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    persist.save(derived_graph(spark, sf_dir), path)
    return persist.load(spark, path)


_HEAD = "from typing import TYPE_CHECKING\nfrom .base import Base as B\nimport helpers as h\nif TYPE_CHECKING:\n    import kinds\ndef top(): ...\n"
_BODY = "        self.{0}()\n        h.run()\n        B(top)\n        other()\n"


def _calling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived graph's Python files as source whose methods call themselves, an imported module, a renamed class (with a function) and an unknown."""
    body = F.col("content").cast("string")
    defs = r"(?m)^    def (\w+)\(self\): \.\.\.$"
    full = F.regexp_replace(body, F.lit(defs), F.lit("    def $1(self):\n" + _BODY.format("$1").rstrip("\n")))
    return _sources(spark, sf_dir).select("path", F.encode(F.concat(F.lit(_HEAD), full), "UTF-8").alias("content"))


def _refs(where: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: extract.extracted(_calling(s, d)).where("what = 'edge'").select("kind", F.col("path").alias("src"), "dst").where(where).distinct()


_CALLERS = _PY + ", m AS (SELECT DISTINCT file, file || '>' || cls || '>' || name AS src FROM py), fs AS (SELECT DISTINCT file FROM py)"
_add("self_call", _refs("kind = 'calls' AND src = dst"), _CALLERS + " SELECT 'calls' AS kind, src, src AS dst FROM m")
_add("alias_call", _refs("kind = 'calls' AND dst IN ('helpers>run', 'src/base.py>Base')"), _CALLERS + " SELECT 'calls' AS kind, src, dst FROM m, (VALUES ('helpers>run'), ('src/base.py>Base')) t(dst)")
_add("arg_callback", _refs("kind = 'calls' AND endswith(dst, '>top')"), _CALLERS + " SELECT 'calls' AS kind, src, file || '>top' AS dst FROM m")
_add("extract_refs", _refs("kind = 'calls'"), _CALLERS + " SELECT 'calls' AS kind, src, unnest([src, 'helpers>run', 'src/base.py>Base', file || '>top', 'other']) AS dst FROM m")
_add("caller_scope", lambda s, d: _refs("kind = 'calls'")(s, d).select("src").distinct(), _CALLERS + " SELECT src FROM m")
_add("type_imports", _refs("kind = 'type_imports'"), _CALLERS + " SELECT 'type_imports' AS kind, file AS src, 'kinds' AS dst FROM fs")
_add("extract_alias", _refs("kind = 'imports'"), _CALLERS + " SELECT 'imports' AS kind, file AS src, unnest(['typing', 'typing>TYPE_CHECKING', 'src/base.py', 'src/base.py>Base', 'helpers']) AS dst FROM fs")
_add("ingest_parallel", lambda s, d: extract.graph_of(_sources(s, d))[0].nodes.select("path", "node_kind"), SQL["extract_defs"])
_add("kind_map_capture", lambda s, d: extract.extracted(_calling(s, d)).where("what = 'node' AND path <> ''").groupBy("node_kind").agg(F.count("*").alias("n")), _CALLERS + ", k AS (SELECT 'file' AS node_kind FROM fs UNION ALL SELECT 'function' FROM fs UNION ALL SELECT 'class' FROM (SELECT DISTINCT file, cls FROM py) UNION ALL SELECT 'method' FROM m) SELECT node_kind, count(*) AS n FROM k GROUP BY 1")


def sync_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which only the first class is left, indexed again at once."""
    files = written(_sources(spark, sf_dir), "sources")
    first = F.concat(F.lit("class "), F.element_at(F.split(F.col("content").cast("string"), "(?m)^class "), 2))
    return extract.sync_files(extract.graph_of(files)[0], files.select("path", F.encode(first, "UTF-8").alias("content")))[1]


_add("sync_file", sync_file, _PY + ", c AS (SELECT file, cls, count(DISTINCT name) AS n FROM py GROUP BY ALL) SELECT file, CAST(sum(n) + count(*) AS BIGINT) AS before, CAST(arg_min(n, cls) + 1 AS BIGINT) AS after FROM c GROUP BY file")
_add("replace_from_store", lambda s, d: _replaced_from_store(s, d), DERIVED_SQL + "SELECT kind, src, dst FROM edges")


def _replaced_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that was emptied of what no other file points to comes back from the whole graph."""
    g = derived_graph(spark, sf_dir)
    file = g.symbols.agg(F.min("file")).first()[0]
    mine = paths.file_of(F.col("src")) == file
    return type(g)(g.base_nodes, g.edges.where(~mine)).replace_from_store(file, g).edges


def watch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols after two batches of changed files: all, then those that are cut down to their first class; each batch by a watch of its own, as after a restart."""
    from ..streaming.watch import FileWatch

    files = written(_sources(spark, sf_dir), "sources")
    first = F.concat(F.lit("class "), F.element_at(F.split(F.col("content").cast("string"), "(?m)^class "), 2))
    less = files.where(F.contains("path", F.lit("1"))).select("path", F.encode(first, "UTF-8").alias("content"))
    home, name = f"{shared_dir(spark)}/changed-{uuid.uuid4().hex}", uuid.uuid4().hex
    for batch in (files, less):
        batch.coalesce(1).write.mode("append").parquet(home)
        w = FileWatch(spark, name, lambda n, delta, graph: None)
        w.start(spark.readStream.schema("path string, content binary").parquet(home)).awaitTermination()
    return w.graph().nodes.where("node_kind IS NOT NULL").select("path", "node_kind")


_add("watch_attach", watch_files, _PY + """, least AS (SELECT file, min(cls) AS cls FROM py GROUP BY file), k AS (SELECT DISTINCT py.file, py.cls, name FROM py JOIN least l ON l.file = py.file WHERE NOT contains(py.file, '1') OR py.cls = l.cls)
SELECT DISTINCT file AS path, 'file' AS node_kind FROM k UNION SELECT file || '>' || cls, 'class' FROM k UNION SELECT file || '>' || cls || '>' || name, 'method' FROM k""")


def _importing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    k = F.col("event_id")
    file = F.concat(F.lit("src/"), F.repeat(F.lit("d/"), (k % 4).cast("int")), F.lit("m.py"))
    module = F.concat(F.repeat(F.lit("."), (k % 6).cast("int")), F.when(k % 5 > 0, F.concat(F.lit("pkg.n"), (k % 9).cast("string"))).otherwise(""))
    return e.select("event_id", file.alias("file"), module.alias("module"), F.concat(F.when(k % 3 == 0, "./").when(k % 3 == 1, "../").otherwise(""), F.lit("lib/n"), (k % 9).cast("string"), F.when(k % 2 == 0, ".js").otherwise("")).alias("spec"))


_IMPORTING = """WITH i AS (SELECT event_id, 'src/' || repeat('d/', CAST(event_id % 4 AS INT)) || 'm.py' AS file, CAST(event_id % 6 AS INT) AS dots, CASE WHEN event_id % 5 > 0 THEN 'pkg.n' || (event_id % 9) ELSE '' END AS name,
CASE event_id % 3 WHEN 0 THEN './' WHEN 1 THEN '../' ELSE '' END AS up, 'lib/n' || (event_id % 9) || CASE WHEN event_id % 2 = 0 THEN '.js' ELSE '' END AS rest, CAST(1 + event_id % 4 AS INT) AS n FROM events), d AS (SELECT *, list_concat(['src'], list_transform(range(n - 1), lambda x: 'd')) AS folder FROM i)
"""
_add("py_rel_import", lambda s, d: _importing(s, d).select("event_id", imports.python_relative_column(F.col("file"), F.col("module")).alias("target")), _IMPORTING + "SELECT event_id, CASE WHEN dots > 0 THEN array_to_string(list_concat(folder[1:greatest(0, n - dots + 1)], list_filter(string_split(name, '.'), lambda x: x <> '')), '/') || CASE WHEN name <> '' THEN '.py' ELSE '' END END AS target FROM d")
_add("ts_rel_import", lambda s, d: _importing(s, d).select("event_id", imports.typescript_relative_column(F.regexp_replace("file", "py$", "ts"), F.col("spec")).alias("target")), _IMPORTING + "SELECT event_id, CASE WHEN up <> '' THEN array_to_string(list_concat(folder[1:n - CASE up WHEN '../' THEN 1 ELSE 0 END], string_split(rest, '/')), '/') || CASE WHEN ends_with(rest, '.js') THEN '' ELSE '.ts' END END AS target FROM d")
