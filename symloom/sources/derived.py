"""A symbol graph derived from the part and lineitem tables, for queries that need one at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import SymbolGraph
from ..plans.tables import written


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    brand = F.regexp_extract("p_brand", "[0-9]+", 0)
    b = brand.cast("int")
    file = F.concat(F.lit("src/b"), brand, F.when(b % 3 == 0, ".py").when(b % 3 == 1, ".rs").otherwise(".go"))
    return part.select("p_partkey", "p_size", file.alias("file"), F.concat_ws(">", file, "p_type").alias("cls"), F.concat(file, F.lit(">"), "p_type", F.lit(">m"), F.col("p_partkey").cast("string")).alias("member"))


_made: dict[tuple[str, str], SymbolGraph] = {}


def derived_graph(spark: SparkSession, sf_dir: str) -> SymbolGraph:
    """The graph of a folder's tables, written once per application: nodes in the order of their paths, edges in that of kind and source."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        _made.clear()
        g = _derived(spark, sf_dir)
        nodes = written(g.base_nodes.repartitionByRange("path").sortWithinPartitions("path"), "nodes")
        _made[key] = SymbolGraph(nodes, written(g.edges.repartitionByRange("kind", "src").sortWithinPartitions("kind", "src", "dst"), "edges"))
    return _made[key]


def _derived(spark: SparkSession, sf_dir: str) -> SymbolGraph:
    p = _paths(spark, sf_dir)
    kind = F.when(F.col("p_size") % 3 == 0, "function").when(F.col("p_size") % 3 == 1, "method").otherwise("constant")
    nodes = p.select(F.col("file").alias("path"), F.lit("file").alias("node_kind")).distinct()
    nodes = nodes.unionByName(p.select(F.col("cls").alias("path"), F.lit("class").alias("node_kind")).distinct()).unionByName(p.select(F.col("member").alias("path"), kind.alias("node_kind")))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    a, b = (lines.select(*(F.col(c).alias(f"{s}_{c[2:]}") for c in lines.columns)) for s in "ab")
    pairs = a.join(b, (F.col("a_orderkey") == F.col("b_orderkey")) & (F.col("b_linenumber") == F.col("a_linenumber") + 1) & (F.col("a_partkey") != F.col("b_partkey")))
    flag = lambda x, y: (F.col("a_returnflag") == x) & (F.col("b_returnflag") == y)
    n = F.col("a_linenumber")
    kinds = (
        F.when(flag("R", "A"), "calls"), F.when(flag("N", "N") & (n == 1) & (F.col("a_quantity") >= 46), "imports"),
        F.when((F.col("a_returnflag") == "A") & (n == 6) & (F.col("a_linestatus") == "O"), "extends"),
        F.when(flag("A", "N") & (n == 5) & (F.col("a_linestatus") == "F"), "implements"),
    )
    each = pairs.select("a_partkey", "b_partkey", F.explode(F.array_compact(F.array(*kinds))).alias("kind")).distinct()
    x, y = (p.select(F.col("p_partkey").alias(f"{s}_partkey"), *(F.col(c).alias(f"{s}_{c}") for c in ("file", "cls", "member"))) for s in "ab")
    ends = each.join(x, "a_partkey").join(y, "b_partkey")
    src = F.when(F.col("kind") == "imports", F.col("a_file")).when(F.col("kind") == "extends", F.col("a_cls")).otherwise(F.col("a_member"))
    dst = F.when(F.col("kind") == "imports", F.col("b_file")).when(F.col("kind").isin("extends", "implements"), F.col("b_cls")).otherwise(F.col("b_member"))
    edges = ends.select("kind", src.alias("src"), dst.alias("dst")).where("NOT (kind = 'imports' AND src = dst) AND NOT (kind = 'extends' AND src <= dst)").distinct()
    return SymbolGraph(nodes, edges)


#: The same graph as common table expressions for DuckDB.
DERIVED_SQL = """
WITH RECURSIVE parts AS (
  SELECT p_partkey, p_size, 'src/b' || regexp_extract(p_brand, '[0-9]+') || CASE CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.go' END AS file, p_type FROM part),
pp AS (SELECT p_partkey, p_size, file, file || '>' || p_type AS cls, file || '>' || p_type || '>m' || p_partkey AS member FROM parts),
nodes0 AS (SELECT DISTINCT file AS path, 'file' AS node_kind FROM pp UNION ALL SELECT DISTINCT cls, 'class' FROM pp
  UNION ALL SELECT member, CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'constant' END FROM pp),
nodes AS (SELECT path, node_kind, split_part(path, '>', 1) AS file, split_part(path, '>', -1) AS name, contains(path, '>') AS is_symbol, len(string_split(path, '>')) AS depth,
  CASE WHEN contains(path, '>') THEN left(path, length(path) - length(split_part(path, '>', -1)) - 1) END AS parent_path FROM nodes0),
lp AS (SELECT a.*, b.l_partkey AS bp, b.l_returnflag AS bf FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey),
edges AS (
  SELECT DISTINCT 'calls' AS kind, x.member AS src, y.member AS dst FROM lp JOIN pp x ON x.p_partkey = l_partkey JOIN pp y ON y.p_partkey = bp WHERE l_returnflag = 'R' AND bf = 'A'
  UNION ALL SELECT DISTINCT 'imports', x.file, y.file FROM lp JOIN pp x ON x.p_partkey = l_partkey JOIN pp y ON y.p_partkey = bp WHERE l_returnflag = 'N' AND bf = 'N' AND l_linenumber = 1 AND l_quantity >= 46 AND x.file <> y.file
  UNION ALL SELECT DISTINCT 'extends', x.cls, y.cls FROM lp JOIN pp x ON x.p_partkey = l_partkey JOIN pp y ON y.p_partkey = bp WHERE l_returnflag = 'A' AND l_linenumber = 6 AND l_linestatus = 'O' AND x.cls > y.cls
  UNION ALL SELECT DISTINCT 'implements', x.member, y.cls FROM lp JOIN pp x ON x.p_partkey = l_partkey JOIN pp y ON y.p_partkey = bp WHERE l_returnflag = 'A' AND bf = 'N' AND l_linenumber = 5 AND l_linestatus = 'F'),
sym AS (SELECT * FROM nodes WHERE is_symbol),
calls AS (SELECT src, dst FROM edges WHERE kind = 'calls'), imports AS (SELECT src, dst FROM edges WHERE kind = 'imports'),
ext AS (SELECT src, dst FROM edges WHERE kind = 'extends'), impl AS (SELECT src, dst FROM edges WHERE kind = 'implements'),
caller AS (SELECT src AS p FROM calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
callee AS (SELECT dst AS p FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
sub AS (SELECT src AS p FROM ext GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
sup AS (SELECT dst AS p FROM ext GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
impr AS (SELECT src AS p FROM imports GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
impd AS (SELECT dst AS p FROM imports GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
iface AS (SELECT dst AS p FROM impl GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
imple AS (SELECT src AS p FROM impl GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
deg AS (SELECT path, (SELECT count(*) FROM calls WHERE dst = path) AS i, (SELECT count(*) FROM calls WHERE src = path) AS o FROM sym)
"""
