"""SymbolGraph: a tree of symbols and typed edges between them, as two DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import paths
from .operators.adjacency import Adjacency
from .operators.agent import Agent
from .operators.centrality import Centrality
from .operators.degree import Degree
from .operators.hierarchy import Hierarchy
from .operators.lookup import Lookup
from .operators.maintenance import Maintenance
from .operators.reach import Reach
from .operators.structure import Structure
from .operators.trees import Trees
from .plans.numbered import Numbers, numbered
from .plans.selector import Selector
from .plans.tables import written


class SymbolGraph(Lookup, Hierarchy, Adjacency, Degree, Reach, Trees, Structure, Centrality, Maintenance, Agent, Selector):
    """Immutable. nodes: path, node_kind, span; edges: kind, src, dst, without repeats. Operators are methods that return DataFrames."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        if "span" not in nodes.columns:
            nodes = nodes.withColumn("span", F.lit(None).cast(schema.SPAN))
        self.base_nodes = nodes.select("path", "node_kind", "span")
        self.edges = edges.select("kind", "src", "dst")
        path = F.col("path")
        self.nodes = self.base_nodes.select(
            "path", "node_kind", "span", paths.file_of(path).alias("file"), paths.parent_of(path).alias("parent_path"), paths.name_of(path).alias("name"),
            paths.depth_of(path).alias("depth"), paths.is_symbol(path).alias("is_symbol"), paths.language_of(path).alias("language"),
        )

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def symbols(self) -> DataFrame:
        return self.nodes.where("is_symbol")

    def kind(self, *kinds: str) -> DataFrame:
        """src, dst of these kinds."""
        return self.edges.where(F.col("kind").isin(*kinds)).select("src", "dst")

    def symbol_edges(self, *kinds: str) -> DataFrame:
        """src, dst where both ends are symbols."""
        return self.kind(*kinds).where(paths.is_symbol(F.col("src")) & paths.is_symbol(F.col("dst")))

    def numbers(self, *kinds: str, symbols: bool = True) -> Numbers:
        """Symbols and the edges of these kinds between them, or all nodes and edges, by number: written once per graph."""
        made = self.__dict__.setdefault("_numbers", {})
        key = (symbols, *kinds)
        if key not in made:
            made[key] = numbered(self.symbols, self.symbol_edges(*kinds)) if symbols else numbered(self.nodes, self.kind(*kinds))
        return made[key]

    def written(self) -> SymbolGraph:
        """The same graph over written tables, edges parted by kind: for operators that go over it many times."""
        return SymbolGraph(written(self.base_nodes, "nodes"), written(self.edges, "edges"))

    @staticmethod
    def under(path: Column, prefix: str | None) -> Column:
        return F.lit(True) if not prefix else path.startswith(prefix)

    @classmethod
    def of(cls, spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> SymbolGraph:
        """From (path, kind) and (edge kind, src, dst) tuples: for small graphs, as in tests."""
        return cls(spark.createDataFrame(nodes, "path string, node_kind string").dropDuplicates(["path"]), spark.createDataFrame(edges, schema.EDGES).distinct())
