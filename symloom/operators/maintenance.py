"""Building and changing a graph. Edges belong to the file of their source; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def _one_per_path(nodes: DataFrame, rank: str) -> DataFrame:
    """The row of highest rank per path; a null kind or span gives way to another's."""
    w = Window.partitionBy("path").orderBy(F.desc(rank)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = nodes.select("path", F.first("node_kind", True).over(w).alias("node_kind"), F.first("span", True).over(w).alias("span"))
    return best.dropDuplicates(["path"])


class Maintenance:
    def _new(self, nodes: DataFrame, edges: DataFrame):
        return type(self)(nodes, edges)

    def merge(self, other):
        """Union of two graphs; the other's kinds and spans win."""
        nodes = self.base_nodes.withColumn("r", F.lit(0)).unionByName(other.base_nodes.withColumn("r", F.lit(1)))
        return self._new(_one_per_path(nodes, "r"), self.edges.unionByName(other.edges).distinct())

    def upsert_node(self, path: str, kind: str | None = None):
        row = self.spark.createDataFrame([(path, kind)], "path string, node_kind string")
        return self.merge(self._new(row, self.edges.limit(0)))

    def upsert_edge(self, kind: str, src: str, dst: str):
        return self._new(self.base_nodes, self.edges.unionByName(self.spark.createDataFrame([(kind, src, dst)], "kind string, src string, dst string")).distinct())

    def remove_node(self, path: str):
        """The node and its edges; descendants stay."""
        return self._new(self.base_nodes.where(F.col("path") != path), self.edges.where((F.col("src") != path) & (F.col("dst") != path)))

    def remove_subtree(self, path: str):
        """The node, its descendants, and the edges of all of them."""
        inside = lambda c: (F.col(c) == path) | F.col(c).startswith(path + paths.SEP)
        return self._new(self.base_nodes.where(~inside("path")), self.edges.where(~inside("src") & ~inside("dst")))

    def remove_file(self, file: str):
        """The file's tree and every edge that touches it, from other files too."""
        return self.remove_subtree(file)

    def extract_file(self, file: str):
        """The file's nodes and outgoing edges, and the nodes these point to."""
        mine = lambda c: paths.file_of(F.col(c)) == file
        edges = self.edges.where(mine("src"))
        far = self.base_nodes.join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_semi").where(~mine("path"))
        return self._new(self.base_nodes.where(mine("path")).unionByName(far.select("path", "node_kind", "span")), edges)

    def replace_files(self, files: DataFrame, new):
        """Swaps whole files (one column, file) for what `new` has of them.

        Edges into them from elsewhere stay as long as their target still exists; edges to nodes that are gone go.
        """
        files = files.select(F.col("file").alias("owner_")).distinct()
        owned = lambda df, c, how: df.join(files, paths.file_of(F.col(c)) == F.col("owner_"), how)
        nodes = owned(self.base_nodes, "path", "left_anti").unionByName(owned(new.base_nodes, "path", "left_semi"))
        far = new.base_nodes.join(files, paths.file_of(F.col("path")) == F.col("owner_"), "left_anti")
        nodes = nodes.unionByName(far.join(self.base_nodes.select("path"), "path", "left_anti").select("path", "node_kind", "span")).dropDuplicates(["path"])
        edges = owned(self.edges, "src", "left_anti").unionByName(owned(new.edges, "src", "left_semi")).distinct()
        edges = edges.join(nodes.select(F.col("path").alias("dst")), "dst", "left_semi").select("kind", "src", "dst")
        return self._new(nodes, edges)

    def replace_file(self, file: str, new):
        return self.replace_files(self.spark.createDataFrame([(file,)], "file string"), new)

    def replace_from_store(self, file: str, store):
        """The file as another graph has it, with its edges and what these point to."""
        return self.replace_file(file, store.extract_file(file))

    def redirect(self, moves: DataFrame, drop: bool = True):
        """moves (old, new): edges of every kind go to the new node, loops that this makes are dropped, and so are the old nodes."""
        a, b = (moves.select(F.col("old").alias(f"{c}_old"), F.col("new").alias(f"{c}_new")) for c in ("src", "dst"))
        e = self.edges.join(a, F.col("src") == F.col("src_old"), "left").join(b, F.col("dst") == F.col("dst_old"), "left")
        moved = F.col("src_new").isNotNull() | F.col("dst_new").isNotNull()
        e = e.select("kind", F.coalesce("src_new", "src").alias("src"), F.coalesce("dst_new", "dst").alias("dst"), moved.alias("moved")).where("NOT (moved AND src = dst)").drop("moved").distinct()
        nodes = self.base_nodes.join(moves.select(F.col("old").alias("path")), "path", "left_anti").select("path", "node_kind", "span") if drop else self.base_nodes
        return self._new(nodes, e)

    def stub_moves_by_name(self) -> DataFrame:
        """old, new: stubs (no separator) whose name exactly one symbol bears."""
        one = self.symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("new")).where("n = 1")
        return self.nodes.where("NOT is_symbol").select(F.col("path").alias("old")).join(one, F.col("old") == F.col("name")).select("old", "new")

    def stub_moves_by_imports(self) -> DataFrame:
        """old, new: for stubs with several namesakes, the one with most votes; a caller votes for those whose file, or which itself, its file imports."""
        defs = self.symbols.select("name", F.col("path").alias("new"), F.col("file").alias("def_file"))
        stubs = self.nodes.where("NOT is_symbol").select(F.col("path").alias("old")).join(defs, F.col("old") == F.col("name"))
        callers = self.kind("calls").select(F.col("dst").alias("old"), "src", paths.file_of(F.col("src")).alias("from_file")).distinct()
        imports = self.kind("imports").select(paths.file_of(F.col("src")).alias("from_file"), F.col("dst").alias("what")).distinct()
        asked = stubs.join(callers, "old")
        named = asked.select("old", "new", "src", "from_file", F.explode(F.array_distinct(F.array("new", "def_file"))).alias("what"))
        votes = named.join(imports, ["from_file", "what"]).groupBy("old", "new").agg(F.count_distinct("src").alias("votes"))
        best = Window.partitionBy("old").orderBy(F.desc("votes"), "new")
        return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("old", "new")

    def resolve_stubs(self):
        """By unique name first, then by imports."""
        once = self.redirect(self.stub_moves_by_name()).written()
        return once.redirect(once.stub_moves_by_imports())
