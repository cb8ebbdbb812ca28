"""Context bundles for a task, and output budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import EDGE_KINDS

STOP_WORDS = "a an and are as at by call calls does flow for from how in into is of on or through to trace what when where which why with work works".split()
#: Tier: nodes below, most nodes, most edges.
TIERS = {"small": (500, 15, 30), "medium": (5_000, 30, 60), "large": (None, 50, 100)}


def task_candidates(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with candidates: words of [A-Za-z0-9_] that might name symbols, in order, without repeats."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    good = lambda w: ~w.rlike("^[0-9]") & (F.length(w) >= 3) & ~F.lower(w).isin(STOP_WORDS) & (w.rlike("[A-Z_]") | (F.length(w) >= 4))
    return texts.withColumn("candidates", F.array_distinct(F.filter(words, good)))


def is_selector(text) -> object:
    """Whether a task column reads like a selector: a #, a [, or a letter after its first colon."""
    return F.contains(text, F.lit("#")) | F.contains(text, F.lit("[")) | text.rlike("^[^:]*:[A-Za-z]")


def budget(nodes: int, override: str | None = None) -> dict:
    """mode, max_nodes, max_edges (null: no limit) for a project's size."""
    if override == "disabled":
        return {"mode": "disabled", "max_nodes": None, "max_edges": None}
    mode = override if override in TIERS else next(m for m, (below, _, _) in TIERS.items() if below is None or nodes < below)
    return {"mode": mode, "max_nodes": TIERS[mode][1], "max_edges": TIERS[mode][2]}


_NODE_KEYS = ("nodes", "paths", "results", "symbols", "dead_symbols", "isolated_symbols")
_EDGE_KEYS = ("edges", "callees", "callers", "reachable", "callee_paths", "caller_paths")


def apply_budget(row: DataFrame, limits: dict) -> DataFrame:
    """Cuts a row's array columns to the budget; adds truncated and total_available (of the first array cut)."""
    cuts = [(k, limits["max_nodes"]) for k in _NODE_KEYS if k in row.columns] + [(k, limits["max_edges"]) for k in _EDGE_KEYS if k in row.columns]
    cuts = [(k, n) for k, n in cuts if n is not None]
    over = [F.when(F.size(k) > n, F.size(k)) for k, n in cuts] or [F.lit(None).cast("int")]
    fields = F.array_compact(F.array(*(F.when(F.size(k) > n, F.lit(k)) for k, n in cuts))) if cuts else F.array().cast("array<string>")
    out = row.withColumns({"total_available": F.coalesce(*over), "truncated_fields": fields})
    for k, n in cuts:
        out = out.withColumn(k, F.slice(k, 1, n))
    return out.withColumn("truncated", F.col("total_available").isNotNull())


class Agent:
    def budget_resolve(self, override: str | None = None) -> DataFrame:
        """One row: mode, max_nodes, max_edges for this graph's number of nodes."""
        n = F.col("node_count")
        case = lambda i: F.when(n < 500, F.lit(TIERS["small"][i])).when(n < 5_000, F.lit(TIERS["medium"][i])).otherwise(F.lit(TIERS["large"][i]))
        counts = self.nodes.agg(F.count("*").alias("node_count"))
        if override in (None, "auto"):
            mode = F.when(n < 500, F.lit("small")).when(n < 5_000, F.lit("medium")).otherwise(F.lit("large"))
            return counts.select(mode.alias("mode"), case(1).alias("max_nodes"), case(2).alias("max_edges"))
        b = budget(0, override)
        return counts.select(F.lit(b["mode"]).alias("mode"), F.lit(b["max_nodes"]).cast("int").alias("max_nodes"), F.lit(b["max_edges"]).cast("int").alias("max_edges"))

    def ctx_seed(self, candidates: list[str], max_nodes: int = 30) -> DataFrame:
        """pos, path: the first matches of the first ten candidates by name, without repeats, cut to max_nodes."""
        asked = self.spark.createDataFrame(list(enumerate(candidates[:10])), "c int, word string")
        hits = self.nodes.select("path", F.lower("name").alias("n")).join(F.broadcast(asked), F.contains(F.col("n"), F.lower("word")))
        each = hits.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("path"))).where(F.col("r") <= max(5, max_nodes // 3))
        first = each.groupBy("path").agg(F.min(F.struct("c", "r")).alias("at")).orderBy("at").limit(max_nodes)
        return first.select((F.row_number().over(Window.orderBy("at")) - 1).alias("pos"), "path").orderBy("pos")

    def ctx_expand(self, entries: DataFrame, max_nodes: int = 30, kinds: tuple[str, ...] = ("calls",)) -> tuple[DataFrame, DataFrame]:
        """(nodes: pos, path; edges: pos, src, dst, kind) one hop around the entry points (pos, path), until there are max_nodes nodes."""
        wanted = [k for k in dict.fromkeys(kinds) if k in EDGE_KINDS] or ["calls"]
        eps = entries.where(F.col("pos") < max_nodes)
        order = F.array_position(F.array(*map(F.lit, wanted)), F.col("kind"))
        e = self.edges.where(F.col("kind").isin(wanted))
        out = eps.join(e, F.col("path") == F.col("src")).select("pos", order.alias("k"), F.lit(0).alias("way"), F.col("dst").alias("other"), "src", "dst", "kind")
        into = eps.join(e, F.col("path") == F.col("dst")).select("pos", order.alias("k"), F.lit(1).alias("way"), F.col("src").alias("other"), "src", "dst", "kind")
        rows = out.unionByName(into).withColumn("at", F.row_number().over(Window.orderBy("pos", "k", "way", "other")))
        rows = rows.join(eps.select(F.col("path").alias("other"), F.lit(True).alias("known")), "other", "left")
        first = F.row_number().over(Window.partitionBy("other").orderBy("at")) == 1
        rows = rows.withColumn("new", (F.col("known").isNull() & first).cast("int"))
        before = F.coalesce(F.sum("new").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        n = eps.agg(F.count("*").alias("n"))
        walked = rows.withColumn("before", before).join(F.broadcast(n)).where(F.col("n") + F.col("before") < max_nodes)
        nodes = eps.select("pos", "path").unionByName(walked.where("new = 1").select((F.col("n") + F.col("before")).cast("int").alias("pos"), F.col("other").alias("path")))
        edges = walked.groupBy("src", "dst", "kind").agg(F.min("at").alias("pos"))
        return nodes.orderBy("pos"), edges.select("pos", "src", "dst", "kind").orderBy("pos")

    def ctx_blocks(self, nodes: DataFrame, max_blocks: int = 6) -> DataFrame:
        """pos, file, symbol, span: the first node of each file, cut."""
        first = nodes.withColumn("file", paths.file_of(F.col("path"))).withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).where("r = 1")
        known = first.join(self.base_nodes.select("path", "span"), "path")
        return known.select("pos", "file", paths.name_of(F.col("path")).alias("symbol"), "span").orderBy("pos").limit(max_blocks)

    def ctx_related_files(self, nodes: DataFrame) -> DataFrame:
        """file, pos of its first node; in that order."""
        return nodes.groupBy(paths.file_of(F.col("path")).alias("file")).agg(F.min("pos").alias("pos")).orderBy("pos")

    def context(self, task: str, max_nodes: int = 30, max_blocks: int = 6, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
        """One row: routing, candidates, entry_points, nodes, edges, related_files, code_blocks as arrays."""
        max_nodes, max_blocks = min(max_nodes, 100), min(max_blocks, 25)
        one = self.spark.createDataFrame([(task,)], "text string")
        row = task_candidates(one).select("candidates", is_selector(F.col("text")).alias("s")).first()
        if row["s"]:
            found = self.select(task).limit(max_nodes)
            entries = found.select((F.row_number().over(Window.orderBy("path")) - 1).alias("pos"), "path")
        else:
            entries = self.ctx_seed(row["candidates"], max_nodes)
        nodes, edges = self.ctx_expand(entries, max_nodes, kinds)
        listed = lambda df, value, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"]).alias(name))
        path = F.col("path")
        out = one.select(F.lit("selector" if row["s"] else "natural").alias("routing"), F.lit(row["candidates"]).cast("array<string>").alias("candidates"))
        for part in (
            listed(entries, path, "entry_points"), listed(nodes, path, "nodes"), listed(edges, F.concat_ws(" ", "src", "kind", "dst"), "edges"),
            listed(self.ctx_related_files(nodes), F.col("file"), "related_files"), listed(self.ctx_blocks(nodes, max_blocks), F.concat_ws(" ", "file", "symbol"), "code_blocks"),
        ):
            out = out.join(part)
        return out
