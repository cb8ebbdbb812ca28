"""Changes between two states of a graph, and which subscriptions they concern. All plain DataFrame code, batch or micro-batch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGES = ("added", "modified", "removed")
#: Entries per list, files per notification, files named in a broadcast notice.
MOST_PATHS, MOST_FILES, MOST_NAMED = 50, 16, 50


def symbol_delta(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("file", "path")) -> DataFrame:
    """keys, change: added, removed, or modified for what is in both."""
    a, b = old.select(*keys).distinct().withColumn("o_", F.lit(True)), new.select(*keys).distinct().withColumn("n_", F.lit(True))
    change = F.when(F.col("o_").isNull(), "added").when(F.col("n_").isNull(), "removed").otherwise("modified")
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def glob_regex(glob: str) -> str:
    """* within a segment of a path, ** across them, ? one sign."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
            i += 1
    return f"^{out}$"


def watch_filter(files: Column, extensions: tuple[str, ...], ignored: tuple[str, ...] = ("target/**", ".git/**")) -> Column:
    """Whether a changed file is worth looking at."""
    keep = F.lower(F.substring_index(F.substring_index(files, "/", -1), ".", -1)).isin(*extensions) & F.contains(F.substring_index(files, "/", -1), F.lit("."))
    for glob in ignored:
        keep = keep & ~files.rlike(glob_regex(glob))
    return keep


def match_files(delta: DataFrame, globs: list[str]) -> DataFrame:
    return delta.where(_any("file", globs))


def match_symbols(delta: DataFrame, globs: list[str]) -> DataFrame:
    """By path; * does not cross a slash."""
    return delta.where(_any("path", globs))


def _any(col: str, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | F.col(col).rlike(glob_regex(g))
    return out


def match_selector(before: DataFrame, after: DataFrame, delta: DataFrame) -> DataFrame:
    """path, change of a selector's results: what came in, what left, and what stayed in and was touched."""
    change = symbol_delta(before, after, ("path",))
    touched = delta.select("path").distinct()
    return change.where("change <> 'modified'").unionByName(change.where("change = 'modified'").join(touched, "path", "left_semi"))


def delta_caps(delta: DataFrame, most_paths: int = MOST_PATHS, most_files: int = MOST_FILES) -> DataFrame:
    """file, change, total, paths: sorted lists, cut, for the first files by name."""
    rank = Window.partitionBy("file", "change").orderBy("path")
    d = delta.select("file", "change", "path").distinct().withColumn("r_", F.row_number().over(rank))
    each = d.groupBy("file", "change").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("r_") <= most_paths, F.col("path")))).alias("paths"))
    first = d.select("file").distinct().orderBy("file").limit(most_files)
    return each.join(F.broadcast(first), "file", "left_semi")


def graph_changed(delta: DataFrame, by: str = "batch_seq") -> DataFrame:
    """One notice per batch: its files, cut, with their number and whether they were cut."""
    files = delta.select(by, "file").distinct().withColumn("r_", F.row_number().over(Window.partitionBy(by).orderBy("file")))
    out = files.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("r_") <= MOST_NAMED, F.col("file")))).alias("changed_files"), F.count("*").alias("n_files"))
    return out.withColumn("truncated", F.col("n_files") > MOST_NAMED)


def result_hash(paths: DataFrame) -> DataFrame:
    """One row: hash of the sorted set of paths."""
    return paths.agg(F.sha2(F.array_join(F.array_sort(F.collect_set("path")), "\n"), 256).alias("hash"))


def set_summary(last: DataFrame, now: DataFrame, most: int = MOST_PATHS) -> DataFrame:
    """One row: numbers and cut lists of added and removed paths."""
    d = symbol_delta(last, now, ("path",)).withColumn("r_", F.row_number().over(Window.partitionBy("change").orderBy("path")))
    cut = lambda c: F.array_sort(F.collect_list(F.when((F.col("change") == c) & (F.col("r_") <= most), F.col("path")))).alias(c)
    return d.agg(F.count_if(F.col("change") == "added").alias("n_added"), F.count_if(F.col("change") == "removed").alias("n_removed"), cut("added"), cut("removed"))
