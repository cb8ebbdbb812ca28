"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts (white space deleted), each partition is sorted
externally, so that equal texts lie next to each other, and neighbours are compared in full. The range key
ends in the row's id: a text that a third of all rows share is spread over as many partitions as it fills.
Only runs that touch a partition's edge can go on elsewhere; those few are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, body, written

PREFIX = 48
_RUN = [
    T.StructField("pid_", T.IntegerType()), T.StructField("key_no_", T.LongType()), T.StructField("run_no_", T.LongType()),
    T.StructField("head_", T.BooleanType()), T.StructField("sha_", T.StringType()),
]


def _mark(heads_only: bool, names: list[str]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, last_key, key_no, run_no = None, None, -1, -1
        for batch in batches:
            norms, keys = batch.column("norm_").to_pylist(), batch.column("hash_").to_pylist()
            cols = ([], [], [], [], [])
            take = []
            for i, (norm, key) in enumerate(zip(norms, keys)):
                head = key != last_key or norm != last
                if head:
                    run_no += 1
                    key_no += key != last_key
                    last, last_key = norm, key
                if head or not heads_only:
                    take.append(i)
                    for c, v in zip(cols, (pid, key_no, run_no, head, hashlib.sha256(norm.encode()).hexdigest() if head else None)):
                        c.append(v)
            kept = batch.select(names).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())],
                names=[*names, *(f.name for f in _RUN)],
            )

    return mark


def _sorted_runs(docs: DataFrame, carry: list[str], heads_only: bool, text: str, id_: str) -> DataFrame:
    """Carried columns, cp_ (code points), and each row's run. A run's first row is the one that stays: most code points, then smallest id."""
    norm = F.regexp_replace(F.col("text_"), f"[{WS}]+", "")
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}_") for i, c in enumerate(carry)), body(f"`{text}`").alias("text_"), F.col(f"`{id_}`").alias("id_"))
    ranged = rows.repartitionByRange(F.substring(norm, 1, PREFIX), F.xxhash64(norm), F.col("id_"), F.length("text_"))
    keyed = ranged.select(*(f"c{i}_" for i in range(len(carry))), "id_", F.length("text_").alias("cp_"), norm.alias("norm_"))
    keyed = keyed.withColumn("hash_", F.xxhash64("norm_")).withColumn("prefix_", F.substring("norm_", 1, PREFIX))
    ordered = keyed.sortWithinPartitions("prefix_", "hash_", "norm_", F.col("cp_").desc(), F.col("id_").asc_nulls_last()).drop("prefix_")
    names = [*(f"c{i}_" for i in range(len(carry))), "id_", "cp_"]
    schema = T.StructType([ordered.schema[n] for n in names] + _RUN)
    return ordered.mapInArrow(_mark(heads_only, names), schema)


def _merged_edges(heads: DataFrame) -> DataFrame:
    """For runs that a splitter cut: (pid_, run_no_) and the whole group's row that stays (best_) and number of rows (all_n_). heads: one row per run."""
    last = heads.groupBy("pid_").agg(F.max("key_no_").alias("last_key_"))
    edge = heads.join(last, "pid_").where((F.col("key_no_") == 0) | (F.col("key_no_") == F.col("last_key_")))
    best = F.max(F.struct(F.col("cp_"), F.col("id_").isNotNull(), -F.col("id_").cast("long"), -F.col("pid_"))).alias("best_")
    whole = edge.groupBy("sha_").agg(best, F.sum("n_").alias("all_n_"), F.count("*").alias("parts_")).where("parts_ > 1")
    return edge.join(whole, "sha_").select("pid_", "run_no_", (-F.col("best_.col4")).alias("best_pid_"), (-F.col("best_.col3")).alias("best_id_"), "all_n_")


def exact_duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after deleting ASCII white space; of equal texts the longest in code points,
    then the smallest id, stays. Null texts count as empty, empty texts equal one another. Null ids come last;
    of fully tied rows (the same row repeated) exactly one is kept. No rows give no rows; other columns play no part.
    """
    rows = written(_sorted_runs(docs, [], False, text, id_), "dedup-runs")
    runs = rows.groupBy("pid_", "run_no_").agg(F.count("*").alias("n_"), F.max("key_no_").alias("key_no_"), F.max("sha_").alias("sha_"), F.max("cp_").alias("cp_"), F.max(F.when(F.col("head_"), F.col("id_"))).alias("id_"))
    merged = _merged_edges(runs)
    final = runs.join(merged, ["pid_", "run_no_"], "left").select(
        "pid_", "run_no_", "sha_",
        F.when(F.col("best_pid_").isNull(), F.col("id_")).otherwise(F.col("best_id_")).alias("keep_"),
        F.coalesce("all_n_", "n_").alias("n_"),
        (F.col("best_pid_").isNull() | (F.col("best_pid_") == F.col("pid_"))).alias("here_"),
    )
    return rows.drop("sha_", "key_no_", "cp_").join(final, ["pid_", "run_no_"]).select(
        F.col("id_").alias(id_), F.col("keep_").alias("keep_id"), F.col("n_").alias("group_size"), (F.col("head_") & F.col("here_")).alias("kept"), F.col("sha_").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_duplicates() keeps, whole and with all their columns."""
    heads = written(_sorted_runs(docs, docs.columns, True, text, id_), "dedup-heads")
    merged = _merged_edges(heads.select("pid_", "key_no_", "run_no_", "sha_", "cp_", "id_", F.lit(1).cast("long").alias("n_")))
    lost = merged.where(F.col("best_pid_") != F.col("pid_")).select("pid_", "run_no_")
    return heads.join(lost, ["pid_", "run_no_"], "left_anti").select(*(F.col(f"c{i}_").alias(c) for i, c in enumerate(docs.columns)))
