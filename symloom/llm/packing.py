"""Best-fit packing by large-item matching.

Lengths are whole numbers up to the capacity, so a packing is planned on their histogram (at most `capacity`
numbers, whatever the input): lengths above a third of the capacity are matched greedily, at most two to a
bin, each with the longest partner that still fits; smaller ones go, longest first, to the tightest gap.
The plan says how many bins have which lengths where. Items then take places by their rank within their
length; ranks come from counts by (length, hash bucket), so no length is ever ranked in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import END_ID, body, written
from .pieces import ByteBpe, loaded

CAPACITY = 1024
#: Items of one length that are ranked together, about.
RANKED = 100_000


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, their lengths in order of place) for a histogram length -> count. Greedy, exact in number: every item gets one place."""
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    large = sorted(n for n in left if 3 * n > capacity)
    classes: dict[int, list[list]] = {}
    gaps: list[int] = []

    def add(gap: int, bins: int, items: list[int]) -> None:
        if bins:
            if gap not in classes:
                classes[gap] = []
                bisect.insort(gaps, gap)
            classes[gap].append([bins, items])

    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else None
        if b is None or (b == a and left[a] < 2 and k == 0):
            add(capacity - a, left[a], [a])
            left[a] = 0
        elif b == a:
            if left[a] >= 2:
                add(capacity - 2 * a, left[a] // 2, [a, a])
                left[a] %= 2
            if left[a]:  # the odd one takes the next shorter partner, if there is one
                b = large[k - 1] if k else None
                add(capacity - a - (b or 0), 1, [a, b] if b else [a])
                left[a] = 0
                if b:
                    left[b] -= 1
        else:
            n = min(left[a], left[b])
            add(capacity - a - b, n, [a, b])
            left[a] -= n
            left[b] -= n
        large = [n for n in large if left[n]]
    for s in sorted((n for n in left if left[n]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                per = capacity // s
                full, rest = divmod(left[s], per)
                add(capacity - per * s, full, [s] * per)
                add(capacity - rest * s, bool(rest), [s] * rest)
                left[s] = 0
                break
            gap = gaps[at]
            bins, items = classes[gap].pop()
            if not classes[gap]:
                del classes[gap]
                gaps.pop(at)
            per = gap // s
            full = min(bins, left[s] // per)
            add(gap - per * s, full, items + [s] * per)
            left[s] -= full * per
            if full < bins:
                rest = min(left[s], per)
                add(gap - rest * s, 1, items + [s] * rest)
                left[s] -= rest
                add(gap, bins - full - 1, items)
    return [(bins, items) for gap in gaps for bins, items in classes[gap]]


def _places(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank of each range, sequence of its first rank, offset in the sequence)."""
    at: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for bins, items in plan:
        offset = 0
        for n in items:
            at.setdefault(n, []).append((ranks.get(n, 0), sequence, offset))
            ranks[n] = ranks.get(n, 0) + bins
            offset += n
        sequence += bins
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in at.items()}


def pack(items: DataFrame, length: str = "length", by: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset: few sequences of at most `capacity`, gapless from 0.

    items must be a written table (it is read three times). Lengths must lie in 1..capacity. Rows are ranked by `by`, then arbitrarily
    among full ties; repeated rows each get a place. An empty table gives no rows.
    """
    spark = items.sparkSession
    counts = {int(r["n_"]): int(r["c_"]) for r in items.groupBy(F.col(length).cast("int").alias("n_")).agg(F.count("*").alias("c_")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_places(plan_bins(counts, capacity)))  # bounded by the capacity, not by the data
    buckets = max(8, -(-max(counts.values(), default=0) // RANKED))
    salted = items.withColumn("salt_", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in by)), F.lit(buckets)).cast("int"))
    before = salted.groupBy(length, "salt_").agg(F.count("*").alias("c_"))
    before = before.withColumn("before_", F.sum("c_").over(Window.partitionBy(length).orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1))).select(length, "salt_", F.coalesce("before_", F.lit(0)).alias("before_"))
    ranked = salted.withColumn("rank_", F.row_number().over(Window.partitionBy(length, "salt_").orderBy(*(F.col(f"`{c}`") for c in by))) - 1)
    ranked = ranked.join(before, [length, "salt_"]).withColumn("rank_", F.col("rank_") + F.col("before_")).select(*(F.col(f"`{c}`") for c in items.columns), "rank_")
    out = items.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            n = batch.column(length).to_numpy(zero_copy_only=False)
            rank = batch.column("rank_").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for one in np.unique(n):
                first, base, off = table[int(one)]
                mine = np.flatnonzero(n == one)
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = base[k] + rank[mine] - first[k]
                offset[mine] = off[k]
            yield pa.RecordBatch.from_arrays([*batch.select(out).columns, pa.array(sequence), pa.array(offset)], names=[*out, "sequence_id", "offset"])

    from pyspark.sql import types as T

    return ranked.mapInArrow(place, T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", id_: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit).

    A document is its ids and END_ID. Longer ones than the capacity are cut so that all pieces but the first are full. Null texts count as empty (one
    piece: the end id). Repeated rows are repeated, null ids kept; no rows give no rows; other columns play no part.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(ByteBpe, tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(x) + end
                total = len(ids) // 4
                start, upto, piece = 0, (total - 1) % capacity + 1, 0
                while start < total:
                    part = ids[4 * start : 4 * upto]
                    rows.append((doc, piece, start, upto - start, zlib.crc32(part), *([part] * with_ids)))
                    start, upto, piece = upto, upto + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=list(names))

    return docs.select(F.col(f"`{id_}`").cast("long"), body(f"`{text}`")).toDF("a", "b").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", id_: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """token_pieces() packed into sequences."""
    return pack(written(token_pieces(docs, tokenizer, capacity, text, id_, with_ids), "pieces"), "length", ("doc_id", "piece"), capacity)
