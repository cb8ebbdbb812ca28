"""Exact top-k inner products by multi-resolution segment statistics.

A vector's segments give bounds without its components: over a segment of n components,
sum(q*x) <= n * mean(q) * mean(x) + n * dev(q) * dev(x) (Cauchy and Schwarz on what the means leave over).
In terms of distance, |q-x|^2 = |q|^2 + |x|^2 - 2 q.x, so an upper bound of the product is a lower bound of the
distance. Bounds are taken coarse to fine (1, 4, 16 segments); pairs that stay above the query's k-th best so far
are computed exactly. Queries go out in blocks of bounded size, one after the other, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

LEVELS = (1, 4, 16)
#: Bytes of the queries that go out at once, about; (query, candidate) pairs whose bounds a task holds at once.
QUERY_BYTES, PAIRS = 16_000_000, 1_000_000
_MOST = np.iinfo(np.int64).max


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Without vectors that are null or hold null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vectors.where(F.col(vec).isNotNull() & ~F.exists(vec, bad))


def whole(vectors: DataFrame, id_: str = "vec_id", vec: str = "embedding", scale: int = 1024) -> DataFrame:
    """id and floor(scale * component) as whole numbers, which a double holds exactly (scale being a power of two)."""
    scaled = F.transform(F.col(f"`{vec}`"), lambda x: x.cast("double") * F.lit(float(scale)))
    rows = vectors.where(F.col(f"`{id_}`").isNotNull() & F.col(f"`{vec}`").isNotNull()).select(F.col(f"`{id_}`").cast("long").alias("id_"), scaled.alias("v_"))
    # whole already beyond 2^53, where floor() would go through a long
    return usable(rows, "v_").select("id_", F.transform("v_", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)).alias("v_"))


def _statistics(m: np.ndarray) -> list[np.ndarray]:
    """Per level: for each row, sqrt(n)*mean and sqrt(n)*dev of each segment, side by side; a product of two rows bounds their inner product."""
    out = []
    for level in LEVELS:
        if level > m.shape[1]:
            break
        parts = np.array_split(np.arange(m.shape[1]), level)
        mean = np.stack([m[:, p].mean(1) * np.sqrt(len(p)) for p in parts], 1)
        dev = np.stack([m[:, p].std(1) * np.sqrt(len(p)) for p in parts], 1)
        out.append(np.concatenate([mean, dev], 1))
    return out


def _products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; what a long doesn't hold is the nearest long."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if bound < 2.0**53:
        return (rows @ q).astype(np.int64)
    if bound < 2.0**62:
        return rows.astype(np.int64) @ q.astype(np.int64)
    other = [int(x) for x in q]
    return np.array([min(max(sum(int(x) * y for x, y in zip(row, other)), -_MOST - 1), _MOST) for row in rows], np.int64)


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k, self.levels = queries, ids, k, _statistics(queries)
        self.score = np.zeros((len(ids), k), np.int64)
        self.who = np.zeros((len(ids), k), np.int64)
        self.have = np.zeros(len(ids), np.int64)
        self.rows = max(16, PAIRS // max(1, len(ids)))

    def offer(self, rows: np.ndarray, ids: np.ndarray) -> None:
        stats = _statistics(rows)
        slack = 1e-6 * (1 + np.abs(rows).max(initial=0) * np.abs(self.q).max(initial=0) * rows.shape[1])
        # pairs that only equal the k-th best stay: a tie goes to the smaller id; so do bounds beyond a long, as scores end there
        least = np.where(self.have < self.k, -np.inf, np.minimum(self.score[:, -1].astype(np.float64), 2.0**62))
        alive = np.ones((len(self.ids), len(ids)), bool)
        for level, ql in enumerate(self.levels):
            alive &= ql @ stats[level].T + slack >= least[:, None]
            cols = np.flatnonzero(alive.any(0))
            if not len(cols):
                return
            if len(cols) < len(ids):
                rows, ids, alive, stats = rows[cols], ids[cols], alive[:, cols], [s[cols] for s in stats]
        for qi in np.flatnonzero(alive.any(1)):
            js = np.flatnonzero(alive[qi])
            js = js[ids[js] != self.ids[qi]]
            if not len(js):
                continue
            n = self.have[qi]
            s = np.concatenate([self.score[qi, :n], _products(rows[js], self.q[qi])])
            w = np.concatenate([self.who[qi, :n], ids[js]])
            top = np.lexsort((w, ~s))[: self.k]  # ~s falls as s rises, and never overflows
            n = self.have[qi] = len(top)
            self.score[qi, :n], self.who[qi, :n] = s[top], w[top]


def top_k(vectors: DataFrame, is_query, k: int = 10, id_: str = "vec_id", vec: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest inner product for each query row; ties go to the smaller id.

    Components are floor(scale * x). Rows without an id and vectors that are null or hold null or non-finite components (scaled ones, too) take no
    part, neither do pairs of different length; empty vectors score 0. A query's own id is no candidate. Queries with fewer than k candidates get
    all. Ids and scores are exact over the whole range of a long; scores beyond it count as its ends. Repeated rows with one id count as often as
    they occur; of those with a query's id the least vector asks. No rows, or no queries, give no rows; other columns play no part.
    """
    spark = vectors.sparkSession
    rows = written(whole(vectors, id_, vec, scale), "vectors")
    queries = written(rows.where(is_query(F.col("id_"))).groupBy("id_").agg(F.min("v_").alias("v_")), "queries")
    size = queries.agg(F.sum(F.size("v_") * 8 + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    parts = []
    for b in range(blocks):
        block = spark.sparkContext.broadcast(_packed(queries.where(F.pmod(F.xxhash64("id_"), F.lit(blocks)) == b)))  # about QUERY_BYTES

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            best = {d: _Best(m, ids, k) for d, (ids, m) in block.value.items()}
            for batch in batches:
                ids, sizes, flat = batch.column(0).to_numpy(), *_flat(batch.column(1))
                ends = np.cumsum(sizes)
                for d in np.unique(sizes):
                    one = best.get(int(d))
                    if one is None:
                        continue
                    at = np.flatnonzero(sizes == d)
                    for a in range(0, len(at), one.rows):
                        mine = at[a : a + one.rows]
                        one.offer(flat[(ends[mine] - d)[:, None] + np.arange(d)[None, :]], ids[mine])
            for one in best.values():
                q, r = np.nonzero(np.arange(k)[None, :] < one.have[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(one.ids[q]), pa.array(one.who[q, r]), pa.array(one.score[q, r])], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        parts.append(written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), f"top-{b}"))
        block.destroy()
    discard(rows, queries)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each vector, all components)."""
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _packed(block: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (ids, matrix)."""
    table = block.toArrow().combine_chunks()
    if not table.num_rows:
        return {}
    ids, (sizes, flat) = table.column("id_").to_numpy(), _flat(table.column("v_").combine_chunks() if table.column("v_").num_chunks != 1 else table.column("v_").chunk(0))
    ends, out = np.cumsum(sizes), {}
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out[int(d)] = ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)[None, :]]
    return out
