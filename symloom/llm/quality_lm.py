"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The grams are pairs of words, so what is counted grows with the text. A word is a run of letters and digits, any other
sign that is no white space, or one sign of a script without word breaks; it takes 31 bits of a hash, so a pair is one long.
Counts of pairs are sharded by pair; continuation counts and context totals are aggregated from them.

The model is one table of what each known word and pair adds to a text's log probability over that of as many unknown
words (see additive()), and a text's perplexity comes from one join of its grams with that table, sharded by gram. Two things
keep grams from moving there and change no score: the most frequent words and pairs (HEAD_ROWS of each at most) are looked up
where the text is, and so is, in a Bloom filter, whether the table has a gram at all. Each text is split into words once; what is
left of a batch's grams moves as one block for each shard, each gram once with the rows that have it, and their sums move back so.

One trusted document in HELD_OUT doesn't train the model. A document is rejected if its perplexity is above its
language's threshold for its length, from a quantile of these held-out documents' deviations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, discard, if_small, written

#: Signs that are coded at once, and signs of short texts that are gathered for it.
CHUNK, GATHERED = 250_000, 100_000
#: One trusted document in so many only serves to set thresholds.
HELD_OUT = 5
#: Thresholds are at this quantile of a language's held-out documents; OWN_DOCS of them are needed for a language to have its own.
QUANTILE, OWN_DOCS = 0.995, 30
#: Words, and as many pairs, that are looked up in place (12 bytes each); rows of the rest up to which there is a filter of them (24 MB).
HEAD_ROWS, FILTER_ROWS = 500_000, 48_000_000
#: Words that are broadcast while the model is made; pairs of other ones take two joins.
WORD_ROWS = 400_000
#: Rows of the rest in a shard, which one task holds; grams of texts that a task gathers before it sends them on.
SHARD_ROWS, HELD_HITS = 1_000_000, 1_000_000
#: The texts are scored in so many parts, twice as many without a filter, so that no more than such a part of their grams is on disk at a time.
ROUNDS = 2
#: Grams that a task counts before it sends them on.
HELD_GRAMS = 4_000_000
_EDGE_SIGN = "\U0010ffff"
_WORD_BITS = 31
_EDGE_WORD = (1 << _WORD_BITS) - 1
_FILTER_WORDS = 3_000_000
#: Kinds of a block, in the order in which they are needed: of the table, of texts' grams or sums, of texts.
_MODEL, _PART, _TEXTS = 0, 1, 2


@lru_cache(1)
def _classes() -> np.ndarray:
    """By code point. 0: white space; 1: part of a word; 2: a word of its own (punctuation, ideographs and the like, the edge)."""
    out = np.full(0x110000, 2, np.uint8)
    for c in range(0x30000):
        if chr(c).isspace():
            out[c] = 0
        elif chr(c).isalnum() or c == 0x5F or unicodedata.category(chr(c))[0] == "M":
            out[c] = 1
    for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)):
        out[a : b + 1] = 2
    return out


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(31-bit code of each word, its start)."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes()[raw]
    before = np.r_[np.uint8(0), kind[:-1]]
    first = np.flatnonzero((kind & ~before & 1) | (kind >> 1))
    if not len(first):
        return np.zeros(0, np.int64), first
    # a word's hash is a sum over its signs, each mixed with its place in the word
    by_place = np.uint64(0xD6E8FEB86659FD93)
    x = raw.astype(np.uint64)
    x += np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    y = np.arange(len(raw), dtype=np.uint64)
    y *= by_place
    x += y
    x[first[0] :] -= np.repeat(first.astype(np.uint64) * by_place, np.diff(first, append=len(raw)))
    np.right_shift(x, np.uint64(32), out=y)
    x ^= y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(29), out=y)
    x ^= y
    x *= kind != 0
    h = np.add.reduceat(x, first) * np.uint64(0x94D049BB133111EB)
    code = (h >> np.uint64(33)).astype(np.int64)
    code[(code == _EDGE_WORD) | (code == 0)] = 1
    code[raw[first] == 0x10FFFF] = _EDGE_WORD
    return code, first


def word_pairs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words, with the edge before the first and after the last. A long text is cut at white space, and only a word longer than CHUNK inside."""
    held: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        word, at = _words("".join(held))
        starts = np.cumsum([0, *(len(h) for h in held)])
        own = np.repeat(np.arange(len(held)), np.diff(np.searchsorted(at, starts)))
        pair = np.flatnonzero(own[1:] == own[:-1]) + 1
        return word[pair - 1] << _WORD_BITS | word[pair], np.array(owner, np.int64)[own[pair]]

    for i, text in enumerate(texts):
        text = text.replace(_EDGE_SIGN, " ")
        if len(text) > CHUNK:
            if held:
                yield flush()
                held, owner, size = [], [], 0
            a, last = 0, _EDGE_WORD
            while a < len(text):
                b = min(a + CHUNK, len(text))
                if b < len(text):
                    b = a + (max(text.rfind(c, a, b) - a for c in " \n\t") + 1 or CHUNK)
                word = _words(text[a:b])[0]
                if b == len(text):
                    word = np.r_[word, _EDGE_WORD]
                before = np.r_[last, word[:-1]]
                if len(word):
                    yield before << _WORD_BITS | word, np.full(len(word), i, np.int64)
                    last = word[-1]
                a = b
            continue
        held.append(_EDGE_SIGN + text + _EDGE_SIGN)
        owner.append(i)
        size += len(held[-1])
        if size >= GATHERED:
            yield flush()
            held, owner, size = [], [], 0
    if held:
        yield flush()


def _reduced(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(texts: DataFrame) -> DataFrame:
    """gram, c over a one-column table of texts: each task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["gram", "c"])
        waiting, size = [], 0
        for batch in batches:
            for gram, _ in word_pairs(batch.column(0).to_pylist()):
                waiting.append(gram)
                size += len(gram)
                if size >= HELD_GRAMS:
                    u, c = np.unique(np.concatenate(waiting), return_counts=True)
                    codes, counts = _reduced(np.concatenate([codes, u]), np.concatenate([counts, c]))
                    waiting, size = [], 0
                    if len(codes) > HELD_GRAMS:
                        yield rows()
                        codes, counts = none
        if waiting:
            u, c = np.unique(np.concatenate(waiting), return_counts=True)
            codes, counts = _reduced(np.concatenate([codes, u]), np.concatenate([counts, c]))
        yield rows()

    return texts.mapInArrow(count, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts 1 to 4 (four numbers)."""
    n = {r["c"]: r["n"] for r in grams.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))  # type: ignore[return-value]


def _off(c: str, d: tuple[float, float, float]) -> Column:
    return F.when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


def _head(table: DataFrame, rows: int) -> int:
    """The least c of which, with all above, there are at most so many rows in the table."""
    upto, least = 0, None
    by = table.groupBy(F.least("c", F.lit(HEAD_ROWS)).alias("c")).agg(F.count("*").alias("n"))  # no more counts than HEAD_ROWS
    for r in by.orderBy(F.desc("c")).collect():
        upto += r["n"]
        if upto > rows:
            break
        least = r["c"]
    return (1 << 62) if least is None else least


def additive(pairs: DataFrame, head_rows: int | None = None) -> tuple[DataFrame, float]:
    """The model of a written table of pair counts (gram, c): a written table gram, c, v, and the log probability of an unknown word.

    A text's log probability is that of as many unknown words, plus the v of each of its words (gram: -1 - word) and pairs that are in the
    table. For each word is the last of one pair and the first of one (the edge, too): what it has as last, by the lower order, and its
    weight of backing off as context are one number, and a pair that is known corrects its two words' sum. c tells what is frequent.
    """
    head_rows = HEAD_ROWS if head_rows is None else head_rows
    d2 = _discounts(pairs)
    each = pairs.withColumn("h", F.shiftright("gram", _WORD_BITS)).withColumn("w", F.col("gram").bitwiseAND(_EDGE_WORD))
    last = each.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("k"))
    first = each.groupBy(F.col("h").alias("word")).agg(F.sum("c").alias("c"), F.sum(_off("c", d2)).alias("off"))
    counts = written(last.join(first, "word"), "word-counts")  # every word is both
    d1 = _discounts(counts.select(F.col("k").alias("c")))
    ones = counts.agg(F.count("*").alias("v"), F.sum("k").alias("t"), F.sum(_off("k", d1)).alias("off")).first()
    total = float(ones["t"] or 1)
    unknown = (ones["off"] / total if ones["v"] else 1.0) / (ones["v"] + 1)
    words = counts.select("word", "c", "off", ((F.col("k") - _off("k", d1)) / F.lit(total) + F.lit(unknown)).alias("p"))
    # (c - d) / total + off / total * p, over what the words alone give, off / total * p
    v = F.log1p((F.col("c") - _off("c", d2)) / (F.col("off") * F.col("p")))
    some = words.where(F.col("c") >= _head(words, min(head_rows, WORD_ROWS)))
    near = each.join(F.broadcast(some.select(F.col("word").alias("h"), "off")), "h", "left").join(F.broadcast(some.select(F.col("word").alias("w"), "p")), "w", "left")
    known = F.col("off").isNotNull() & F.col("p").isNotNull()
    far = near.where(~known).drop("off", "p").join(words.select(F.col("word").alias("h"), "off"), "h").join(words.select(F.col("word").alias("w"), "p"), "w")
    alone = words.select((-1 - F.col("word")).alias("gram"), "c", (F.log("p") - F.lit(float(np.log(unknown))) + F.log(F.col("off") / F.col("c"))).cast("float").alias("v"))
    cols = ("gram", "c", v.cast("float").alias("v"))
    table = written(near.where(known).select(*cols).unionByName(far.select(*cols)).unionByName(alone), "model")
    discard(counts)
    return table, float(np.log(unknown))


def train(texts: DataFrame, head_rows: int | None = None) -> tuple[DataFrame, float]:
    """additive() of a one-column table of trusted texts."""
    pairs = written(pair_counts(texts), "pair-counts")
    model = additive(pairs, head_rows)
    discard(pairs)
    return model


class _Table:
    """long -> float: a hash table of one probe, another one of what lost its slot there, and so on; binary search for what is left."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        for by in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            shift = 64 - max(8, (2 * len(keys)).bit_length())
            slot_key, slot_value = np.full(1 << (64 - shift), -1, np.int64), np.zeros(1 << (64 - shift), np.float32)
            level = np.uint64(by), np.uint64(shift), slot_key, slot_value
            self.levels.append(level)
            at = self._slot(keys, level)
            slot_key[at] = keys
            won = slot_key[at] == keys
            slot_value[at[won]] = values[won]
            keys, values = keys[~won], values[~won]
            if not len(keys):
                break
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def _slot(self, keys: np.ndarray, level: tuple) -> np.ndarray:
        return (keys.astype(np.uint64) * level[0]) >> level[1]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        out, found = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        asked = np.arange(len(keys))
        for level in self.levels:
            mine = keys[asked]
            at = self._slot(mine, level)
            there = level[2][at]
            hit = there == mine
            out[asked[hit]], found[asked[hit]] = level[3][at[hit]], True
            asked = asked[~hit & (there != -1)]  # no key lost to an empty slot
        if len(asked) and len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys[asked]), len(self.keys) - 1)
            hit = self.keys[i] == keys[asked]
            out[asked[hit]], found[asked[hit]] = self.values[i[hit]], True
        return out, found


def _planes(values: np.ndarray) -> bytes:
    """Compressed, after their number: the first bytes of all, then the second ones and so on, as small numbers have the same in most."""
    return len(values).to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), "zstd", asbytes=True)


def _numbers(planes: pa.Buffer, kind: type) -> np.ndarray:
    """What _planes() was given."""
    size = np.dtype(kind).itemsize
    raw = pa.decompress(planes.slice(8), int.from_bytes(planes.slice(0, 8).to_pybytes(), "little") * size, "zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _shard(gram: np.ndarray, shards: int) -> np.ndarray:
    """The pairs of one first word are in up to 32 shards: near each other when sorted, and never all in one."""
    return np.where(gram < 0, gram, gram >> 26) % shards


def _bits(gram: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each gram in a shard's slice of the Bloom filter, and the four bits that it sets there."""
    x = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.zeros(len(x), np.uint64)
    for k in (8, 14, 20, 26):
        bits |= np.uint64(1) << ((x >> np.uint64(k)) & np.uint64(63))
    return (((x >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)).astype(np.int64), bits


_BLOCK = "shard int, kind int, block bigint, a binary, b binary"


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["shard", "kind", "block", "a", "b"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of blocks; a and b as buffers."""
    for batch in batches:
        shard, kind, block = (batch.column(i).to_pylist() for i in range(3))
        for i in range(batch.num_rows):
            a, b = (batch.column(c)[i].as_buffer() for c in (3, 4))
            yield shard[i], kind[i], block[i], a, b


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Blocks are large rows: Python gets some MB of them at a time. Also around what makes the DataFrame."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(16 << 20))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _model_blocks(rest: DataFrame, shards: int, words: int) -> DataFrame:
    """A written table of the rest of the model, one block for each shard, with its slice of the filter as bits."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        gram, v = (np.concatenate([x[i] for x in got]) if got else np.zeros(0) for i in (0, 1))
        if len(gram):
            order = np.argsort(gram)
            gram, v = gram[order], v[order]
            at, bits = _bits(gram, words)
            order = np.argsort(at)
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            slice_ = np.zeros(words, np.uint64)
            slice_[at[order][first]] = np.bitwise_or.reduceat(bits[order], first)
            made = _blocks([(int(_shard(gram[:1], shards)[0]), _MODEL, -1, _planes(np.diff(gram, prepend=0)), _planes(v))])
            yield made.append_column("bits", pa.array([slice_.tobytes()], pa.binary()))

    shard = F.pmod(F.when(F.col("gram") < 0, F.col("gram")).otherwise(F.shiftright("gram", 26)), F.lit(shards)).cast("int")
    parted = rest.select("gram", "v", shard.alias("shard")).repartitionById(shards, "shard").select("gram", "v")
    return written(parted.mapInArrow(pack, f"{_BLOCK}, bits binary"), "model-blocks")


def perplexities(docs: DataFrame, model: tuple[DataFrame, float], text: str = "text", id_: str = "doc_id", lang: str = "lang", head_rows: int | None = None, filter_rows: int | None = None, last: bool = False) -> DataFrame:
    """doc_id, lang, text_hash, log_p, n_grams, perplexity. An empty or null text has one gram, its end; repeated and null ids are scored row by row.

    head_rows and filter_rows decide what is moved, never a score. last: nothing else reads the model, so its table goes. A task holds one shard
    of the table and one block of grams at a time, however often texts have a gram; rows are told apart by their place in the task that reads them.
    """
    head_rows, filter_rows = HEAD_ROWS if head_rows is None else head_rows, FILTER_ROWS if filter_rows is None else filter_rows
    table, unknown = model
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_}`").cast("long").alias("key_"), F.col(f"`{lang}`").cast("string").alias("lang"), body(f"`{text}`").alias("text_"))
    docs = docs.select("key_", "lang", F.xxhash64("text_").alias("hash_"), "text_")
    word = F.col("gram") < 0
    in_head = (word & (F.col("c") >= _head(table.where(word), head_rows))) | (~word & (F.col("c") >= _head(table.where(~word), head_rows)))
    head = table.where(in_head).select("gram", "v").toArrow()
    rest = table.where(~in_head)
    rows = rest.count()
    shards = -(-rows // SHARD_ROWS) | 1  # odd: a word's code is not to repeat in it
    words = min(rows // 8, _FILTER_WORDS) // shards + 1
    with _small_batches(spark):
        parts = _model_blocks(rest, shards, words)
        if last:
            discard(table)
        bloom = None
        if rows <= filter_rows:
            bloom = np.zeros(shards * words, np.uint64)
            for r in parts.select("shard", "bits").collect():
                bloom[r["shard"] * words : (r["shard"] + 1) * words] = np.frombuffer(r["bits"], np.uint64)
        shared = spark.sparkContext.broadcast((head.column("gram").to_numpy(), head.column("v").to_numpy(), bloom))
        rounds, found = ROUNDS if bloom is not None else 2 * ROUNDS, []
        del head, bloom
        for k in range(rounds):
            sent = docs.where(F.pmod("hash_", F.lit(rounds)) == k).mapInArrow(_sent(shared, unknown, shards, words), _BLOCK)
            met = sent.unionByName(parts.drop("bits")).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_met, _BLOCK)
            back = met.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_scored, "doc_id bigint, lang string, text_hash bigint, log_p double, n_grams bigint, perplexity double")
            found.append(written(back, f"perplexities-{k}"))
    shared.destroy()
    discard(parts)
    return reduce(DataFrame.unionByName, found)


def _sent(shared: Broadcast, unknown: float, shards: int, words: int):
    """Of each batch of texts: a block with what the head adds to each, and for each shard blocks of the grams that may be there."""

    def hits(block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, who = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        order = np.argsort(gram)
        gram = gram[order]
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        gram, count = gram[first], np.diff(first, append=len(gram))
        shard = _shard(gram, shards)
        by = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        gram, first, count, shard = gram[by], first[by], count[by], shard[by]
        ends = np.r_[0, np.cumsum(count)]
        who = who[order[np.arange(ends[-1]) + np.repeat(first - ends[:-1], count)]].astype(np.uint32)
        cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows.append((int(shard[a]), _PART, block, _planes(np.diff(gram[a:b], prepend=0)), _planes(np.r_[count[a:b].astype(np.uint32), who[ends[a] : ends[b]]])))
        return _blocks(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, bloom = shared.value
        head = _Table(keys, values)
        for block, batch in enumerate(batches, TaskContext.get().partitionId() << 32):
            rows = batch.num_rows
            total, n = np.zeros(rows), np.zeros(rows, np.int64)
            held, size = [], 0
            for gram, who in word_pairs(batch.column("text_").to_pylist()):
                n += np.bincount(who, minlength=rows)
                for x in (gram, -1 - (gram & _EDGE_WORD)):
                    v, found = head.get(x)
                    total += np.bincount(who, v, rows)
                    left = np.flatnonzero(~found)
                    x, y = x[left], who[left]
                    if bloom is not None:
                        at, bits = _bits(x, words)
                        in_ = bloom[_shard(x, shards) * words + at] & bits == bits
                        x, y = x[in_], y[in_]
                    if len(x):
                        held.append((x, y))
                        size += len(x)
                if size >= HELD_HITS:
                    yield hits(block, held)
                    held, size = [], 0
            if size:
                yield hits(block, held)
            own = pa.RecordBatch.from_arrays([*batch.drop_columns(["text_"]).columns, pa.array(total + n * unknown), pa.array(n)], names=["key_", "lang", "hash_", "s", "n"])
            to = pa.BufferOutputStream()
            with pa.ipc.new_stream(to, own.schema) as stream:
                stream.write_batch(own)
            yield _blocks([(block % shards, _TEXTS, block, to.getvalue().to_pybytes(), None)])

    return send


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The join: blocks of grams become blocks of what each text gets from the shard. Texts pass."""
    here, keys, values = None, None, None
    for shard, kind, block, a, b in _each(batches):
        if kind == _MODEL:
            here, keys, values = shard, np.cumsum(_numbers(a, np.int64)), _numbers(b, np.float32).astype(float)
        elif kind == _TEXTS:
            yield _blocks([(shard, kind, block, a.to_pybytes(), None)])
        elif shard == here:
            gram = np.cumsum(_numbers(a, np.int64))
            count, who = np.split(_numbers(b, np.uint32), [len(gram)])
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            sums = np.bincount(who, np.repeat(np.where(keys[at] == gram, values[at], 0.0), count))
            some = np.flatnonzero(sums)
            if len(some):
                yield _blocks([(shard, kind, block, _planes(some.astype(np.uint32)), _planes(sums[some]))])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the sums of all shards, which come before them."""
    here, more = None, np.zeros(0)
    for _, kind, block, a, b in _each(batches):
        if block != here:
            here, more = block, np.zeros(0)
        if kind == _PART:
            row = _numbers(a, np.uint32)
            if row[-1] >= len(more):
                more = np.r_[more, np.zeros(int(row[-1]) + 1 - len(more))]
            more[row] += _numbers(b, np.float64)
        else:
            own = pa.ipc.open_stream(a).read_next_batch()
            log_p, n = own.column("s").to_numpy().copy(), own.column("n").to_numpy()
            log_p[: len(more)] += more
            yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(log_p), pa.array(n), pa.array(np.exp(-log_p / n))], names=["doc_id", "lang", "text_hash", "log_p", "n_grams", "perplexity"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that were labelled good and not toxic."""
    return labels.where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("trusted_")).distinct()


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, text: str, id_: str, lang: str, head_rows: int | None) -> DataFrame:
    good = written(trusted_ids(labels), "trusted")
    held = lambda h: F.pmod(h, F.lit(HELD_OUT)) == 0
    some = docs.join(if_small(good), F.col(f"`{id_}`") == F.col("trusted_"), "left_semi").select(body(f"`{text}`").alias("text_"))
    model = train(some.where(~held(F.xxhash64("text_"))), head_rows)
    scored = perplexities(docs, model, text, id_, lang, head_rows, last=True)
    own = written(scored.where(held(F.col("text_hash"))).join(if_small(good), F.col("doc_id") == F.col("trusted_"), "left_semi"), "held-out")
    by_lang = written(_fit(own, ["lang"], quantile).where(F.col("docs_") >= OWN_DOCS).withColumnRenamed("lang", "lang_"), "fit-by-language")
    over_all = _fit(own, [], quantile).select(*(F.col(c).alias(f"{c}all_") for c in _FIT))
    out = scored.join(if_small(by_lang), F.col("lang").eqNullSafe(F.col("lang_")), "left").join(F.broadcast(over_all), how="left")
    a, b, c, d, z = (F.when(F.col("docs_").isNotNull(), F.col(x)).otherwise(F.col(f"{x}all_")) for x in _FIT)
    out = out.withColumn("threshold", F.exp(_mean(a, b) + z * _spread(c, d)))
    return out.select("doc_id", "lang", "text_hash", "n_grams", "perplexity", "threshold", (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, text: str = "text", id_: str = "doc_id", lang: str = "lang", head_rows: int | None = None) -> DataFrame:
    """One row per document: doc_id, lang, n_grams, perplexity, threshold, kept.

    The model is trained on the documents that labels has as good and not toxic, all but one in HELD_OUT (by the text, so equal ones are on
    one side). Null texts count as empty; a null language is one of its own. Thresholds come from the held-out ones.
    The surprise per word (log perplexity) of n words has a mean of a + b / n and a variance of c + d / n, both fitted to these; the threshold
    is at the quantile of the deviations in units of that, so that short texts don't raise the bar for long ones. Too few documents to show
    the quantile (n < 1 / (1 - quantile)) give at least Student's for one more document.
    A language of fewer than OWN_DOCS held-out documents takes the fit over all; without any, nothing is rejected. Null ids are scored and never
    trusted; repeated rows are scored alike, and rows of one id each by their own text. labels may hold ids that docs lacks; no rows give no rows.
    """
    return _judged(docs, labels, quantile, text, id_, lang, head_rows).drop("text_hash")


_FIT = ("a_", "b_", "c_", "d_", "z_")


def _mean(a: Column, b: Column) -> Column:
    return a + b / F.col("n_grams")


def _spread(c: Column, d: Column) -> Column:
    return F.sqrt(c + d / F.col("n_grams"))


def _fit(scored: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """docs_ and the numbers of _FIT, by language or in one row; null without documents."""
    y, x = F.log("perplexity"), 1.0 / F.col("n_grams")
    slope = lambda v: F.coalesce(F.regr_slope(v, x), F.lit(0.0))
    rows = scored.withColumn("y_", y)

    def with_(rows: DataFrame, numbers: DataFrame) -> DataFrame:
        if not by:
            return rows.join(F.broadcast(numbers))  # one row
        return rows.join(numbers.select(*(F.col(c).alias(f"{c}_of_") if c in by else F.col(c) for c in numbers.columns)), F.col(by[0]).eqNullSafe(F.col(f"{by[0]}_of_"))).drop(f"{by[0]}_of_")

    means = rows.groupBy(*by).agg(F.count("*").alias("docs_"), slope(F.col("y_")).alias("b_"), F.avg("y_").alias("y0_"), F.avg(x).alias("x0_"))
    means = means.select(*by, "docs_", "b_", (F.col("y0_") - F.col("b_") * F.col("x0_")).alias("a_"))
    rows = with_(rows, means).withColumn("r_", F.pow(F.col("y_") - _mean(F.col("a_"), F.col("b_")), 2))
    # neither part of the variance may be negative: then the other one takes all
    parts = rows.groupBy(*by).agg(slope(F.col("r_")).alias("d_"), F.avg("r_").alias("r0_"), F.avg(x).alias("x0_"))
    c = F.col("r0_") - F.col("d_") * F.col("x0_")
    parts = parts.select(*by, F.when(F.col("d_") < 0, F.col("r0_")).when(c < 0, 0.0).otherwise(c).alias("c_"), F.when(F.col("d_") < 0, 0.0).when(c < 0, F.col("r0_") / F.col("x0_")).otherwise(F.col("d_")).alias("d_"))
    z = F.try_divide(F.col("y_") - _mean(F.col("a_"), F.col("b_")), _spread(F.col("c_"), F.col("d_")))
    tops = with_(rows, parts).groupBy(*by).agg(F.coalesce(F.percentile_approx(z, quantile, 10_000), F.lit(0.0)).alias("q_"))
    out = with_(with_(means, parts), tops)
    n, z = F.col("docs_"), NormalDist().inv_cdf(quantile)
    free = F.greatest(n - 2, F.lit(1))
    few = (z + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free * free)) * F.sqrt((n + 1) / F.greatest(n - 1, F.lit(1)))
    return out.withColumn("z_", F.when(F.col("docs_") * (1 - quantile) < 1, F.greatest("q_", few)).otherwise(F.col("q_"))).select(*by, "docs_", *_FIT)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of docs that classify() keeps, whole. Rows are told apart by id and text: of one id, each row goes or stays by its own text."""
    judged = _judged(docs, labels, QUANTILE, text, id_, lang, None)
    gone = written(judged.where("NOT kept").select(F.col("doc_id").alias("gone_"), F.col("text_hash").alias("gone_hash_")).distinct(), "rejected")
    return docs.join(if_small(gone), F.col(f"`{id_}`").cast("long").eqNullSafe(F.col("gone_")) & (F.xxhash64(body(f"`{text}`")) == F.col("gone_hash_")), "left_anti")
