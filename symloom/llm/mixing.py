"""Mixing sources to target weights, in DataFrame operations only, by a multivariate-hypergeometric splitting tree.

Each source's documents fall by hash into blocks of about BLOCK_WORDS words. A source's target becomes whole
passes over its blocks and, for the rest, the first blocks of a hashed permutation, the last of them cut so
that the words come out exactly. These block quotas are parted among the output shards by a tree: at each
node the left half takes its share of the draws without replacement, source by source and by the hypergeometric law, so
the quotas stay exact in every shard and in the whole. Each shard then owns disjoint ranges of the permuted draws, and
documents are shuffled within their shard.

The driver holds one row per source, like the weights themselves; the tree is made level by level on the executors.
Documents are only ever ordered within a block and blocks within a bucket of some thousands, so a source that holds
a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, body, written

WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
#: Words of a block and of an output shard, about; most documents of a block, and blocks that are ordered together, about.
BLOCK_WORDS, SHARD_WORDS, BLOCK_DOCS, BUCKET = 32_768, 4_000_000, 4_096, 4_096
#: Levels of the tree that one task makes before its nodes are spread.
ONE_TASK = 8


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """Shares of share * sum(sizes) by weight; none above most times its size, the excess going to the others by weight. Exact."""
    left, out = share * sum(sizes), [Fraction(0)] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i]]
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if per * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hypergeometric(marked: Column, others: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` without replacement are marked, by inversion of a uniform u of 53 bits.

    The law's weights follow from the mode's by their ratios. Beyond 9 deviations and 40 more they add up to less than u can tell.
    """
    low, high = F.greatest(F.lit(0).cast("long"), drawn - others), F.least(marked, drawn)

    def inverted(p: Column) -> Column:
        k, n, m, o = (p[x].cast("double") for x in ("mode", "drawn", "marked", "others"))
        up = lambda j: (m - k - j + 1) * (n - k - j + 1) / ((k + j) * (o - n + k + j))
        down = lambda j: (k - j + 1) * (o - n + k - j + 1) / ((m - k + j) * (n - k + j))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("hit"))

        def walk(steps: Column, ratio, target: Column) -> Column:
            """After all steps: the weights' sum, and the first step at which it passed the target."""

            def step(acc: Column, j: Column) -> Column:
                return let(F.when(j == 0, F.lit(1.0)).otherwise(acc["w"] * ratio(j.cast("double"))), lambda w: let(acc["sum"] + F.when(j == 0, 0.0).otherwise(w), lambda t: F.struct(w.alias("w"), t.alias("sum"), F.coalesce(acc["hit"], F.when((j > 0) & (t > target), j)).alias("hit"))))

            return F.aggregate(F.sequence(F.lit(0), steps), start, step)

        reach = lambda room: F.least(room, p["reach"]).cast("int")
        ups, downs = reach(p["high"] - p["mode"]), reach(p["mode"] - p["low"])
        never = F.lit(float("inf"))

        def found(q: Column) -> Column:
            target = p["u"] * (1 + q["up"] + q["down"]) - 1
            above = p["mode"] + F.coalesce(walk(ups, up, target)["hit"], ups)
            below = p["mode"] - F.coalesce(walk(downs, down, target - q["up"])["hit"], downs)
            return F.when(target < 0, p["mode"]).when(target < q["up"], above).otherwise(below)

        return let(F.struct(walk(ups, up, never)["sum"].alias("up"), walk(downs, down, never)["sum"].alias("down")), found)

    def ready(p: Column) -> Column:
        m, o, n = (p[x].cast("double") for x in ("marked", "others", "drawn"))
        mode = F.least(p["high"], F.greatest(p["low"], F.floor((n + 1) * (m + 1) / (m + o + 2))))
        dev = F.sqrt(n * (m / (m + o)) * (o / (m + o)) * (m + o - n) / F.greatest(F.lit(1.0), m + o - 1))
        more = F.struct(*(p[x].alias(x) for x in ("marked", "others", "drawn", "low", "high", "u")), mode.cast("long").alias("mode"), (F.ceil(9 * dev) + 40).alias("reach"))
        return F.when(p["low"] >= p["high"], p["low"]).otherwise(let(more, inverted))

    return let(F.struct(marked.alias("marked"), others.alias("others"), drawn.alias("drawn"), low.alias("low"), high.alias("high"), u.alias("u")), ready)


def split_quotas(spark, quotas: list[int], shards: int, seed: int) -> DataFrame:
    """shard, no, first, n: the quota n of each source in each shard, and the sum of those in the shards before. Zero quotas are left out.

    Sums over shards are the quotas; at each node the halves' totals are in the ratio of their leaves, rounded down on the left.
    """
    longs = lambda a: F.array(*(F.lit(int(x)).cast("long") for x in a))
    rows = spark.range(1).select(F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("leaves"), longs(quotas).alias("q"), longs([0] * len(quotas)).alias("first"))

    def left(q: Column, half: Column, leaves: Column, node: Column) -> Column:
        total = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)
        zero = lambda t: F.struct(t.alias("rest"), F.floor(t.cast("decimal(38,0)") * half / leaves).cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("out"))

        def take(acc: Column, i: Column) -> Column:
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, i), 11).cast("double") * F.lit(2.0**-53)
            rest = acc["rest"] - F.get(q, i)
            return let(hypergeometric(F.get(q, i), rest, acc["drawn"], u), lambda got: F.struct(rest.alias("rest"), (acc["drawn"] - got).alias("drawn"), F.concat(acc["out"], F.array(got)).alias("out")))

        return let(total, lambda t: F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), zero(t), take, lambda acc: acc["out"]))

    def one(node: Column, shard: Column, leaves: Column, q: Column, first: Column) -> Column:
        return F.struct(node.alias("node"), shard.alias("shard"), leaves.alias("leaves"), q.alias("q"), first.alias("first"))

    node, shard, leaves, q, first = map(F.col, ("node", "shard", "leaves", "q", "first"))
    half = F.floor(leaves / 2).cast("long")

    def two(a: Column) -> Column:
        return F.array(one(2 * node, shard, half, a, first), one(2 * node + 1, shard + half, leaves - half, F.zip_with(q, a, lambda x, y: x - y), F.zip_with(first, a, lambda x, y: x + y)))

    for level in range((shards - 1).bit_length()):
        if level and level % ONE_TASK == 0:
            rows = rows.repartition("node")
        rows = rows.select(F.explode(F.when(leaves > 1, let(left(q, half, leaves, node), two)).otherwise(F.array(one(node, shard, leaves, q, first)))).alias("x")).select("x.*")
    each = rows.select("shard", F.posexplode(F.arrays_zip("first", "q")).alias("no", "x"))
    return each.select(F.col("shard").cast("int").alias("shard"), "no", F.col("x.first").alias("first"), F.col("x.q").alias("n")).where("n > 0")


def _rows(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mix(docs: DataFrame, carry: list[str] | None = None, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, text: str = "text", id_: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per document: its carried columns (c0_, c1_, ...), doc_id, size, source_size, target, taken, draws.

    size counts words (runs without ASCII white space; null text: 0). Sources in code point order, null last, have the weights 3, 1, 2, repeating, and together
    150 % of all words, none more than twice its own. draws: (pass, shard, words) of each time the mix takes the document; taken is their sum. Only a document at the cut of its
    source is taken in part. A document of no words may be drawn, with 0 words. Repeated rows and null ids are documents of their own. Same rows, same result.
    """
    spark = docs.sparkSession
    carry = carry or []
    words = F.regexp_count(body(f"`{text}`"), F.lit(f"[^{WS}]+")).cast("long")
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}_") for i, c in enumerate(carry)), F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{source}`").alias("source"), words.alias("size"), _hash(seed, F.col(f"`{id_}`"), body(f"`{text}`")).alias("h_"))
    narrow = written(rows.select("doc_id", "source", "size", "h_"), "mix-rows")
    if not carry:
        rows = narrow
    by_source = sorted(narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    if not by_source:
        return rows.drop("h_", "source").withColumn("source_size", F.col("size")).withColumn("target", F.lit(0.0)).withColumn("taken", F.col("size")).withColumn("draws", F.array().cast("array<struct<pass:int,shard:int,words:bigint>>"))
    sizes = [r["size"] for r in by_source]
    goals = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    plan = []
    for i, (r, goal) in enumerate(zip(by_source, goals)):
        goal_words = int(goal + Fraction(1, 2))
        passes, rest = divmod(goal_words, r["size"]) if r["size"] else (0, 0)
        blocks = max(1, -(-r["size"] // block_words), -(-r["n"] // BLOCK_DOCS))
        plan.append({"no": i, "source": r["source"], "source_size": r["size"], "target": float(goal), "passes": int(passes), "rest": int(rest), "blocks": blocks})
    sources = _rows(spark, plan, "no int, source string, source_size bigint, target double, passes int, rest bigint, blocks int")
    in_blocks = lambda r: r.join(F.broadcast(sources), r["source"].eqNullSafe(sources["source"])).drop("source").withColumn("block", F.pmod(_hash(seed + 1, F.col("h_")), F.col("blocks")).cast("int"))
    placed = in_blocks(rows)
    # blocks in permuted order; the rest of the target ends inside one of them. Buckets are ranges of that order
    ring = F.shiftrightunsigned(_hash(seed + 2, F.col("no"), F.col("block")), 11)
    blocks = in_blocks(narrow).groupBy("no", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"), F.first("blocks").alias("blocks"))
    blocks = written(blocks.withColumn("turn", ring).withColumn("bucket", F.floor(F.col("turn") * F.lit(2.0**-53) * F.ceil(F.col("blocks") / BUCKET)).cast("int")), "mix-block-sizes")
    upto = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = blocks.groupBy("no", "bucket").agg(F.sum("words").alias("w_"), F.count("*").alias("n_"))
    buckets = buckets.select("no", "bucket", F.coalesce(F.sum("w_").over(upto), F.lit(0)).alias("w_"), F.coalesce(F.sum("n_").over(upto), F.lit(0)).alias("n_"))
    turn = Window.partitionBy("no", "bucket").orderBy("turn", "block")
    blocks = blocks.withColumn("order", F.row_number().over(turn) - 1).withColumn("before", F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
    blocks = blocks.join(buckets, ["no", "bucket"]).withColumn("order", F.col("order") + F.col("n_")).withColumn("before", F.col("before") + F.col("w_"))
    blocks = blocks.withColumn("cut", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before")))).withColumn("more", F.col("before") < F.col("rest"))
    blocks = written(blocks.select("no", "block", "order", "cut", "more", "passes"), "mix-blocks")
    # quotas in blocks, and the tree's shards for every draw: pass by pass, in the blocks' order
    drawn = {r["no"]: r for r in blocks.groupBy("no").agg(F.count("*").alias("n"), F.count_if("more").alias("some")).collect()}  # one row per source
    quotas = [plan[i]["passes"] * drawn[i]["n"] + drawn[i]["some"] for i in range(len(plan))]
    shards = max(1, -(-sum(int(g) for g in goals) // shard_words))
    shard_of = split_quotas(spark, quotas, shards, seed).select("no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    counts = _rows(spark, [{"no": i, "n": drawn[i]["n"]} for i in drawn], "no int, n bigint")
    per = F.col("passes") + F.col("more").cast("int")
    draws = blocks.where(per > 0).join(F.broadcast(counts), "no").select("no", "block", "order", "cut", "n", F.explode(F.sequence(F.lit(0), per - 1)).alias("pass"))
    draws = draws.withColumn("draw", F.col("pass") * F.col("n") + F.col("order")).join(shard_of, ["no", "draw"])
    of_block = draws.groupBy("no", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("at_"), F.first("cut").alias("cut"))  # three draws at most
    within = Window.partitionBy("no", "block").orderBy("h_", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.withColumn("start_", F.sum("size").over(within) - F.col("size")).join(of_block, ["no", "block"], "left")
    here = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.col("start_")))
    took = F.transform("at_", lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), F.when(x["pass"] < F.col("passes"), F.col("size")).otherwise(here).alias("words")))
    took = F.filter(took, lambda x: (x["words"] > 0) | (F.col("size") == 0))
    out = ordered.withColumn("draws", F.coalesce(took, F.array().cast("array<struct<pass:int,shard:int,words:bigint>>")))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select(*(f"c{i}_" for i in range(len(carry))), "doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed_documents(docs: DataFrame, seed: int = 17, text: str = "text", id_: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: docs' columns, a row for each draw, in shards that are shuffled locally. The text of a document that is taken in part ends after its words taken.

    Documents of no words are drawn as the blocks they lie in. An n_chars column, if there is one, follows a cut text.
    """
    cols = docs.columns
    rows = mix(docs, cols, seed, text=text, id_=id_, source=source)
    each = rows.select(*(f"c{i}_" for i in range(len(cols))), "size", F.explode("draws").alias("d_"))
    at = cols.index(text)
    part = F.col(f"c{at}_")
    pieces = F.regexp_extract_all(part, F.lit(f"[{WS}]*[^{WS}]+"), F.lit(0))
    cut = F.when(F.col("d_.words") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("d_.words").cast("int")), "")).otherwise(part)
    each = each.withColumn(f"c{at}_", cut)
    if "n_chars" in cols:
        k = cols.index("n_chars")
        each = each.withColumn(f"c{k}_", F.when(F.col("d_.words") < F.col("size"), F.length(f"c{at}_").cast("long")).otherwise(F.col(f"c{k}_")))
    shuffled = each.repartition("d_.shard").sortWithinPartitions("d_.shard", _hash(seed + 3, F.col(f"c{cols.index(id_)}_"), F.col("d_.pass")))
    return shuffled.select(*(F.col(f"c{i}_").alias(c) for i, c in enumerate(cols)))
