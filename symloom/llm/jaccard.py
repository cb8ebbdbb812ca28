"""Exact n-gram Jaccard join with adaptive multi-match prefixes, in DataFrame operations only.

1. Documents with the same shingle set form a class; only one of each class goes on, so copies make no pairs.
2. A class's prefix is taken under one global order of shingles: those that stand in more than HOT prefixes
   come last (rarest first), all others by hash. Two sets that overlap in at least t of a set's n shingles share
   at least k of its first n - t + k. So a prefix lengthened by k - 1 shingles demands k shared ones. k is
   chosen per class from the estimated cost of its candidates: the more other prefixes its shingles stand in,
   the longer its prefix and the more matches a pair needs before it is verified (the lesser of its two k).
3. Only the first fifth or so of each set, by hash, is looked at to find what is hot; classes whose fifth is
   mostly hot are taken up again with their whole set, and if even that is hot they go by frequency.
4. Pairs with enough matches are verified on the whole sets.

No shingle outside of prefixes of mostly hot sets is joined in a group of more than HOT, so the pairs that
are looked at grow in proportion to the input, but for real links. Shingles are 64-bit hashes of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, body, if_small, lower_ascii, written

WORDS = 5
#: A shingle in more prefixes than HOT goes to the order's end; one in more than WARM counts in a class's cost.
HOT, WARM = 64, 8
#: A class whose warm shingles promise more join rows than these needs two, or three matches.
COSTS = (64, 256)
_LONGS = "array<bigint>"


def shingles(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_ and tokens_: the sorted, distinct hashes of each text's shingles."""
    words = F.array_remove(F.split(lower_ascii(F.col("t_")), f"[{WS}]+"), "")
    hashed = docs.select(F.col(f"`{id_}`").alias("id_"), body(f"`{text}`").alias("t_")).select("id_", F.transform(words, lambda w: F.xxhash64(w)).alias("w_"))
    at = lambda i, k: F.get("w_", i + F.lit(k))
    runs = F.transform(F.slice("w_", F.lit(1), F.size("w_") - (WORDS - 1)), lambda x, i: F.xxhash64(x, *(at(i, k) for k in range(1, WORDS))))
    tokens = F.when(F.size("w_") == 0, F.array().cast(_LONGS)).when(F.size("w_") < WORDS, F.array(F.xxhash64("w_"))).otherwise(runs)
    return hashed.select("id_", F.sort_array(F.array_distinct(tokens)).alias("tokens_"))


def _whole_sets(docs: DataFrame, classes: DataFrame, text: str, id_: str) -> DataFrame:
    """cid, tokens_ for a written table of (cid, rep)."""
    some = classes.select("cid", F.col("rep").alias("rep_"))
    rows = docs.join(if_small(some), F.col(f"`{id_}`").eqNullSafe(F.col("rep_")), "left_semi")
    found = shingles(rows, text, id_).withColumn("cid", F.xxhash64("tokens_"))
    return found.join(if_small(classes.select("cid")), "cid", "left_semi").groupBy("cid").agg(F.first("tokens_").alias("tokens_"))


def _overlap(n: Column, num: int, den: int) -> Column:
    """The least overlap that a set of n needs: ceil(n * num / den)."""
    return F.floor((n * num + (den - 1)) / den).cast("int")


def _matches(num: int, den: int) -> Column:
    """Shared prefix shingles that a pair needs: its lesser k, and what its two sizes demand.

    Of the set whose prefix ends first in the order, no prefix shingle is among those of the other set that follow its prefix. So the overlap
    is at most the matches and what is left of that set; and it must reach (xn + yn) * num / (num + den).
    """
    rest = lambda p: _overlap(F.col(f"{p}n"), num, den) - F.col(f"{p}k")
    need = F.ceil((F.col("xn") + F.col("yn")) * num / (num + den) - F.lit(1e-9))
    return F.greatest(F.least("xk", "yk").cast("long"), need - F.greatest(rest("x"), rest("y")))


def _prefixes(docs: DataFrame, classes: DataFrame, num: int, den: int, text: str, id_: str) -> DataFrame:
    """cid, n, k, prefix of every class."""
    region = classes.select("cid", F.explode("region").alias("tok"))
    warm = written(region.groupBy("tok").agg(F.count("*").alias("f")).where(F.col("f") > WARM), "warm-shingles")
    marks = region.join(if_small(warm), "tok").groupBy("cid").agg(F.collect_list(F.when(F.col("f") > HOT, F.col("tok"))).alias("hot"), F.sum(F.when(F.col("f") <= HOT, F.col("f") - 1)).alias("cost"))
    cool = F.array_except("region", F.coalesce("hot", F.array().cast(_LONGS)))
    spare = F.col("n") - _overlap(F.col("n"), num, den)
    wish = F.lit(1) + sum((F.coalesce("cost", F.lit(0)) > c).cast("int") for c in COSTS)
    marked = classes.join(marks, "cid", "left").select("cid", "rep", "n", cool.alias("cool"), spare.alias("spare"), wish.alias("wish"))
    marked = marked.withColumn("k", F.least("wish", F.size("cool") - F.col("spare"), F.col("n") - F.col("spare")))
    planned = written(marked.select("cid", "n", "k", "spare", F.when(F.col("k") < 1, F.col("rep")).alias("rep"), F.when(F.col("k") >= 1, F.slice("cool", F.lit(1), F.greatest(F.col("spare") + F.col("k"), F.lit(0)))).alias("prefix")), "prefixes")
    plain = planned.where("k >= 1").select("cid", "n", "k", "prefix")
    heavy = written(planned.where("k < 1").select("cid", "rep", "n", "spare"), "heavy")
    if heavy.isEmpty():
        return plain
    sets = written(_whole_sets(docs, heavy, text, id_).join(heavy.drop("rep"), "cid"), "heavy-sets")
    each = sets.select("cid", F.explode("tokens_").alias("tok"))
    hot = warm.where(F.col("f") > HOT)
    taken = plain.select(F.explode("prefix").alias("tok"))
    more = each.groupBy("tok").agg(F.count("*").alias("f")).where(F.col("f") > HOT).join(hot, "tok", "left_anti").join(taken, "tok", "left_anti")
    all_hot = written(hot.unionByName(more), "hot-shingles")
    own = each.join(if_small(all_hot), "tok").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("own"))
    last = F.transform("own", lambda x: x["tok"])
    rest = F.array_except("tokens_", F.coalesce(last, F.array().cast(_LONGS)))
    ranked = sets.join(own, "cid", "left").withColumn("order", F.concat(rest, F.coalesce(last, F.array().cast(_LONGS))))
    return plain.unionByName(written(ranked.select("cid", "n", F.lit(1).alias("k"), F.slice("order", F.lit(1), F.col("spare") + 1).alias("prefix")), "heavy-prefixes"))


def connected(links: DataFrame) -> DataFrame:
    """cid, label of every end of links (x, y): components by least label, with pointer jumping; each round is a written table."""
    both = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))), "links-both-ways")
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).select(F.col("x").alias("cid"), "label"), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["cid"]).groupBy("x").agg(F.min("label").alias("near"))
        far = labels.select(F.col("cid").alias("label"), F.col("label").alias("far"))
        moved = labels.join(near, labels["cid"] == near["x"], "left").join(far, "label", "left")
        new = written(moved.select("cid", F.least("label", "near", "far").alias("label"), (F.least("label", "near", "far") < F.col("label")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select("cid", "label")
        labels = new.select("cid", "label")


def near_duplicates(docs: DataFrame, num: int = 90, den: int = 100, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id, class_size.

    Two documents link when den * intersection >= num * union of their shingle sets. Texts with fewer than WORDS words have
    one shingle, their whole word sequence; null texts and such without words have none and link with nothing. n_similar counts all other
    linked rows, equal sets included. component_id is the least doc_id in the component, null only if all are. Repeated rows count as
    equal sets; rows are told apart by their sets, so ids may repeat or be null. No rows give no rows.
    """
    n = F.size("tokens_")
    fifth = n - _overlap(n, num, den) + 4 + F.floor(n / 10).cast("int")
    rows = written(shingles(docs, text, id_).select("id_", n.alias("n"), F.xxhash64("tokens_").alias("k1"), F.xxhash64(F.lit(1), "tokens_").alias("k2"), F.slice("tokens_", F.lit(1), fifth).alias("region")), "shingle-rows")
    classes = written(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.count("*").alias("size"), F.min("id_").alias("rep"), F.first("region").alias("region")).withColumnRenamed("k1", "cid"), "classes")
    prefixes = _prefixes(docs, classes.select("cid", "rep", "n", "region"), num, den, text, id_)
    entries = prefixes.select(F.explode("prefix").alias("tok"), "cid", "n", "k")
    a, b = (entries.select("tok", *(F.col(c).alias(p + c) for c in ("cid", "n", "k"))) for p in "xy")
    near = (F.col("xcid") < F.col("ycid")) & (den * F.least("xn", "yn") >= num * F.greatest("xn", "yn"))
    met = a.join(b, "tok").where(near).groupBy("xcid", "ycid").agg(F.count("*").alias("c"), *(F.first(c).alias(c) for c in ("xn", "yn", "xk", "yk")))
    candidates = written(met.where(F.col("c") >= _matches(num, den)).select(F.col("xcid").alias("x"), F.col("ycid").alias("y"), "xn", "yn"), "candidates")
    ends = candidates.select(F.col("x").alias("cid")).unionByName(candidates.select(F.col("y").alias("cid"))).distinct()
    wanted = written(classes.select("cid", "rep").join(ends, "cid", "left_semi"), "candidate-classes")
    sets = written(_whole_sets(docs, wanted, text, id_), "candidate-sets")
    x, y = (sets.select(F.col("cid").alias(c), F.col("tokens_").alias(f"{c}_set")) for c in "xy")
    common = F.size(F.array_intersect("x_set", "y_set"))
    links = written(candidates.join(x, "x").join(y, "y").withColumn("common", common).where(den * F.col("common") >= num * (F.col("xn") + F.col("yn") - F.col("common"))).select("x", "y"), "links")
    small = classes.select("cid", "size", "rep")
    ways = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    others = ways.join(small.select(F.col("cid").alias("y"), "size"), "y").groupBy(F.col("x").alias("cid")).agg(F.sum("size").alias("others"))
    labels = connected(links)
    least = small.join(labels, "cid").groupBy("label").agg(F.min("rep").alias("component"))
    linked = labels.join(least, "label").select("cid", "component")
    result = written(small.join(others, "cid", "left").join(linked, "cid", "left").select("cid", "size", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "rep").alias("component")), "class-results")
    joined = rows.select("id_", "n", F.when(F.col("n") > 0, F.col("k1")).alias("cid")).join(result, "cid", "left")
    return joined.select(
        F.col("id_").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce(F.col("size") - 1 + F.col("others"), F.lit(0)).cast("long").alias("n_similar"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id_")).alias("component_id"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
    )


def drop_near_duplicates(docs: DataFrame, num: int = 90, den: int = 100, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The rows of docs that are their component's least doc_id, whole. Rows with a null id stay."""
    found = near_duplicates(docs, num, den, text, id_)
    dropped = written(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_")).distinct(), "near-dropped")
    return docs.join(if_small(dropped), F.col(f"`{id_}`") == F.col("gone_"), "left_anti")
