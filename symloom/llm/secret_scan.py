"""Secret scans in DataFrame operations only.

Three base kinds by pattern, and two by entropy: candidate strings (long runs of one character class) are passed
over by a window whose character counts are kept incrementally, one in and one out per step (5 bits each, twelve to
a long); the sum of c * log2(c) over the counts follows, and with it the Shannon entropy. Windows that overlap what
is on the allow list are suppressed. Positions are code points: a text splits at its matches, so starts are running
sums of lengths, added up in blocks. All of it takes time in proportion to the text, however long a candidate is and
however many matches there are: what a lambda uses is bound by let(), so that it is computed once, not per element.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the whole run of 16 or more
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Per entropy class: pattern of a candidate, its alphabet, window, least entropy in bits of its best window.
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{24,}", "0123456789abcdef", 24, 3.0),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
}
#: What is no secret however random it looks: placeholders, ordered alphabets, UUIDs, rulers.
ALLOWED = r"(?i)(example|sample|dummy|placeholder|changeme|redacted|0123456789|123456789a|abcdefghij|xxxxxx|(.)\2{7}|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)"
_FOUND = "struct<gaps:array<string>,found:array<string>,ok:array<boolean>>"
_SPANS = "array<struct<s:int,k:int,e:int,m:string>>"
_PER_LONG, _BITS, _BLOCK = 12, 5, 64


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _found(text: Column, pattern: str, ok: Callable[[Column], Column] | None = None, values: int = 0, least: int = 0) -> Column:
    """The text's matches, what lies before each and after the last, and which count: those whose string passes ok, or whose group `values` has `least` signs."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if ok:
        good = F.transform(found, ok)
    elif least:
        good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(values)), lambda v: F.length(v) >= least)
    else:
        good = F.transform(found, lambda m: F.lit(True))
    none = F.struct(F.array(text), F.array().cast("array<string>"), F.array().cast("array<boolean>"))
    return F.when(text.rlike(pattern), F.struct(gaps, found, good).cast(_FOUND)).otherwise(none.cast(_FOUND))


def _blanked(found: Column) -> Column:
    """The text with each match that counts replaced by as many spaces."""

    def part(m: Column, gap: Column, i: Column) -> Column:
        one = F.get(m["found"], i)
        return F.concat(gap, F.when(one.isNull(), "").when(F.get(m["ok"], i), F.repeat(F.lit(" "), F.length(one))).otherwise(one))

    return let(found, lambda m: F.array_join(F.transform(m["gaps"], lambda gap, i: part(m, gap, i)), ""))


def _before(numbers: Column) -> Column:
    """For each whole number of an array the sum of those before it. Arrays grow by one in blocks only, so this isn't quadratic."""
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int"))), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))
    sums = lambda a: F.transform(a, lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v))

    def upto(a: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, zero, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def two(first: Column) -> Column:
        return let(sums(first), lambda s: let(blocks(s), lambda second: F.flatten(F.zip_with(second, upto(sums(second), F.lit(0)), upto))))

    return let(numbers, lambda n: let(blocks(n), lambda first: F.flatten(F.zip_with(first, two(first), upto))))


def _spans(found: Column, kind: int) -> Column:
    """Start, kind, end and string of each match that counts, in order."""

    def all_(m: Column) -> Column:
        lengths = F.transform(m["gaps"], lambda g, i: F.length(g) + F.coalesce(F.length(F.get(m["found"], i)), F.lit(0)))
        return let(_before(lengths), lambda at: F.transform(m["found"], lambda x, i: one(m, at, x, i)))

    def one(m: Column, at: Column, x: Column, i: Column) -> Column:
        return let(F.get(at, i) + F.length(F.get(m["gaps"], i)), lambda s: F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + F.length(x)).alias("e"), F.when(F.get(m["ok"], i), x).alias("m")))

    return let(found, lambda m: F.when(F.size(m["found"]) == 0, F.array().cast(_SPANS)).otherwise(F.filter(all_(m), lambda x: x["m"].isNotNull()).cast(_SPANS)))


def best_entropy(string: Column, alphabet: str, window: int) -> Column:
    """The largest entropy in bits of any window of an ASCII string over the alphabet; null if it is shorter."""
    table = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    f = lambda n: F.get(table, n)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // _PER_LONG)).alias("n"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))
    count = lambda acc, x: F.coalesce(F.get(acc["n"], x["at"]).bitwiseAND(x["mask"]) / x["one"], F.lit(0)).cast("int")
    # of each sign: the long that has its count, one of it there, the bits of its count
    place = lambda c: let(F.instr(F.lit(alphabet), c) - 1, lambda k: let(F.element_at(F.array(*(F.lit(1 << (_BITS * j)).cast("long") for j in range(_PER_LONG))), k % _PER_LONG + 1), lambda one: F.struct(F.floor(k / _PER_LONG).cast("int").alias("at"), one.alias("one"), (one * 31).alias("mask"))))

    def step(signs: Column, acc: Column, i: Column) -> Column:
        out, in_ = F.get(signs, i - window), F.get(signs, i)

        def moved(x: Column) -> Column:
            leaves, same = count(acc, x["out"]), x["out"]["at"].eqNullSafe(x["in"]["at"]) & x["out"]["one"].eqNullSafe(x["in"]["one"])
            comes = count(acc, x["in"]) - F.when(same, 1).otherwise(0)
            total = acc["sum"] - f(leaves) + f(F.greatest(leaves - 1, F.lit(0))) + f(comes + 1) - f(comes)
            counts = F.transform(acc["n"], lambda n, k: n + F.when(k == x["in"]["at"], x["in"]["one"]).otherwise(0) - F.when(k == x["out"]["at"], x["out"]["one"]).otherwise(0))
            return F.struct(counts.alias("n"), total.alias("sum"), F.when(i >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

        return let(F.struct(F.when(i >= window, out).alias("out"), in_.alias("in")), moved)

    size = F.lit(float(window))
    run = lambda signs: F.aggregate(F.sequence(F.lit(0), F.size(signs) - 1), zero, lambda acc, i: step(signs, acc, i), lambda acc: F.log2(size) - acc["least"] / size)
    return F.when(F.length(string) >= window, let(F.transform(F.filter(F.split(string, ""), lambda c: c != ""), place), run))


def _random(kind: str) -> Callable[[Column], Column]:
    """Whether a candidate of a class has a window that is random enough and overlaps nothing on the allow list."""
    _, alphabet, window, least = CLASSES[kind]
    fold = F.lower if kind == "entropy_hex" else lambda x: x
    return lambda m: F.exists(F.split(m, ALLOWED, -1), lambda p: F.coalesce(best_entropy(fold(p), alphabet, window) >= least, F.lit(False)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and secrets (start, kind, end, string of each).

    Base kinds are leftmost and non-overlapping each on its own. Entropy kinds add candidates of what is left of the text when the matches of the
    kinds listed before are blanked, so they overlap no base span: those of which a window is random enough that overlaps nothing on the allow list.
    Null texts count as empty and have no spans; texts of any length are scanned whole, in time in proportion to it; ties don't occur, as spans
    differ in start or kind; repeated rows are repeated; no rows give no rows; other columns play no part.
    """
    rows = docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), body(f"`{text}`").alias("t_"))
    t = F.col("t_")
    rows = rows.select("doc_id", "t_", _found(t, ASSIGN, values=2, least=8).alias("f0_")).select("doc_id", _spans(F.col("f0_"), 0).alias("s0_"), _spans(_found(t, ACCESS), 1).alias("s1_"), _spans(_found(t, HEX), 2).alias("s2_"), _blanked(F.col("f0_")).alias("t_"))
    for pattern in (ACCESS, HEX):
        rows = rows.withColumn("t_", _blanked(_found(t, pattern)))
    spans = ["s0_", "s1_", "s2_"]
    for k, kind in enumerate(CLASSES, len(spans)):
        rows = rows.withColumn(f"f{k}_", _found(t, CLASSES[kind][0], _random(kind)))
        spans.append(f"s{k}_")
        rows = rows.select("doc_id", *spans[:-1], _spans(F.col(f"f{k}_"), k).alias(spans[-1]), _blanked(F.col(f"f{k}_")).alias("t_"))
    # order: start, then kind as listed
    all_ = rows.select("doc_id", *(F.size(c).cast("long").alias(f"n_{k}") for c, k in zip(spans, KINDS[:3])), F.array_sort(F.concat(*spans[:3])).alias("base_"), F.array_sort(F.concat(*spans)).alias("secrets"))
    return all_.select("doc_id", *(f"n_{k}" for k in KINDS[:3]), F.sha2(_joined(F.col("base_")), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), "secrets")
