"""The word model of op1 against a plain-Python one, its ways of scoring against each other, and what it rejects."""

import math
import random
import re
import statistics
from collections import Counter

import pytest

from symloom.llm import quality_lm

EDGE = "\U0010ffff"


def tokens(text):
    return [EDGE, *re.findall(r"\w+|[^\w\s]", text), EDGE]


def plain_model(texts):
    """Interpolated modified Kneser-Ney over word pairs, from strings: (last, word) -> probability."""
    pairs = Counter(p for t in texts for p in zip(tokens(t), tokens(t)[1:]))
    ones = Counter(w for _, w in pairs)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if not (n[0] and n[1] and n[2]):
            return 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]))]

    d1, d2 = discounts(ones), discounts(pairs)
    total = sum(ones.values())
    unknown = sum(d1[min(c, 3) - 1] for c in ones.values()) / total / (len(ones) + 1)
    first = lambda w: (ones[w] - d1[min(ones[w], 3) - 1] if w in ones else 0) / total + unknown

    def p(h, w):
        mine = {k: c for k, c in pairs.items() if k[0] == h}
        if not mine:
            return first(w)
        n = sum(mine.values())
        c = pairs.get((h, w), 0)
        return (c - d2[min(c, 3) - 1] if c else 0) / n + sum(d2[min(x, 3) - 1] for x in mine.values()) / n * first(w)

    return p


def line(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    over = sum((p - mx) ** 2 for p in x)
    b = sum((p - mx) * (q - my) for p, q in zip(x, y)) / over if over else 0.0
    return my - b * mx, b


def fit(pairs, quantile):
    """a, b, c, d, z of (number of grams, perplexity) pairs: enough of them to show the quantile, or Student's for one more."""
    x, y = [1 / n for n, _ in pairs], [math.log(p) for _, p in pairs]
    a, b = line(x, y)
    r2 = [(q - a - b * p) ** 2 for p, q in zip(x, y)]
    c, d = line(x, r2)
    if d < 0:
        c, d = sum(r2) / len(r2), 0.0
    elif c < 0:
        c, d = 0.0, sum(r2) / sum(x)
    z = sorted((q - a - b * p) / math.sqrt(c + d * p) for p, q in zip(x, y))
    top, n = z[math.ceil(quantile * len(z) - 1e-9) - 1], len(z)
    if n * (1 - quantile) < 1:
        t, free = statistics.NormalDist().inv_cdf(quantile), max(n - 2, 1)
        top = max(top, (t + (t**3 + t) / (4 * free) + (5 * t**5 + 16 * t**3 + 3 * t) / (96 * free**2)) * math.sqrt((n + 1) / max(n - 1, 1)))
    return a, b, c, d, top


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 5))) for _ in range(60)] + ["naïve", "中文", "don't"]
    return [" ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(1, 60))) for _ in range(40)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")


def test_perplexity_is_that_of_a_plain_model(spark, texts):
    given = [t for t in texts if "中" not in t]
    asked = [*given[25:], "none of these were seen", ""]
    p = plain_model(given[:25])
    want = {i: sum(math.log(p(h, w)) for h, w in zip(tokens(t), tokens(t)[1:])) for i, t in enumerate(asked)}
    for head, bloom in ((10**6, 10**6), (0, 0), (20, 10**6), (20, 0)):  # all looked up in place, all joined, and both
        model = quality_lm.train(frame(spark, given[:25]).select("text"), head)
        got = {r["doc_id"]: r for r in quality_lm.perplexities(frame(spark, asked), model, head_rows=head, filter_rows=bloom).collect()}
        assert {i: r["log_p"] for i, r in got.items()} == pytest.approx(want, rel=1e-5)
        assert {i: r["n_grams"] for i, r in got.items()} == {i: len(tokens(t)) - 1 for i, t in enumerate(asked)}


def test_rows_stay_apart(spark, texts):
    """Repeated rows, null ids and null languages are scored row by row, with the same scores however rows lie."""
    model = quality_lm.train(frame(spark, texts[:25]).select("text"), 20)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[3], "en"), (3, texts[5], "en"), (None, texts[4], "en"), (None, texts[5], None), (7, None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    key = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["lang"] is None, r["lang"] or "", r["n_grams"], round(r["log_p"], 3)) for r in df.collect())
    first, again = (key(quality_lm.perplexities(docs.repartition(n), model, head_rows=20)) for n in (1, 4))
    assert first == again and len(first) == len(rows)
    plain = {t: round(r["log_p"], 3) for t, r in zip(texts, sorted(quality_lm.perplexities(frame(spark, texts), model).collect(), key=lambda r: r["doc_id"]))}
    assert all((False, 3, False, "en", len(tokens(t)) - 1, plain[t]) in first for t in (texts[3], texts[5]))


def test_texts_are_read_at_most_twice_to_be_scored(spark, texts):
    """A pass for the head and one for each third of the other grams, each splitting all texts again, took most of the time."""
    model = quality_lm.train(frame(spark, texts[:25]).select("text"), 20)
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    asked = frame(spark, texts)
    assert quality_lm.perplexities(asked.mapInArrow(counted, asked.schema), model, head_rows=20).count() == len(texts)
    assert rows.value <= 2 * len(texts)


def test_a_batch_is_split_once_and_sent_as_a_block_per_shard(monkeypatch, texts):
    import pyarrow as pa

    asked, whole = [], quality_lm.word_pairs
    monkeypatch.setattr(quality_lm, "word_pairs", lambda t: asked.append(t) or whole(t))
    monkeypatch.setattr(quality_lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["en"] * n), pa.array(range(n)), pa.array(texts)], names=["key_", "lang", "hash_", "text_"])
    none = type("B", (), {"value": (quality_lm.np.zeros(0, int), quality_lm.np.zeros(0), None)})
    sent = [r for b in quality_lm._sent(none, -9.0, 5, 1)([batch]) for r in b.to_pylist()]
    assert len(asked) == 1 and sorted(r["shard"] for r in sent if r["kind"] == quality_lm._PART) == list(range(5))
    assert [r["block"] for r in sent] == [3 << 32] * 6 and sent[-1]["kind"] == quality_lm._TEXTS


def test_shards_blocks_and_parts_change_no_score(spark, monkeypatch, texts):
    asked = [*texts, texts[3] * 5, "none of these were seen", ""]
    model = quality_lm.train(frame(spark, texts[:25]).select("text"), 20)
    scores = lambda **k: {r["doc_id"]: r["log_p"] for r in quality_lm.perplexities(frame(spark, asked).repartition(3), model, **k).collect()}
    want = scores(head_rows=10**6)
    monkeypatch.setattr(quality_lm, "SHARD_ROWS", 40)
    monkeypatch.setattr(quality_lm, "HELD_HITS", 50)
    monkeypatch.setattr(quality_lm, "GATHERED", 200)
    monkeypatch.setattr(quality_lm, "ROUNDS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for bloom in (10**6, 0):
            assert scores(head_rows=20, filter_rows=bloom) == pytest.approx(want, rel=1e-6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_table_finds_what_lost_its_slot(texts):
    keys = quality_lm.np.unique(quality_lm.np.concatenate([g for g, _ in quality_lm.word_pairs(texts)]))
    table = quality_lm._Table(keys[::2], quality_lm.np.arange(len(keys[::2])) / 8)
    values, found = table.get(keys)
    assert found.tolist() == [i % 2 == 0 for i in range(len(keys))] and values[::2].tolist() == [i / 8 for i in range(len(keys[::2]))]
    assert not values[1::2].any() and len(table.levels) > 1


def test_rows_of_one_id_go_or_stay_by_their_own_text(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 5))) for _ in range(40)]
    good = [" ".join(rng.choices(words, k=80)) for _ in range(60)]
    junk = "".join(rng.choices("%$#&*!|QXZ ", k=400))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good)] + [(70, junk, "en"), (70, good[0], "en"), (None, junk, None), (None, good[1], None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    kept = quality_lm.keep_good(docs, labels).collect()
    assert all(r["text"] != junk for r in kept)
    assert {(r["doc_id"], r["text"]) for r in kept} >= {(70, good[0]), (None, good[1])}


def test_held_out_documents_set_the_thresholds_of_their_language(spark):
    """The thresholds, from the perplexities alone in plain Python."""
    rng = random.Random(12)
    words = {g: ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 5))) for _ in range(60)] for g in ("en", "fr", None)}
    rows = [(i, " ".join(rng.choices(words[g], k=rng.randint(5, 90))), g) for i, g in enumerate(rng.choices(["en", "fr", None], [6, 5, 1], k=700))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id bigint, quality int, toxic int")
    judged = quality_lm._judged(docs, labels, 0.9, "text", "doc_id", "lang", None).collect()
    held = [r for r in judged if r["text_hash"] % quality_lm.HELD_OUT == 0 and r["doc_id"] < 600]
    pairs = lambda rows: [(r["n_grams"], r["perplexity"]) for r in rows]
    fits = {g: fit(pairs(r for r in held if r["lang"] == g), 0.9) for g in ("en", "fr") if sum(r["lang"] == g for r in held) >= quality_lm.OWN_DOCS}
    assert set(fits) == {"en", "fr"}
    every = fit(pairs(held), 0.9)
    for r in judged:
        a, b, c, d, z = fits.get(r["lang"], every)
        assert r["threshold"] == pytest.approx(math.exp(a + b / r["n_grams"] + z * math.sqrt(c + d / r["n_grams"])), rel=1e-6)
        assert r["kept"] == (r["perplexity"] <= r["threshold"])


def test_long_texts_are_cut_between_words(monkeypatch, texts):
    long = " ".join(texts)
    whole = [g.tolist() for g, _ in quality_lm.word_pairs([long])]
    monkeypatch.setattr(quality_lm, "CHUNK", 50)
    cut = [x for g, _ in quality_lm.word_pairs([long]) for x in g.tolist()]
    assert len(whole) == 1 and cut == whole[0]


def test_shuffled_words_are_rejected(spark):
    """Junk of valid words: each word is known, their order isn't."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeilnorst", k=rng.randint(3, 6))) for _ in range(80)]
    after = {w: rng.sample(words, 3) for w in words}

    def prose():
        out = [rng.choice(words)]
        while len(out) < 120:
            out.append(rng.choice(after[out[-1]]))
        return out

    texts = [" ".join(prose()) for _ in range(80)]
    junk = [" ".join(rng.sample(p, len(p))) for p in (prose() for _ in range(8))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_lm.classify(frame(spark, texts + junk), labels).collect()}
    assert sum(got[i] for i in range(80)) >= 78 and not any(got[i] for i in range(80, 88))


def test_short_texts_do_not_raise_the_bar_for_long_ones(spark):
    """Trusted texts of one or two odd words are of high perplexity; long junk of less than theirs is rejected all the same."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeilnorst", k=rng.randint(3, 6))) for _ in range(60)]
    long = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
    short = ["".join(rng.choices("uvwxyz", k=7)) + "." for _ in range(20)]
    junk = [" ".join("".join(rng.choices("fghjkmpq", k=6)) if rng.random() < 0.2 else rng.choice(words) for _ in range(200)) for _ in range(6)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_lm.classify(frame(spark, long + short + junk), labels).collect()}
    assert all(got[i]["kept"] for i in range(80)) and not any(got[i]["kept"] for i in range(80, 86))
    assert max(got[i]["threshold"] for i in range(60)) < min(got[i]["threshold"] for i in range(60, 80))
