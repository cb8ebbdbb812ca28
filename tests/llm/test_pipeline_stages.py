"""Each stage of the pipeline against a plain-Python version on its own input, and on odd tables."""

import math
import random

import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from symloom.llm import quality_lm
from symloom.llm.pieces import ByteBpe

from .test_operators import WORD, WS, near
from .test_quality_words import fit, plain_model, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, d_ int"

@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """A folder of documents and labels: prose in two languages, junk, copies, near copies, nulls, empty texts, a hot source, extra columns."""
    rng, folder = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    words = {g: ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 6))) for _ in range(50)] for g in ("en", "fr")}
    texts = []
    for _ in range(260):
        g = rng.choice(["en", "en", "fr"])
        texts.append((" ".join(rng.choices(words[g], k=rng.choice([3, 30, 60, 200]))), g))
    texts += [("".join(rng.choices("%$#&*!|QXZ ", k=300)), "en") for _ in range(8)]
    for t, g in rng.sample(texts[:200], 20):
        w = t.split()
        texts.append(("  ".join(w), g))
        w[len(w) // 2] = "changed"
        texts.append((" ".join(w), g))
    texts += [(None, None), ("", "en"), (" \n", None), ("alone", "fr")]
    rows = [(i, t, g, rng.choice(["big"] * 4 + ["b", "c", None]), len(t or ""), "s", 1) for i, (t, g) in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 200)] + [(i, 0, 0) for i in range(260, 264)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def good(rows):
    """The rows that the quality stage keeps."""
    spark_hash = lambda t: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64((t or "").encode(), seed=42).intdigest())
    held = {r["doc_id"] for r in rows if r["doc_id"] < 200 and spark_hash(r["text"]) % quality_lm.HELD_OUT == 0}
    p = plain_model([r["text"] for r in rows if r["doc_id"] < 200 and r["doc_id"] not in held])
    seen = {}
    for r in rows:
        t = tokens(r["text"] or "")
        seen[r["doc_id"]] = len(t) - 1, math.exp(-sum(math.log(p(h, w)) for h, w in zip(t, t[1:])) / (len(t) - 1))
    lang = {r["doc_id"]: r["lang"] for r in rows}
    fits = {g: fit([seen[i] for i in held if lang[i] == g], quality_lm.QUANTILE) for g in set(lang.values()) if sum(lang[i] == g for i in held) >= quality_lm.OWN_DOCS}
    every = fit([seen[i] for i in held], quality_lm.QUANTILE)

    def kept(i):
        n, perplexity = seen[i]
        a, b, c, d, z = fits.get(lang[i], every)
        return math.log(perplexity) <= a + b / n + z * math.sqrt(c + d / n)

    return {i for i in seen if kept(i)}


def test_stages_against_plain_versions(spark, given, tmp_path):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    rows, out = {}, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, given).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        if name != "pack":
            assert docs.columns == out[""].columns
    before = out[""].collect()
    whole = {r["doc_id"]: r for r in before}
    assert all(r == whole[r["doc_id"]] for name in ("quality", "exact", "near") for r in rows[name])

    ids = lambda name: sorted(r["doc_id"] for r in rows[name])
    assert ids("quality") == sorted(good(before))
    assert not set(ids("quality")) & set(range(260, 268)) and len(set(ids("quality")) & set(range(260))) >= 255

    groups = {}
    for r in rows["quality"]:
        groups.setdefault(WS.sub("", r["text"] or ""), []).append((-len(r["text"] or ""), r["doc_id"]))
    assert ids("exact") == sorted(min(g)[1] for g in groups.values())

    order = [r["doc_id"] for r in sorted(rows["exact"], key=lambda r: r["doc_id"])]
    links = near([whole[i]["text"] for i in order])
    assert ids("near") == [i for k, i in enumerate(order) if links[k][2] == k]
    assert len(ids("near")) < len(ids("exact"))

    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows["near"]}
    total, took, taken = {}, {}, dict.fromkeys(size, 0)
    for i, n in size.items():
        total[whole[i]["source"]] = total.get(whole[i]["source"], 0) + n
    for r in rows["mix"]:
        was = whole[r["doc_id"]]
        assert (r["lang"], r["source"], r["size"]) == (was["lang"], was["source"], was["size"]) and (was["text"] or "").startswith(r["text"] or "")
        n = len(WORD.findall(r["text"] or ""))
        assert r["n_chars"] == (was["n_chars"] if n == size[r["doc_id"]] else len(r["text"]))
        taken[r["doc_id"]] += n
        took[r["source"]] = took.get(r["source"], 0) + n
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight, low, high = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(weight[s] * level, 2 * total[s]) for s in names) < 1.5 * sum(total.values()) else (low, level)
    assert all(abs(took.get(s, 0) - min(weight[s] * low, 2 * total[s])) <= 1 for s in names)
    assert all(taken[i] <= 2 * n for i, n in size.items())

    library, want, places = ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), [], {}
    for r in rows["mix"]:
        n = len(library.whole(r["text"] or "")) // 4 + 1
        cuts = [(n - 1) % 1024 + 1] + [1024] * ((n - 1) // 1024)
        want += [(r["doc_id"], k, sum(cuts[:k]), c) for k, c in enumerate(cuts)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows["pack"]) == sorted(want)
    for r in rows["pack"]:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        ends = [0]
        for offset, length in sorted(p):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024
    assert len(places) <= math.ceil(sum(c for *_, c in want) / 1024) + 2

    again = corpus_pipeline.run(spark, given).drop("sequence_id", "offset")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out["pack"].drop("sequence_id", "offset").collect()))


def test_stages_over_odd_tables(spark, given):
    """No rows; only nulls; one row repeated; null ids."""
    for rows in ([], [(None, None, None, None, None, None, None)] * 3, [(5, "one text " * 9, "en", "a", 81, "x", 2)] * 4, [(None, "some words of a text", "fr", None, 20, None, 0), (1, "some words of a text", None, "b", 20, None, 0)]):
        docs = spark.createDataFrame(rows, SCHEMA)
        n = {}
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, given)
            assert name == "pack" or got.columns == docs.columns
            n[name] = len(got.collect())
        assert n["exact"] == min(1, len(rows)) and (n["pack"] == len(rows)) and n["near"] <= len(rows)
