"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases in the words of a text;
a shunting-yard parser evaluates the and/or/with expression after a tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
#: Phrases that count as base places, and what they say.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Longer notices, without "license" alone: phrase, label, weight of the evidence.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.9), "licensed under the apache license version 2 0": ("apache", 1.0),
    "gnu general public license": ("gpl", 0.9), "gnu lesser general public license": ("lgpl", 0.9), "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9), "bsd license": ("bsd", 0.8), "redistribution and use in source and binary forms": ("bsd", 0.9),
    "creative commons attribution": ("cc-by", 0.8), "boost software license": ("bsl", 0.9), "isc license": ("isc", 0.8), "the unlicense": ("unlicense", 0.8),
    "all rights reserved": ("proprietary", 0.4), "released into the public domain": ("public-domain", 0.8),
}
TAG = "spdx license identifier"
#: Every phrase holds one of these words.
_KEYS = ("licens", "hereby", "redistribution", "attribution", "rights", "public")
#: Identifier prefixes (lower case) to labels, longest first.
IDENTIFIERS = [("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("mpl", "mpl"), ("isc", "isc"), ("bsl", "bsl"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("unlicense", "unlicense")]
#: What follows a tag, to the line's end.
_EXPRESSION = re.compile(r"[\x20\t]*:[\x20\t]*([^\n\r]*)", re.ASCII)
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+-]+", re.ASCII)
_RANK = {"or": 1, "and": 2, "with": 3}


def shunting_yard(expression: str) -> list[str] | None:
    """Postfix order of a licence expression (lower case), null if it isn't one. with binds tighter than and, and tighter than or.

    Reads as far as it is an expression: text after a complete one (a comment's end, prose) is left alone.
    """
    out: list[str] = []
    held: list[str] = []
    operand, depth, good = True, 0, None
    for m in _TOKEN.finditer(expression):
        t = m[0]
        if operand and t == "(":
            held.append(t)
            depth += 1
        elif operand and t not in _RANK and t != ")":
            out.append(t)
            operand = False
        elif not operand and t in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        elif not operand and t == ")" and depth:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            break
        if not operand and not depth:
            good = out + [h for h in reversed(held) if h != "("]
    return good


def licence_label(identifier: str) -> str | None:
    for prefix, label in IDENTIFIERS:
        if identifier == prefix or identifier.startswith((prefix + "-", prefix + "+")):
            return label
    return None


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """(labels that the expression names, whether it can be met by known ones): and needs both sides, or either, with changes its left side only."""
    held: list[tuple[set[str], bool]] = []
    for t in postfix:
        if t in _RANK:
            b, a = held.pop(), held.pop()
            held.append(a if t == "with" else (a[0] | b[0], a[1] and b[1] if t == "and" else a[1] or b[1]))
        else:
            label = licence_label(t)
            held.append(({label} if label else set(), label is not None))
    return held[0]


def automaton():
    """Phrases between single spaces; the value is (phrase, number of words)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    a.make_automaton()
    return a


_ready: list = []


def scan(text: str) -> dict:
    """All places of a text: n_words, places (phrase, first word, last+1), expressions (text, labels, met)."""
    if not _ready:
        _ready.append(automaton())
    low = text.translate(_FOLD) if not text.isascii() else text.lower()
    words = _WORD.findall(low)
    found: list[tuple[str, int, int]] = []
    if any(k in low for k in _KEYS):
        line = f" {' '.join(words)} "
        # An automaton match runs from space to space, so neighbours share one; all matches are reported, overlapping ones too.
        at, word = 0, 0
        for end, (phrase, n) in _ready[0].iter(line):
            start = end - len(phrase) - 1
            if start >= at:
                word += line.count(" ", at, start)
                first = word
                at = start
            else:
                first = word - line.count(" ", start, at)
            found.append((phrase, first, first + n))
    expressions = []
    tags = [end for phrase, _, end in found if phrase == TAG]
    if tags:
        ends = [m.end() for m in _WORD.finditer(low)]
        for word in tags:
            m = _EXPRESSION.match(low, ends[word - 1])
            postfix = m and shunting_yard(m[1])
            if postfix:
                expressions.append((m[1], *evaluate(postfix)))
    return {"n_words": len(words), "places": found, "expressions": expressions}


def digest(text: str) -> tuple:
    s = scan(text)
    base = [(p, a) for p, a, _ in s["places"] if p in BASE]
    labels = {BASE[p] for p, _ in base}
    score = 0.6 if base else 0.0
    more = set(labels)
    for p, _, _ in s["places"]:
        if p in NOTICES:
            label, weight = NOTICES[p]
            more.add(label)
            score = max(score, weight)
    for _, named, met in s["expressions"]:
        more |= named
        score = max(score, 1.0 if met else 0.5)
    starts = [a for _, a in base]
    return s["n_words"], len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score, [f"{p}:{a}:{b}" for p, a, b in sorted(s["places"], key=lambda x: (x[1], x[0]))], [e[0] for e in s["expressions"]]


_SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places array<string>, expressions array<string>"


def scan_licenses(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per document: counts, labels and score (0 to 1, the strongest evidence), the places (phrase:first word:end) and tag expressions.

    Null texts count as empty: no words, no labels, score 0. Texts of any length are scanned whole; repeated rows are repeated, null ids kept; no rows
    give no rows; other columns play no part. Of several pieces of evidence that tie, all give their labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
        for batch in batches:
            rows = [digest(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.select(F.col(f"`{id_}`").cast("long").alias("a"), body(f"`{text}`").alias("b")).mapInArrow(run, _SCHEMA)
