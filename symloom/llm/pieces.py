"""Worker-side token caches over the public tokenizers.

A text is cut at places that no merge crosses, each part is looked up, and only parts not met before are encoded.
Caches live as long as the Python worker and have two generations: parts met twice move to the lasting one, so
the many that occur once push nothing out. Both are bounded.
"""

from __future__ import annotations

import re
import sys
from array import array

#: Entries of a cache's two generations: two caches of this size take about 130 MB of a worker.
HOT, COLD = 200_000, 80_000
#: White space as Unicode's White_Space property has it (Python's \s also takes \x1c-\x1f).
_SP = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{_SP}]+|[{_SP}]+(?![^{_SP}])|[{_SP}]+")
#: Letters whose class, case and bytes need no table beyond these; any other sign sends its part through the library whole.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_BYTE_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^ A-Za-z0-9{_LATIN}]+")
_WORD_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")
_PLAIN_CHUNK = re.compile(f" ?[!-~{_LATIN}]+")
_PLAIN_WORD = re.compile(f"[!-~{_LATIN}]+")


def _byte_signs() -> dict[int, str]:
    """Sign -> the signs that stand for its UTF-8 bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {b: chr(b) for b in own}
    sign |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in sign)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


_SIGNS = _byte_signs()


class Cache(dict):
    """part -> value, by make(part) where it isn't there yet."""

    def __init__(self, make, hot: int = HOT, cold: int = COLD):
        super().__init__()
        self.make, self.hot, self.cold, self.young = make, hot, cold, {}

    def __missing__(self, part):
        value = self.young.pop(part, None)
        if value is not None and len(self) < self.hot:
            self[part] = value
            return value
        if value is None:
            value = self.make(part)
        if len(self.young) >= self.cold:
            self.young.clear()
        self.young[part] = value
        return value


def _ids(values: list[int]) -> bytes:
    out = array("I", values)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ByteBpe:
    """text -> ids as little-endian unsigned 32-bit bytes, the same as the tokenizers library gives for a byte-level file with its standard pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = Cache(lambda p: _ids([t.id for t in self.tokenizer.model.tokenize(p.translate(_SIGNS))]))
        self.chunks = Cache(self._chunk)

    def whole(self, text: str) -> bytes:
        return _ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN_CHUNK.fullmatch(chunk):
            return b"".join(map(self.parts.__getitem__, _BYTE_PARTS.findall(chunk)))
        return self.whole(chunk)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))


class WordBpe:
    """The same for a file that lower-cases, drops white space and ends words; words are cut at ASCII white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = Cache(lambda p: _ids([t.id for t in self.tokenizer.model.tokenize(p.translate(_SIGNS))]))
        self.words = Cache(self._word)

    def whole(self, text: str) -> bytes:
        return _ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN_WORD.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, _WORD_PARTS.findall(text.lower())))
        return self.whole(text)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.encode().split()))


class PieceCount:
    """text -> number of sentencepiece ids, for a model without normalisation whose pieces never hold a space mark after another sign."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.counts = Cache(self._part)
        self.frequent = frequent or {}

    def _part(self, part: str) -> int:
        tier1 = self.frequent.get(part)
        if tier1 is not None:
            return tier1
        # The library puts a space mark before what it encodes: it stands for the part's own first space, or is counted off with the line end.
        return len(self.model.encode(part[1:])) if part[0] == " " and len(part) > 1 else 1 if part == " " else len(self.model.encode("\n" + part)) - 2

    def parts(self, text: str) -> list[str]:
        return _PIECE.findall(" " + text.replace("▁", " ")) if text else []

    def __call__(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.parts(text)))


_PIECE = re.compile(" +[^ \n]*|[^ \n]+|\n")
_loaded: dict[tuple, object] = {}


def loaded(kind, path: str, *more):
    """One instance per worker process."""
    key = (kind, path, *(id(m) for m in more))
    if key not in _loaded:
        _loaded[key] = kind(path, *more)
    return _loaded[key]
