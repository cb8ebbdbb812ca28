"""Results as JSON, indented text or MessagePack. Runs on the driver over a result that was cut to its budget."""

from __future__ import annotations

import json
import re
import struct

from pyspark.sql import DataFrame


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def to_json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True)


_PLAIN = re.compile(r"[^\s\"':#\[\]{},&*!|>%@`-][^\n\r\t\"#]*")


def _quoted(text: str) -> str:
    plain = _PLAIN.fullmatch(text) and text == text.strip() and text not in ("true", "false", "null") and ": " not in text and not text.endswith(":")
    if plain:
        try:
            float(text)
        except ValueError:
            return text
    return json.dumps(text, ensure_ascii=False)


def to_text(value, depth: int = 0, step: int = 2) -> str:
    """Nested `key: value` lines, a dash for each list item; texts that could be misread are quoted."""
    pad = " " * (depth * step)
    if isinstance(value, dict):
        lines = []
        for k, v in value.items():
            if isinstance(v, dict | list) and v:
                lines.append(f"{pad}{_quoted(str(k))}:\n{to_text(v, depth + 1, step)}")
            else:
                lines.append(f"{pad}{_quoted(str(k))}: {to_text(v)}")
        return "\n".join(lines) if lines else "{}"
    if isinstance(value, list):
        items = []
        for v in value:
            block = to_text(v, depth + 1, step)
            items.append(f"{pad}- {block.lstrip()}" if isinstance(v, dict | list) and v else f"{pad}- {block}")
        return "\n".join(items) if items else "[]"
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    return _quoted(value) if isinstance(value, str) else str(value)


def to_msgpack(value) -> bytes:
    """The MessagePack encoding of plain values."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128 or -32 <= value < 0:
            return struct.pack("b", value) if value < 0 else bytes([value])
        for code, fmt in ((0xCC, "B"), (0xCD, "H"), (0xCE, "I"), (0xCF, "Q")) if value > 0 else ((0xD0, "b"), (0xD1, "h"), (0xD2, "i"), (0xD3, "q")):
            try:
                return bytes([code]) + struct.pack(">" + fmt, value)
            except struct.error:
                continue
        raise OverflowError(value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        n = len(raw)
        head = bytes([0xA0 | n]) if n < 32 else b"\xd9" + bytes([n]) if n < 256 else b"\xda" + struct.pack(">H", n) if n < 65536 else b"\xdb" + struct.pack(">I", n)
        return head + raw
    if isinstance(value, list | tuple):
        n = len(value)
        head = bytes([0x90 | n]) if n < 16 else b"\xdc" + struct.pack(">H", n) if n < 65536 else b"\xdd" + struct.pack(">I", n)
        return head + b"".join(map(to_msgpack, value))
    n = len(value)
    head = bytes([0x80 | n]) if n < 16 else b"\xde" + struct.pack(">H", n) if n < 65536 else b"\xdf" + struct.pack(">I", n)
    return head + b"".join(to_msgpack(k) + to_msgpack(v) for k, v in value.items())


def tree(rows_: list[dict], children: str = "children") -> dict | None:
    """Tree rows (depth, path, trail) in depth-first order as nested objects."""
    stack: list[dict] = []
    root = None
    for r in rows_:
        node = {"path": r["path"], children: []}
        del stack[r["depth"] :]
        if stack:
            stack[-1][children].append(node)
        else:
            root = node
        stack.append(node)
    return root
