"""Token ids in binary files: bit-plane shuffling.

A file holds blocks of BLOCK ids. A block is transposed into planes (plane k: bit k, or byte k, of every id) and
each plane is compressed with zstandard on its own: high planes are nearly constant and shrink to nothing.
The file ends in an index: for each block the offset and length of its planes, and for the documents their
ids and lengths. Layout: magic, planes, index (zstandard), index length (8 bytes), magic.

Documents are range-partitioned by id with their texts (the splitters are sampled from the ids), so each task
encodes a contiguous range and writes one file. A file appears under its final name by one rename, so a task
that is run again, or twice, leaves one whole file of the same bytes.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import END_ID, body, fresh_path, local_path
from .pieces import WordBpe, loaded

BLOCK = 1 << 16
MAGIC = b"SLTK0001"


def planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The bit or byte planes of unsigned 32-bit ids, as many as the largest id needs."""
    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [((ids >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8).tobytes() for k in range((bits + 7) // 8)]
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.bool_)).tobytes() for k in range(bits)]


def unplanes(parts: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for k, part in enumerate(parts):
        if kind == "byte":
            ids |= np.frombuffer(part, np.uint8).astype("<u4") << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(np.frombuffer(part, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return ids


class Writer:
    """Appends documents to an open binary file."""

    def __init__(self, out, kind: str = "bit", level: int = 3):
        self.out, self.kind, self.zip = out, kind, zstandard.ZstdCompressor(level)
        self.at, self.blocks, self.docs, self.lengths = len(MAGIC), [], [], []
        self.waiting: list[bytes] = []
        self.n_waiting = 0
        out.write(MAGIC)

    def add(self, doc, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= BLOCK:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        upto = len(ids) if all_ else len(ids) - len(ids) % BLOCK
        for a in range(0, upto, BLOCK):
            block = ids[a : min(a + BLOCK, upto)]
            parts = [self.zip.compress(p) for p in planes(block, self.kind)]
            self.blocks.append([self.at, len(block), [len(p) for p in parts]])
            for p in parts:
                self.out.write(p)
                self.at += len(p)
        self.waiting, self.n_waiting = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        index = self.zip.compress(json.dumps({"kind": self.kind, "blocks": self.blocks, "docs": self.docs, "lengths": self.lengths}).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    """Random access by block, or document after document; `source` is a seekable binary file."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - n)
        self.index = json.loads(self.unzip.decompress(source.read(n)))

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.index["blocks"][i]
        self.source.seek(at)
        raw, parts, a = self.source.read(sum(sizes)), [], 0
        for s in sizes:
            parts.append(self.unzip.decompress(raw[a : a + s]))
            a += s
        return unplanes(parts, n, self.index["kind"])

    def documents(self) -> Iterator[tuple]:
        """(doc, its ids) in the order written; holds one block and one document at a time."""
        i, rest = 0, np.zeros(0, "<u4")
        for doc, n in zip(self.index["docs"], self.index["lengths"]):
            held = [rest]
            have = len(rest)
            while have < n:
                held.append(self.block(i))
                have += len(held[-1])
                i += 1
            ids = np.concatenate(held) if len(held) > 1 else rest
            yield doc, ids[:n]
            rest = ids[n:]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, kind: str = "byte", text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Writes the files and returns their manifest in order: part, file, n_docs, n_tokens. Runs at once.

    Each document is its ids and END_ID; null texts count as empty. Ascending ids, null ids last; rows with one id lie in any order. No rows: no files.
    """
    end = END_ID.to_bytes(4, "little")
    rows = docs.select(F.col(f"`{id_}`").cast("long").alias("id_"), body(f"`{text}`").alias("text_"))
    rows = rows.repartitionByRange(F.col("id_").asc_nulls_last(), F.length("text_")).sortWithinPartitions(F.col("id_").asc_nulls_last())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = loaded(WordBpe, tokenizer), TaskContext.get().partitionId()
        fs, base = local_path(folder)
        fs.create_dir(base, recursive=True)
        name, temp = f"{base}/part-{part:06d}.tok", f"{base}/.part-{part:06d}.{uuid.uuid4().hex}"
        writer, out = None, None
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    out = fs.open_output_stream(temp)
                    writer = Writer(out, kind)
                writer.add(doc, encode(x) + end)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temp, name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([sum(writer.lengths)], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    schema = "part bigint, file string, n_docs bigint, n_tokens bigint"
    manifest = sorted(rows.mapInArrow(write, schema).collect())  # one row per file
    return spark.createDataFrame(manifest, schema)


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files, start = [], 0
    for r in sorted(manifest.collect()):
        files.append((r["file"], start))
        start += r["n_tokens"]
    if not files:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    starts = spark.createDataFrame(files, "file string, start bigint").repartition(len(files))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = local_path(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cols: tuple[list, ...] = ([], [], [], [])
                with fs.open_input_file(name) as f:
                    for doc, ids in Reader(f).documents():
                        for c, v in zip(cols, (doc, at, len(ids), zlib.crc32(ids.tobytes()))):
                            c.append(v)
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files_round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, kind: str = "byte", text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Writes docs to files in a new folder and returns what the files hold, per document."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    return read_token_files(spark, write_token_files(docs, tokenizer, folder, kind, text, id_), folder)
