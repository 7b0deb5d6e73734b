"""Token-id files with directly addressable codes.

A shard holds the ids of consecutive documents. Every id is split into chunks of eight bits: level 0 has the lowest
chunk of each id and a bitmap of those that go on, level 1 the next chunk of these, and so on. Each bitmap has a rank
directory (ones before each block of 512 bits), so that the id at any place is read by one look-up per level, and the
ids of a document by one slice per level, without decoding what stands before.

Files are written by Spark's own committed writers and read by its binary reader, so they may lie in any store Spark
can reach; a file has at most `file_shards` shards, so that none outgrows one row of that reader. Layout of a shard, little-endian: magic, length, partition, documents, ids, ids of the partition before it,
levels (unsigned 64-bit each after the 8-byte magic), a null flag per document, document ids (signed 64-bit), document
starts (unsigned 64-bit, one more than documents), then per level its count, chunks, bitmap and directory. A file holds
shards, each followed by one line feed.

Edge cases: a null or empty text is just the end id; null doc_ids come first; rows that share a doc_id are ordered by
their text; an empty table makes no shard and no rows; other columns, whatever their names, are ignored; a text is never
cut between shards, so that a very long one makes a long shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, fresh_path, staged
from .tokens import encoder

MAGIC = b"DACODES1"
HEAD = struct.Struct("<8s6Q")
BLOCK = 512
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: chunks (uint8), bitmap (packed, little bit order) of ids that go on, rank directory (uint32)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks, above = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = above > 0
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        directory = np.concatenate([np.zeros(1, np.uint32), np.cumsum(blocks, dtype=np.uint32)])
        levels.append((chunks, bitmap, directory))
        if not more.any():
            return levels
        rest = above[more]


def write_shard(partition: int, before: int, doc_ids: list[int | None], parts: list[bytes]) -> bytes:
    """The bytes of a shard; parts: each document's ids as little-endian unsigned 32-bit bytes."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])]).astype("<u8")
    levels = encode_levels(ids)
    body = [bytes(x is None for x in doc_ids), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), starts.tobytes()]
    for chunks, bitmap, directory in levels:
        body += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), directory.astype("<u4").tobytes()]
    rest = b"".join(body)
    return HEAD.pack(MAGIC, HEAD.size + len(rest), partition, len(doc_ids), len(ids), before, len(levels)) + rest


class Shard:
    """Random access to the ids of a shard."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.size, self.partition, self.n_docs, self.n_ids, self.before, n_levels = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        self._at, self._data = at + HEAD.size, data
        null = self._take("u1", self.n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(self._take("<i8", self.n_docs), null, strict=True)]
        self.starts = self._take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take("<u8", 1)[0])
            self.levels.append((self._take("u1", n), self._take("u1", -(-n // 8)), self._take("<u4", -(-n // BLOCK) + 1)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def _rank(self, level: int, i: int) -> int:
        """Ids of the level before place i that go on."""
        _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        whole = bitmap[block * (BLOCK // 8) : i // 8]
        rest = int(bitmap[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(directory[block]) + int(_ONES[whole].sum()) + int(_ONES[rest])

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b (exclusive)."""
        out, places = np.zeros(b - a, np.uint32), np.arange(b - a)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            out[places] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            places, a, b = places[bits], self._rank(level, a), self._rank(level, b)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def shards(data: bytes) -> Iterator[Shard]:
    at = 0
    while at < len(data):
        yield (shard := Shard(data, at))
        at += shard.size + 1


def _writer(tokenizer: str, end_id: int, shard_ids: int):
    end = struct.pack("<I", end_id)

    def write(batches):
        enc, partition = encoder(tokenizer), TaskContext.get().partitionId()
        docs, parts, held, before = [], [], 0, 0
        for batch in batches:
            for doc, ids in zip(batch["doc_id"].to_pylist(), enc.encode_all(batch["text"]), strict=True):
                docs.append(doc)
                parts.append(ids + end)
                held += len(parts[-1]) // 4
                if held >= shard_ids:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([write_shard(partition, before, docs, parts)], pa.binary())})
                    docs, parts, held, before = [], [], 0, before + held
        if docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([write_shard(partition, before, docs, parts)], pa.binary())})

    return write


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = 1_000_000, file_shards: int = 64) -> None:
    """Writes the ids of every text of docs, each followed by end_id, under path, in ascending doc_id order."""
    core = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ordered = core.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    made = ordered.mapInArrow(_writer(tokenizer, end_id, shard_ids), "shard binary").select(F.col("shard").cast("string").alias("value"))
    made.write.option("compression", "none").option("maxRecordsPerFile", file_shards).text(path)


def _reader(batches):
    names = ("doc_id", "part", "local_start", "n_tokens", "ids_crc32")
    for batch in batches:
        for content in batch["content"]:
            for shard in shards(content.as_py()):
                ids, ends = memoryview(shard.slice(0, shard.n_ids).astype("<u4")).cast("B"), (4 * shard.starts).tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                rows = [shard.doc_ids, np.full(shard.n_docs, shard.partition), shard.before + shard.starts[:-1], np.diff(shard.starts), crc]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=list(names))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files under path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = staged(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_reader, "doc_id long, part long, local_start long, n_tokens long, ids_crc32 long"), "token-index")
    per = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    base = per.select(F.col("part").alias("p_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p_base"))
    return attach(rows, base, {"part": "p_part"}, ["doc_id", "local_start"]).select("doc_id", (F.col("p_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = 1_000_000) -> DataFrame:
    """Writes the files of docs to the shared folder and returns what read_index finds in them."""
    path = fresh_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id, shard_ids)
    return read_index(docs.sparkSession, path)
