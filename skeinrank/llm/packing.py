"""Packing token ids into sequences of a fixed length by first-fit decreasing.

Every document's ids (with an end id) are cut into pieces of `length`; only a document's last piece, its tail, may be
shorter. Full pieces are sequences of their own, as first-fit decreasing would make them. The documents' tails are dealt
to randomised groups of about `group_rows` documents, and each group is packed on its own: tails by descending length,
each into the first bin with room, found by descending a tournament tree of the bins' free places. A document's group is
drawn by the place of its row, so that repeated rows and rows without an id scatter too. The texts are tokenized where
they are read; only the tails' numbers are shuffled.

Edge cases: a null or empty text is one piece with just the end id; repeated rows are packed each on its own; a very long
text makes many full pieces and one tail; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: What the cutter adds: the place of the document's row, and the sequence of a full piece.
CUT = PIECES + ", place long, sequence_id long"
FULL = 1 << 62


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; the tournament tree's leaves are the bins' free places, its nodes their maxima."""
    width = 1
    while width < len(lengths):
        width *= 2
    tree = [capacity] * (2 * width)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda x: -lengths[x]):
        need, i = lengths[k], 1
        while i < width:
            i *= 2
            if tree[i] < need:
                i += 1
        out[k] = (i - width, capacity - tree[i])
        tree[i] -= need
        while i > 1:
            i //= 2
            best = tree[2 * i] if tree[2 * i] > tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == best:
                break
            tree[i] = best
    return out


def _cutter(tokenizer: str, end_id: int, length: int):
    end = struct.pack("<I", end_id)

    def cut(batches):
        enc, place = encoder(tokenizer), TaskContext.get().partitionId() << 40
        full = FULL | place
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(batch["doc_id"].to_pylist(), enc.encode_all(batch["text"]), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at : at + 4 * length]
                    whole = len(piece) == 4 * length
                    for row, x in zip(rows, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, place, full if whole else None), strict=True):
                        row.append(x)
                    full += whole
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place", "sequence_id"])

    return cut


def _packer(length: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        found = first_fit_decreasing(group["length"].tolist(), length)
        base = int(group["__group"].iloc[0]) << 32
        group["sequence_id"] = [base + b for b, _ in found]
        group["offset"] = [o for _, o in found]
        return group.drop(columns="__group")

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, group_rows: int = 8192) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    core = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = staged(core.mapInArrow(_cutter(tokenizer, end_id, length), CUT), "pieces")
    full = pieces.where("sequence_id is not null").withColumn("offset", F.lit(0).cast("long")).drop("place")
    tails = pieces.where("sequence_id is null").drop("sequence_id")
    groups = max(1, -(-tails.count() // group_rows))
    packed = tails.withColumn("__group", F.pmod(F.xxhash64("place"), F.lit(groups))).drop("place").groupBy("__group").applyInPandas(_packer(length), PACKED)
    return packed.unionByName(full)
