"""Ids and texts by the sentencepiece library, over a table of distinct chunks.

The library writes a blank as a marker and puts one before the text. Where no piece of a byte-pair model holds a marker
behind another character, nothing is merged across such a place. Cut there, a text falls into chunks, a marked word each (or
several markers and a word), whose ids don't depend on their neighbours. The chunks of the texts of an Arrow batch are encoded as
a dictionary: a table of distinct chunks, each of them segmented once by the library, and codes, by whose position the
ids are joined again. Other models (pieces that cross a marker, pieces that users defined, other segmentation, a
normalizer that changes more than blanks) are told from the model file, and their texts are encoded whole.

Edge cases: a null or empty text has no ids and decodes to an empty text; texts of any length are taken whole, in tables of
at most `chunks` chunks or one text; repeated rows, and rows that share an id or have none, each give their own row; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_CROSSING = re.compile(f"[^{MARK}]{MARK}")
#: Characters that a normalizer would change, among them wide, joined and invisible ones: probes for models that have one.
_PROBES = ("ﬁ 　x", "é é", "a​b c", "Ａ Ⅷ", "a\tb\nc", " a  b ", "\x00\x1f\x7f")


class Pieces:
    """A model of one Python worker."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        self.marker = m.piece_to_id(MARK)
        plain = not any(m.is_unused(i) for i in range(n)) and not any(_CROSSING.search(p) for p in pieces)
        plain = plain and pieces[self.marker] == MARK and any(m.is_byte(i) for i in range(n))
        same = all(m.normalize(t) == MARK + t.replace(" ", MARK) for t in _PROBES)
        #: Whether texts can be cut; what the file doesn't tell is tried on the probes.
        self.cuts = plain and same and all(self.whole(t) == self.joined([t])[0].tolist() for t in (*_PROBES, "the the other there  the\nother", f"a{MARK}b {MARK}"))

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1) if text else []

    def parts(self, text: str) -> list[str]:
        """The chunks of a text, without the first marker of each."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def joined(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, over a table of their distinct chunks."""
        parts = [self.parts(t) for t in texts]
        table = pa.array([c for own in parts for c in own], pa.string()).dictionary_encode()
        chunks = table.dictionary.to_pylist()
        # The library puts the first marker back; it takes an empty text for none.
        ids = [i if c else [self.marker] for c, i in zip(chunks, self.model.encode(chunks, num_threads=1) if chunks else [], strict=True)]
        size = np.array([len(i) for i in ids], np.int64)
        flat = np.array([x for i in ids for x in i], np.int32)
        first = np.cumsum(size) - size
        code = table.indices.to_numpy()
        n = size[code]
        at = np.cumsum(n) - n
        out = flat[np.repeat(first[code] - at, n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, parts)])]
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of this Python worker for a file."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, chunks: int = 500_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids (as the library gives them, no begin or end), and decoded: the library's text of the ids."""

    def rows(ids: list, texts: list[str], model: Pieces) -> pa.RecordBatch:
        codes = model.joined(texts) if model.cuts else [np.array(model.whole(t), np.int32) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
        flat = pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int32), pa.int32())
        decoded = [model.model.decode(c.tolist()) if len(c) else "" for c in codes]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            ids: list = []
            texts: list[str] = []
            held = 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                own = text.as_py() or ""
                n = own.count(" ") + 1
                if ids and held + n > chunks:
                    yield rows(ids, texts, model)
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(own)
                held += n
            if ids:
                yield rows(ids, texts, model)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Per document of `encode`: the number of ids, and digests of the ids and of the decoded text."""
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
