import hashlib
import random

import pytest
from sentencepiece import SentencePieceProcessor

from skeinrank.llm import piece_codes

DOCS = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def plain():
    return SentencePieceProcessor(model_file=piece_codes.piece_model_path())


def plain_row(model, doc_id, text):
    ids = model.encode(text or "")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids) if ids else ""))


def test_random_texts_match_the_library(plain):
    rng, model = random.Random(7), piece_codes.pieces(piece_codes.piece_model_path())
    assert model.cuts
    atoms = ["a", "the", "there", "ing", "Zé", "12", "²", "一", "'s", ",", "..", "_", "\n", "\n\n", " ", "  ", "   ", " " * 17, "\t", "\xa0", "　", "\x00", "​", "é", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "▁▁", " ▁", "😀", "\r", "ﬁ", "нет"]
    texts = ["".join(rng.choice(atoms) if rng.random() < 0.8 else " " for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    got = model.joined(texts)
    assert not [t for t, g in zip(texts, got, strict=True) if plain.encode(t) != g.tolist()]


def test_query_matches_the_library(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in piece_codes.digests(piece_codes.encode(docs, piece_codes.piece_model_path())).collect())
    assert got == sorted(plain_row(plain, r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows(spark, plain, empty):
    texts = [None, "", " ", "  ", "a ", " a", "\n", "x" * 30_000, "word  word " * 40_000, "a▁ b", "la la la"]
    rows = [] if empty else [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "q w ", None, None)] * 2 + [(4, "a ", "x", 1), (4, "b", "x", 1)]
    for chunks in (3, 500_000):
        got = piece_codes.digests(piece_codes.encode(spark.createDataFrame(rows, DOCS), piece_codes.piece_model_path(), chunks))
        assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_row(plain, r[0], r[1]) for r in rows), key=str)


def test_models_that_cannot_be_cut_take_texts_whole(plain):
    model = piece_codes.Pieces(piece_codes.piece_model_path())
    model.cuts = False
    assert model.whole("two  words") == plain.encode("two  words")
