import random

import pytest
from pyspark.sql import functions as F

from skeinrank.operators import retrieval
from skeinrank.operators.sparse_index import SparseIndex

DOCS = "doc_id long, text string, lang string"


def made(rng, ids, langs=("en", "de")):
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randrange(1, 40))), rng.choice(langs)) for i in ids]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(9)
    return spark.createDataFrame([(i, t, lang) for i, t, lang in made(rng, range(25), ("en", "de", "fr"))] + [(90, "w0 w0 w59", "en"), (91, "none", "en"), (92, "", "de")], "query_id long, text string, lang string")


def test_upserts_equal_a_fresh_build(spark, tmp_path, asked):
    rng = random.Random(1)
    docs = {d[0]: d for d in made(rng, range(250))}
    index = SparseIndex(spark, f"file://{tmp_path}/kept", block=16, shard=150)
    frame = lambda some: spark.createDataFrame(some, DOCS)
    index.upsert(frame(list(docs.values())))
    for step in range(2):
        changed = made(rng, [*rng.sample(sorted(docs), 40), *range(1000 + 50 * step, 1030 + 50 * step)], ("en", "de", "fr"))
        gone = rng.sample(sorted(docs), 10)
        gone = [g for g in gone if g not in {c[0] for c in changed}]
        docs = {k: v for k, v in docs.items() if k not in gone} | {c[0]: c for c in changed}
        index.upsert(frame(changed), spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    fresh = SparseIndex(spark, f"file://{tmp_path}/fresh")
    fresh.upsert(frame(list(docs.values())))
    assert rows(index._statistics()) == rows(fresh._statistics())
    for a, b in zip(rows(index.corpora()), rows(fresh.corpora()), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])
    want = rows(retrieval.bm25(frame(list(docs.values())), asked))
    assert rows(index.scores(asked)) == rows(fresh.scores(asked)) == want and len(want) > 500
    best = rows(retrieval.top(retrieval.bm25(frame(list(docs.values())), asked), 5))
    got, counts = index.search(asked, 5, first=1)
    assert rows(got) == best
    # A lost attempt at an upsert leaves files without a commit.
    index._write(frame(made(rng, range(50))).select("doc_id", F.lit("en").alias("corpus"), F.lit(1).cast("long").alias("dl"), F.array().cast("array<struct<term:string,tf:int>>").alias("terms")), "forward", 99)
    assert rows(index.scores(asked)) == want


def test_blocks_that_cannot_enter_are_skipped(spark, tmp_path):
    rng = random.Random(2)
    # Documents of a length speak of the same: blocks differ in what they can score.
    docs = [(i, " ".join([f"t{i // 100}x{rng.randrange(30)}" for _ in range(5 + i // 100)] + ["the"] * rng.randrange(3)), "en") for i in range(3000)]
    index = SparseIndex(spark, f"file://{tmp_path}/i", block=50)
    index.upsert(spark.createDataFrame(docs, DOCS))
    asked = spark.createDataFrame([(q, f"the t{q}x1 t{q}x2 t{q + 1}x3", "en") for q in range(20)], "query_id long, text string, lang string")
    got, counts = index.search(asked, 10, first=2)
    assert rows(got) == rows(retrieval.top(retrieval.bm25(spark.createDataFrame(docs, DOCS), asked), 10))
    total = counts.agg(F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored")).first()
    assert total.blocks > 1000 and total.scored < 0.2 * total.blocks


def test_an_index_of_nothing(spark, tmp_path, asked):
    index = SparseIndex(spark, f"file://{tmp_path}/none")
    assert index.scores(asked).count() == 0
    index.upsert(spark.createDataFrame([], DOCS))
    assert index.search(asked, 3)[0].count() == 0
    index.upsert(spark.createDataFrame([(1, "", "en"), (2, None, None), (3, "w1", None)], DOCS))
    assert rows(index.scores(asked)) == rows(retrieval.bm25(spark.createDataFrame([(1, "", "en"), (2, None, None), (3, "w1", None)], DOCS), asked))
