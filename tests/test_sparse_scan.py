import random
import string

import pytest
from pyspark.sql import functions as F

from skeinrank.functions import text as tx
from skeinrank.operators import chunking, retrieval
from skeinrank.operators.sparse_index import SparseIndex
from skeinrank.plans.queries import QUERIES

DOCS = "doc_id long, text string, lang string"
LANGS = ("en", "de", "fr", "es")


def prose(rng, n, words):
    return "".join(rng.choice(words) + rng.choice((" ", " ", " ", ", ", ".\n", " ", "-")) for _ in range(n))


def grown(spark, run):
    """What run returns, and the bytes that its stages have shuffled, spilled or written."""
    sc, jvm = spark._jsc.sc(), spark._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in map(found.apply, range(found.size()))}

    before = max(stages(), default=-1)
    out = run()
    return out, sum(n for i, n in stages().items() if i > before)


def tables(spark, path):
    """Documents with copies, blanks, gaps of any kind and texts beyond a window, and questions of words of theirs; returns the bytes of the documents."""
    rng = random.Random(4)
    words = ["".join(rng.choices(string.ascii_letters + "äÉßΣ", k=rng.randrange(1, 9))) for _ in range(1500)]
    docs = [(i, prose(rng, rng.choice((5, 256, 257, 900, 3000)), words), LANGS[i % 4]) for i in range(400)]
    docs += [(1000 + i, docs[i][1], LANGS[i % 4]) for i in range(60)] + [(2000, None, "en"), (2001, " \t", "de"), (2002, "", None), (2003, "lone", "en")]
    asked = [(i, " ".join(rng.choices(docs[rng.randrange(400)][1].split(), k=6))) for i in range(40)]
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in asked], "item_id long, text string, source string").write.parquet(f"{path}/benchmark.parquet")
    return sum(p.stat().st_size for p in (path / "documents.parquet").glob("*.parquet"))


@pytest.fixture
def made(spark, tmp_path):
    """Tables of a test's own: nothing is kept of them yet."""
    return str(tmp_path), tables(spark, tmp_path)


def questions(spark, path):
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es", "it"))), (F.col("item_id") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{path}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text", lang.alias("lang"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tokens_and_words_are_those_of_the_columns(spark):
    rng = random.Random(5)
    odd = "aB\x1c\x1d\x1f \t\n\x0b\x0c\r\x85\xa0 　​.,;:!?()[]{}\"'-/\\।॥éΣİ😀_"
    texts = ["".join(rng.choices(odd, k=rng.randrange(40))) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lower("t").alias("low"), tx.bm25_tokens(F.col("t")).alias("tokens"), tx.words(F.col("t")).alias("words")).collect()
    assert all(tx.find_tokens(r.low) == r.tokens and tx.split_words(r.t) == r.words for r in got)


def test_windows_are_found_without_shuffling_texts_or_postings(spark, made):
    path, size = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    chunks = chunking.window_chunks(docs, keep=("lang",))
    scores = retrieval.bm25(chunks.select(F.col("id").alias("doc_id"), "text", "lang"), questions(spark, path)).withColumnRenamed("doc_id", "id")
    want = rows(retrieval.best_per_document(scores.join(chunks.select("doc_id", "id"), "id"), 2).join(docs, "doc_id").select("query_id", "doc_id", "id", "score", "rank", F.md5("text")))
    got, wrote = grown(spark, lambda: rows(QUERIES["window_hits_to_parents"](spark, path).select("query_id", "doc_id", "id", "score", "rank", "digest")))
    assert got == want and len(got) > 50
    assert wrote < 2 * size


def test_hybrid_counts_documents_without_shuffling_hits(spark, made, tmp_path):
    path, size = made
    docs, asked = spark.read.parquet(f"{path}/documents.parquet"), questions(spark, path)
    index = SparseIndex(spark, f"file://{tmp_path}/index")
    index.upsert(docs)
    want = rows(retrieval.hybrid(docs, asked, index=index))
    got, wrote = grown(spark, lambda: rows(QUERIES["hybrid_rrf"](spark, path)))
    assert got == want == rows(retrieval.hybrid(docs, asked)) and len(got) == 80
    assert wrote < 2 * size


def test_prompts_fetch_texts_without_shuffling_all(spark, made):
    path, size = made
    got, wrote = grown(spark, lambda: QUERIES["context_prompt"](spark, path).collect())
    assert len(got) == 40 and all("[PASSAGE 2]" in r.prompt for r in got)
    assert wrote < 2 * size


def test_bm25_top_scans(spark, made):
    path, size = made
    want = rows(retrieval.top(retrieval.bm25(spark.read.parquet(f"{path}/documents.parquet"), questions(spark, path)), 20))
    got, wrote = grown(spark, lambda: rows(QUERIES["bm25_top"](spark, path)))
    assert got == want and len(got) > 500
    assert wrote < 2 * size


def test_recall_mrr_scans(spark, made):
    path, size = made
    labels = [(i, int(i % 3 == 0), 0) for i in range(0, 400, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    got, wrote = grown(spark, lambda: QUERIES["recall_mrr"](spark, path).first())
    want: dict[int, int] = {}
    good = {i for i, q, _ in labels if q}
    for q, doc, _, rank in rows(QUERIES["bm25_top"](spark, path)):
        want[q] = min(want.get(q, 99), rank + 1 if doc in good else 99)
    assert got.n == len(want) and got.recall_5 == round(sum(r <= 5 for r in want.values()) / len(want), 4)
    assert got.mrr == pytest.approx(sum(1 / r for r in want.values() if r < 99) / len(want), abs=1e-4)
    assert wrote < 2 * size
