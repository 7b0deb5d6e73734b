import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sparse_scan import grown, rows

from skeinrank.operators import retrieval
from skeinrank.plans.queries import QUERIES

#: Queries over the gold chunks nearest to each question.
READ_HITS = ("gold_hit", "grounding_gate", "source_context", "retrieval_report")


def conversations(spark, path):
    """Conversations of six turns; returns their bytes."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    said = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choices(words, k=rng.randrange(4, 150)))) for c in range(150) for t in range(6)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return sum(p.stat().st_size for p in (path / "conversations.parquet").glob("*.parquet"))


@pytest.mark.parametrize("name", READ_HITS)
def test_blocks_of_questions_do_not_read_the_conversations_again(spark, tmp_path, monkeypatch, name):
    size, blocks = conversations(spark, tmp_path), retrieval.blocks
    want = rows(QUERIES[name](spark, str(tmp_path)))
    monkeypatch.setattr(retrieval, "blocks", lambda queries: blocks(queries, 8))
    got, wrote = grown(spark, lambda: rows(QUERIES[name](spark, str(tmp_path))))
    assert got == want and got
    assert wrote < 6 * size


def test_the_best_of_many_batches_equal_a_plain_search(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(-3, 4, (30_000, 2)).astype(float)
    v[:3] = [[np.nan, 1], [np.inf, 0], [0, 0]]
    cut = spark.createDataFrame([(i, None, x.tolist()) for i, x in enumerate(v)], "id long, grp string, v array<double>").repartition(1)
    asked = rng.integers(-3, 4, (300, 2)).astype(float)
    queries = spark.createDataFrame([(i, None, x.tolist()) for i, x in enumerate(asked)], "query_id long, grp string, q array<double>")
    got = retrieval.nearest(cut, queries, 5, retrieval._arrays).collect()
    with np.errstate(invalid="ignore"):
        score = v @ asked.T
    score[np.isnan(score) | (score == -np.inf)] = -np.inf
    want = {(q, r): int(i) for q in range(300) for r, i in enumerate(np.lexsort((np.arange(len(v)), -score[:, q]))[:5])}
    assert {(r.query_id, r["rank"]): r.id for r in got} == want


def test_axes_hold_what_vectors_are_made_of(spark):
    from skeinrank.functions.vectors import axes_matrix, hash_axes, hash_matrix

    texts = ["a b a", "", " ", "Ä ß\x1cx", " ".join(map(str, range(500)))]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(hash_axes(384)(F.col("t")).alias("v")).collect()
    assert (axes_matrix([bytes(r.v) for r in made], 384) == hash_matrix(texts, 384)).all()
