import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinrank.operators import graph_index, retrieval
from skeinrank.sources.work import written

SCHEMA = "vec_id long, label int, embedding array<float>"


def rows(n, seed, labels=1, dims=48, inner=8):
    """Unit vectors near a plane of few dimensions, in clumps, as embeddings of texts are."""
    rng = np.random.default_rng(seed)
    plane = rng.normal(size=(inner, dims))
    x = (rng.normal(size=(n // 50 + 1, inner))[rng.integers(n // 50 + 1, size=n)] + 0.5 * rng.normal(size=(n, inner))) @ plane + 0.02 * rng.normal(size=(n, dims))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return [(i, i % labels, v) for i, v in enumerate(x.tolist())]


def asked(v, every):
    return v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))


def compared(spark, data, every, k, **how):
    v = written(spark.createDataFrame(data, SCHEMA).repartition(4), "vectors")
    beam = how.pop("beam", 64)
    shards = written(graph_index.build(v, **how), "graph")
    got = graph_index.search(shards, asked(v, every), k, beam, skip_own=True).collect()
    exact = retrieval.neighbours(v, asked(v, every), k).collect()
    return shards, got, exact


def recall(got, exact):
    have = {(r.query_id, r.vec_id) for r in got}
    return sum((r.query_id, r.vec_id) in have for r in exact) / len(exact)


def test_recall_at_under_a_tenth_of_the_distances(spark):
    data = rows(24_000, 3, labels=2)
    _, got, exact = compared(spark, data, 100, 17, degree=12, beam=40)
    assert recall(got, exact) >= 0.95
    taken = {r.query_id: r.distances for r in got}
    assert sum(taken.values()) < 0.1 * len(taken) * 12_000
    score = {(r.query_id, r.vec_id): r.score for r in exact}
    assert all(abs(r.score - score[r.query_id, r.vec_id]) < 2e-9 for r in got if (r.query_id, r.vec_id) in score)
    assert [(r.query_id, r.rank) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(q, i) for q in sorted(taken) for i in range(17)]


def test_shards_are_merged(spark):
    shards, got, exact = compared(spark, rows(3000, 4), 30, 10, shard_rows=500)
    assert shards.count() == 6 and recall(got, exact) >= 0.97


def test_a_full_beam_is_exact_with_copies_and_ties(spark):
    data = rows(240, 5, labels=3, dims=6, inner=3)
    far = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    data += [(1000 + i, 0, far) for i in range(200)] + [(1000, 0, far)] * 5 + [(5000 + i, 1, (np.array(far) + i * 1e-4).tolist()) for i in range(150)]
    for how in ({}, {"shard_rows": 60}):
        _, got, exact = compared(spark, data, 20, 9, degree=3, beam=600, **how)
        pairs = lambda found: sorted((r.query_id, r.rank, round(r.score, 7)) for r in found)
        assert pairs(got) == pairs(exact)
        ids = lambda found: sorted((r.query_id, r.vec_id) for r in found if r.query_id >= 1000 and r.query_id < 5000)
        assert ids(got) == ids(exact)


def test_every_node_can_be_reached():
    rng = np.random.default_rng(8)
    clumps = np.repeat(rng.normal(size=(40, 5)), 60, axis=0) + 1e-6 * rng.normal(size=(2400, 5))
    links = graph_index.graph(clumps, 2)
    found, _, taken = graph_index.walk(clumps, links, clumps[:3], len(clumps))
    assert all(set(f) == set(range(2400)) for f in found) and list(taken) == [2400] * 3


def test_rows_without_a_usable_vector_and_empty_tables(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    data = [(i, 0, v) for i, v in enumerate(bad)] + [(None, 0, [1.0, 1.0]), (20, None, [1.0, 0.5]), (21, 0, [1.0, 0.0]), (22, 1, [0.0, 1.0])]
    shards = graph_index.build(spark.createDataFrame(data, SCHEMA).withColumn("shard", F.lit("x")))
    ask = lambda q: spark.createDataFrame(q, "query_id long, label int, q array<float>")
    got = graph_index.search(shards, ask([(1, 0, [1.0, 1.0]), (2, None, [1.0, 1.0]), (3, 7, [1.0, 1.0]), (4, 0, None)]), 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(1, 0, 21), (2, 0, 20), (2, 1, 21), (2, 2, 22)]
    none = spark.createDataFrame([], SCHEMA)
    assert graph_index.search(graph_index.build(none), ask([(1, 0, [1.0, 1.0])]), 5).count() == 0
    assert graph_index.search(shards, ask([]), 5).count() == 0
    with pytest.raises(ValueError, match="beam"):
        graph_index.search(shards, ask([]), 5, beam=4)
