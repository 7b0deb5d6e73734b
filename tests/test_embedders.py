import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinrank.functions.vectors import hash_matrix, unit_rows
from skeinrank.operators import embedders, retrieval

TOPICS = [[f"{chr(97 + t)}word{i}" for i in range(40)] for t in range(8)]


def documents(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.sample(TOPICS[i % 8], 8) + rng.choices(["the", "of", "and"], k=6)), "en") for i in range(n)]


def test_either_tier_serves_dense_search(spark):
    docs = spark.createDataFrame(documents(400, 1), "doc_id long, text string, lang string").repartition(3)
    asked = spark.createDataFrame(documents(80, 2), "query_id long, text string, lang string")
    fitted = embedders.fitted_svd(docs, rank=16)
    embedders.register("svd", fitted)
    share = {}
    for name in ("hash", "svd"):
        got = retrieval.dense_top(docs, asked, 10, embed=embedders.embedder(name)).select((F.col("query_id") % 8 == F.col("doc_id") % 8).cast("int").alias("hit"))
        share[name] = got.agg(F.avg("hit")).first()[0]
    # Documents of a topic share few words with a question of it: directions of the corpus tell topics better than words alone.
    assert share["svd"] > 0.9 and share["svd"] >= share["hash"] - 0.01
    x = fitted.encode([t for _, t, _ in documents(400, 1)])
    full = unit_rows(np.sign(h := hash_matrix([t for _, t, _ in documents(400, 1)], 384)) * np.log1p(np.abs(h))) * fitted.weights
    best = np.linalg.svd(full, compute_uv=False)[:16]
    assert np.allclose(np.linalg.norm(x, axis=0), best)


def test_an_embedder_is_loaded_once_and_names_are_checked(spark):
    class Counting(embedders.Embedder):
        def load(self):
            self.offset = getattr(self, "offset", 0) + 1

        def encode(self, texts):
            return np.array([[self.offset, len(t or "")] for t in texts], float)

    embedders.register("counting", Counting(2))
    rows = spark.range(50, numPartitions=1).select(embedders.vectors("counting", F.lit("abc")).alias("v")).collect()
    assert all(np.allclose(r.v, np.array([1, 3]) / 10**0.5) for r in rows)
    with pytest.raises(KeyError, match="no embedder none"):
        embedders.embedder("none")
    with pytest.raises(TypeError):
        embedders.register("x", object())
