import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinrank.operators import evaluation, quantiles

POINTS = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("limit", [10, 300, 10**6])
def test_groups_of_any_size_and_ties(spark, limit):
    rng = random.Random(limit)
    rows = [(g, v) for g, n in (("a", 5000), ("b", 700), (None, 900), ("c", 3), ("d", 1)) for v in (rng.choice((rng.gauss(0, 1e6), float(rng.randrange(5)), 7.0, 2.0 ** rng.randrange(-900, 900))) for _ in range(n))]
    rows += [("same", 4.5)] * 2000 + [("two", float(i % 2)) for i in range(1001)] + [("none", None)] * 3 + [("a", None)] * 10
    got = quantiles.percentiles(spark.createDataFrame(rows, "g string, x double").withColumn("v", F.lit("z")), ["g"], "x", POINTS, limit=limit).collect()
    assert sorted({r.g or "" for r in got}) == sorted({g or "" for g, v in rows if v is not None}) and len(got) == 7
    for r in got:
        own = np.array([v for g, v in rows if g == r.g and v is not None])
        for name, p in POINTS.items():
            assert r[name] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12)


def test_ten_million_distinct_values_in_one_group(spark):
    n = 10**7
    rows = spark.range(n, numPartitions=8).select(((F.col("id") * 7_919_317) % n).cast("double").alias("ms"))
    row = quantiles.percentiles(rows, [], "ms", {"p50": 0.5, "p99": 0.99, "p100": 1.0}, limit=50_000).first()
    assert (row.p50, row.p99, row.p100) == ((n - 1) / 2, pytest.approx(0.99 * (n - 1), abs=1e-6), n - 1)


def test_summary_of_large_groups_is_that_of_small_ones(spark):
    log = spark.range(4000).select((F.col("id") % 3).cast("string").alias("stage"), (F.col("id") * 37 % 1013 / 7).alias("ms")).union(spark.createDataFrame([(None, 5.0), (None, 7.0)], "stage string, ms double"))
    one = lambda limit: sorted((tuple(r) for r in evaluation.latency_summary(log, ["stage"], limit=limit).collect()), key=str)
    assert one(20) == one(10**6) and len(one(20)) == 4
    assert quantiles.percentiles(log.limit(0), ["stage"], "ms", POINTS).count() == 0


def test_sample_is_strict_and_shuffled(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100, 2)], "id long, b int")
    got = [r.id for r in evaluation.sample(rows, "b", "id", 10, 1).collect()]
    assert len(got) == 21 and got != sorted(got) and [r.id for r in evaluation.sample(rows, "b", "id", 10, 1).collect()] == got
    with pytest.raises(ValueError, match="2 has 1 of 10"):
        evaluation.sample(rows, "b", "id", 10, 1, strict=True)
