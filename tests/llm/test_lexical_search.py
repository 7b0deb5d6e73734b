import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from skeinrank.llm import lexical_search
from skeinrank.llm.lexical_search import Lexical
from skeinrank.llm.queries import ORACLES, QUERIES

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = "/root/testdata/sf0.001"


def split(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Every item against every document, by the formula."""
    docs = [(d, Counter(split(t))) for d, t in docs if split(t)]
    total, n = sum(c.total() for _, c in docs), len(docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for d, c in docs:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if c[t])
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_query_matches_brute_force_and_sql(spark):
    rows = {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark")}
    got = sorted((tuple(r) for r in QUERIES["op13_dual_tree_search"](spark, SMALL).collect()), key=str)
    docs, items = ([tuple(r) for r in rows[t].select(key, "text").collect()] for t, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == plain(docs, items, 50) and len(got) > 500
    con = duckdb.connect()
    for t in rows:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert got == sorted((r for r in con.execute(f"select item_id, rank, doc_id, score from ({ORACLES['op13_dual_tree_search']})").fetchall()), key=str)


@pytest.mark.parametrize("how", [Lexical(k=3, block=2, slice_rows=8, leaf=2, item_leaf=1, first_share=2), Lexical(k=3), Lexical(k=500)])
def test_odd_rows(spark, how):
    texts = [None, "", "...", "A b C", "a B c", "a a a b", "Ünï cödé 1,000", "ÜNÏ", "x" * 50_000, "c d e " * 30_000, "a\tb\x7fc\xa0d"]
    docs = [(i, t) for i, t in enumerate(texts * 6)] + [(None, "a b c")] * 3 + [(3, "a b"), (3, "a b"), (3, "e")]
    items = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "Ünï, zz"), (5, "c D e f g h"), (None, "b"), (6, "x" * 50_000)]
    made = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, rank int, score string")
    asked = spark.createDataFrame([(d, t, "z") for d, t in items], "item_id long, text string, item string")
    got = lexical_search.search(made, asked, how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, [i for i in items if i[1]], how.k)
    assert lexical_search.search(made.limit(0), asked, how).count() == lexical_search.search(made, asked.limit(0), how).count() == 0


def test_rows_that_share_an_item_id(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    got = lexical_search.search(docs, spark.createDataFrame([(7, "a"), (7, "b")], "item_id long, text string")).collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in got) == [(7, 1, 1), (7, 1, 2)]


def test_bounds_prune_whole_batches_and_lose_nothing():
    rng, how = np.random.default_rng(3), Lexical(k=5, leaf=8, item_leaf=2)
    topic = rng.integers(0, 20, 4000)
    parts = np.zeros((4000, 400), np.int64)
    for i, t in enumerate(topic):
        parts[i, 20 * t + rng.integers(0, 20, 12)] = rng.integers(1, 900_000, 12)
    weights = np.zeros((40, 400), np.int64)
    for i in range(40):
        weights[i, 20 * (i % 20) + rng.integers(0, 20, 6)] = rng.integers(1, 9000, 6)
    search = lexical_search.Search(weights, np.zeros(40), how)
    for at in range(0, 4000, 1000):
        cols = np.flatnonzero(parts[at : at + 1000].any(axis=0))
        search.add(np.arange(at, at + 1000), parts[at : at + 1000][:, cols], cols)
    exact = weights @ parts.T
    for i in range(40):
        best = np.lexsort((np.arange(4000), -exact[i]))[:5]
        assert search.ids[i].tolist() == best.tolist() and search.scores[i].tolist() == exact[i, best].tolist()
    assert search.scored < 0.15 * exact.size and search.pruned > 0


def test_scores_beyond_double_precision():
    search = lexical_search.Search(np.array([[2**40, 2**40 + 1]]), np.zeros(1), Lexical(k=2))
    search.add(np.array([5, 6, 7]), np.array([[900_000, 3], [3, 900_000], [900_000, 4]]), np.array([0, 1]))
    assert search.ids[0].tolist() == [7, 6] and search.scores[0].tolist() == [2**40 * 900_000 + (2**40 + 1) * 4, 2**40 * 3 + (2**40 + 1) * 900_000]
