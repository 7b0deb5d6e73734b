import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinrank.llm import periodic

DOCS = "doc_id long, text string, runs string, collapsed int, __words string"


def plain_runs(words, least=12):
    """Every run, by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)  # the smallest period comes first
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def together(texts, **how):
    """runs_of over several sequences of numbers at once, as lists per sequence."""
    texts = sorted(texts, key=len)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    seq = np.concatenate([[*t, 10**6 + i] for i, t in enumerate(texts)]).astype(np.int64)
    rows = periodic.runs_of(seq, starts, **how).tolist()
    return texts, [[(s - a, e - s, q) for s, e, q in rows if a <= s < a + n] for a, n in zip(starts, sizes, strict=True)]


@pytest.mark.parametrize("shortest", [4, 8, 32])
def test_all_runs_of_awkward_sequences(shortest):
    rng = random.Random(shortest)
    texts = [[rng.randrange(k) for _ in range(rng.randrange(220))] for k in (1, 2, 2, 3, 5) for _ in range(40)]
    # Squares whose halves are periodic themselves, with one break between them; words of Fibonacci and of Thue and Morse.
    for k in range(2, 40):
        texts += [[0, 1] * k + [0, 0] + [1, 0] * k, [1, *[0, 1] * k, 0, 0, *[1, 0] * k, 1, 1], [0, 0, 1] * k + [0] + [0, 0, 1] * (k + 3) + [1] + [0, 0, 1] * k]
    fib, other = [0, 1], [0]
    while len(fib) < 400:
        fib, other = fib + other, fib
    texts += [fib, [bin(i).count("1") % 2 for i in range(400)], [0] * 300, ([0] * 40 + [1]) * 6, ([0] * 40 + [1] + [0] * 39 + [2]) * 3]
    for _ in range(120):  # a period of any length, with a few words changed
        p = rng.randrange(1, 90)
        block = [rng.randrange(rng.choice((2, 4, 1000))) for _ in range(p)]
        t = [rng.randrange(1000) for _ in range(rng.randrange(30))] + [block[i % p] for i in range(rng.randrange(2 * p, 5 * p + 2))]
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.randrange(3)
        texts.append(t)
    texts, got = together(texts, shortest=shortest)
    assert got == [plain_runs(t) for t in texts]
    assert sum(map(len, got)) > 500


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 20000")
    rows = docs.select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in periodic.digests(periodic.find(periodic.planted(docs))).collect())
    assert got == sorted(plain_row(*r) for r in rows) and sum(r[1] > 0 for r in got) > 5


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows(spark, empty):
    texts = [None, "", " \n\t ", "a", "la " * 12, "la " * 11, "x\xa0y " * 30, "é\nü\tz " * 20, "a b c " * 4, "a b c " * 4 + "a b", "word\x0bword\x0c" * 40]
    rows = [] if empty else [(i, t, "x", 1, "y") for i, t in enumerate(texts * 3)] + [(None, "q w " * 9, None, None, None)] * 2 + [(4, "la " * 12, "x", 1, "y")]
    got = periodic.digests(periodic.find(periodic.planted(spark.createDataFrame(rows, DOCS))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_row(r[0], r[1]) for r in rows), key=str)
    assert [f.name for f in got.schema] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_very_long_texts(spark):
    rng = random.Random(1)
    unlike = [f"w{rng.randrange(50_000)}" for _ in range(100_000)]
    texts = ["la " * 400_000, " ".join(unlike * 3), " ".join((["la"] * 999 + ["x"]) * 300), " ".join(["a", "b"] * 60_000 + ["a"] + ["a", "b"] * 60_000)]
    began = time.time()
    got = {r.doc_id: r for r in periodic.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("n", F.size("runs")).withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), r["period"].alias("p"))))).select("doc_id", "n", "best").collect()}
    assert time.time() - began < 60
    assert tuple(got[0].best) == (400_000, 1) and got[0].n == 1
    assert tuple(got[1].best) == (300_000, 100_000) and tuple(got[2].best) == (300_000, 1000) and got[2].n == 301
    # One break between two halves of period 2: a square for nearly every odd period.
    assert 59_000 < got[3].n < 61_000
