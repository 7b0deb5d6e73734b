"""A kept graph index of vectors: approximate neighbours at a small part of the distances of a full search.

Rows are dealt to shards of about `shard_rows` rows within their group (the label), by place, so that neither a hot group nor
repeated rows make a shard large. Each shard is one row of a table: its distinct vectors, the ids that share each, and a
proximity graph over the vectors. A search sends blocks of queries to the shards where they are read. Each query walks each
shard of its group with a beam of bounded width, starting from the best of about sqrt(n) entries; only the best of each shard
are shuffled.

A node's links are its nearest nodes that aren't nearer to a link it has already, both ways, the nearest first; a part of the
shard that no entry reaches is linked to its nearest node that is reached, so that every row can be found.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components are left out, as are rows without an id; a
null group is reached by queries without one only, which search every group. Rows that repeat an id stand each for
itself. Empty tables give no rows; other columns are ignored. Vectors of different lengths in one shard raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit_rows
from .retrieval import blocks, few, top

SHARDS = "grp string, nodes int, dims int, ids binary, first binary, vectors binary, links binary, degree int"
#: Rows whose similarities to all others, or queries whose walks, are held at once.
STEP = 256


def _spread(n: int) -> np.ndarray:
    """Numbers of about sqrt(n) of n nodes, the same in every run."""
    return np.sort(np.random.default_rng(n).permutation(n)[: int(np.ceil(np.sqrt(n)))])


def _chosen(x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the links each node chooses among its 2 * degree nearest."""
    n, c = len(x), min(2 * degree, len(x) - 1)
    froms, tos = [], []
    for at in range(0, n, STEP):
        own = np.arange(at, min(at + STEP, n))
        s = x[own] @ x.T
        s[own - at, own] = -np.inf
        near = np.argpartition(-s, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        score = np.take_along_axis(s, near, 1)
        between = np.einsum("icd,ikd->ick", x[near], x[near])
        kept = np.zeros(near.shape, bool)
        for j in range(c):
            covered = (kept & (between[:, j] > score[:, j, None])).any(axis=1)
            kept[:, j] = ~covered & (kept.sum(axis=1) < degree)
        # Where few are left, the nearest of the others fill up to half.
        spare = ~kept & (np.cumsum(~kept, axis=1) <= np.maximum(degree // 2 - kept.sum(axis=1), 0)[:, None])
        r, j = np.nonzero(kept | spare)
        froms.append(own[r])
        tos.append(near[r, j])
    return np.concatenate(froms), np.concatenate(tos)


def _reach(links: list[list[int]], begin: list[int], reached: np.ndarray) -> None:
    stack = [i for i in begin if not reached[i]]
    reached[stack] = True
    while stack:
        for j in links[stack.pop()]:
            if not reached[j]:
                reached[j] = True
                stack.append(j)


def graph(vectors: np.ndarray, degree: int) -> np.ndarray:
    """(nodes, width) of linked nodes, -1 behind the last: at most 2 * degree links a node, and those that join parts."""
    x, n = unit_rows(vectors.astype(float)), len(vectors)
    if n == 1:
        return np.full((1, 1), -1, np.int32)
    a, b = _chosen(x, degree)
    a, b = np.divmod(np.unique(np.concatenate([a * n + b, b * n + a])), n)
    order = np.lexsort((b, -np.einsum("id,id->i", x[a], x[b]), a))
    a, b = a[order], b[order]
    within = np.arange(len(a)) - np.searchsorted(a, a) < 2 * degree
    links: list[list[int]] = [[] for _ in range(n)]
    for i, j in zip(a[within].tolist(), b[within].tolist(), strict=True):
        links[i].append(j)
    reached = np.zeros(n, bool)
    _reach(links, _spread(n).tolist(), reached)
    while not reached.all():
        lost = int(np.argmin(reached))
        known = np.flatnonzero(reached)
        links[int(known[np.argmax(x[known] @ x[lost])])].append(lost)
        _reach(links, [lost], reached)
    out = np.full((n, max(map(len, links))), -1, np.int32)
    for i, own in enumerate(links):
        out[i, : len(own)] = own
    return out


def walk(vectors: np.ndarray, links: np.ndarray, wanted: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, scores, distances): for each query of wanted the best `beam` nodes it met, in no order, -1 where there are fewer.

    All queries step together; each opens the best node of its beam that isn't open yet, until all of them are.
    """
    entries, q = _spread(len(vectors)), len(wanted)
    every = np.arange(q)
    node = np.concatenate([np.broadcast_to(entries, (q, len(entries))), np.full((q, beam), -1)], axis=1)
    score = np.concatenate([wanted @ vectors[entries].astype(float).T, np.full((q, beam), -np.inf)], axis=1)
    best = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
    node, score = np.take_along_axis(node, best, 1), np.take_along_axis(score, best, 1)
    closed = node < 0
    seen = np.zeros((q, len(vectors)), bool)
    seen[:, entries] = True
    distances = np.full(q, len(entries))
    while True:
        ahead = np.where(closed, -np.inf, score)
        pick = ahead.argmax(axis=1)
        rows = np.flatnonzero(ahead[every, pick] > -np.inf)
        if not len(rows):
            return node, score, distances
        closed[rows, pick[rows]] = True
        near = links[node[rows, pick[rows]]]
        r, m = np.nonzero((near >= 0) & ~seen[rows[:, None], near])
        seen[rows[r], near[r, m]] = True
        met = np.full(near.shape, -np.inf)
        met[r, m] = np.einsum("id,id->i", vectors[near[r, m]].astype(float), wanted[rows[r]])
        distances[rows] += np.bincount(r, minlength=len(rows))
        all_scores = np.concatenate([score[rows], met], axis=1)
        best = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
        score[rows] = np.take_along_axis(all_scores, best, 1)
        node[rows] = np.take_along_axis(np.concatenate([node[rows], np.where(met > -np.inf, near, -1)], axis=1), best, 1)
        closed[rows] = np.take_along_axis(np.concatenate([closed[rows], met == -np.inf], axis=1), best, 1)


def build(vectors: DataFrame, shard_rows: int = 16_384, degree: int = 16) -> DataFrame:
    """The shards of vectors (vec_id, label, embedding); write them once, and search what is written.

    A shard takes shard_rows * shard_rows inner products to link, so that building grows with the rows.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("grp"), F.col("embedding").alias("v")).where(F.col("id").isNotNull() & good)
    sizes = rows.groupBy("grp").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    sizes = few(sizes)(sizes).withColumnRenamed("grp", "of")
    dealt = rows.join(sizes, F.col("grp").eqNullSafe(F.col("of"))).withColumn("shard", F.floor(F.rand(11) * F.col("shards")))
    kind = np.float64 if "double" in rows.schema["v"].dataType.simpleString() else np.float32

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        x, node = np.unique(np.stack(part["v"].to_list()).astype(kind), axis=0, return_inverse=True)
        ids = part["id"].to_numpy(np.int64)
        order = np.lexsort((ids, node := node.reshape(-1)))
        links, first = graph(x, degree), np.searchsorted(node[order], np.arange(len(x) + 1)).astype(np.int64)
        row = (part["grp"].iloc[0], *x.shape, ids[order].tobytes(), first.tobytes(), x.tobytes(), links.tobytes(), links.shape[1])
        return pd.DataFrame([row], columns=["grp", "nodes", "dims", "ids", "first", "vectors", "links", "degree"])

    made = dealt.select("id", "grp", "v", "shard").groupBy("grp", "shard").applyInPandas(shard, SHARDS)
    return made.withColumn("wide", F.lit(kind is np.float64))


def _walker(ids: np.ndarray, groups: list[str | None], wanted: np.ndarray, k: int, beam: int, skip_own: bool):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("distances", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (row for batch in batches for row in batch.to_pylist()):
            x = np.frombuffer(s["vectors"], np.float64 if s["wide"] else np.float32).reshape(s["nodes"], s["dims"])
            links = np.frombuffer(s["links"], np.int32).reshape(s["nodes"], s["degree"])
            members, first = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["first"], np.int64)
            own = np.array([i for i, g in enumerate(groups) if g is None or g == s["grp"]], int)
            for at in range(0, len(own), STEP):
                asked = own[at : at + STEP]
                found: list[tuple] = []
                for i, nodes, scores, distances in zip(asked, *walk(x, links, wanted[asked], beam), strict=True):
                    hits = [(-round(float(sc), 9), m) for v, sc in zip(nodes, scores, strict=True) if v >= 0 for m in members[first[v] : min(first[v + 1], first[v] + k + 1)].tolist()]
                    best = sorted(h for h in hits if not (skip_own and h[1] == ids[i]))[:k]
                    found += [(int(ids[i]), m, -sc, 0 if j else int(distances)) for j, (sc, m) in enumerate(best)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True)) for f in found], schema=schema)

    return run


def search(shards: DataFrame, queries: DataFrame, k: int, beam: int = 64, skip_own: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank, distances): the k best rows that each query found, by inner product to nine places.

    queries: query_id, label (null: every group) and the vector q. rank counts from 0, ties to the smaller id; distances are the
    inner products that the query took in all shards. skip_own leaves out rows of the query's own id. A wider beam finds more.
    """
    if beam < k + skip_own:
        raise ValueError(f"a beam of {beam} can't hold {k} rows")
    spark, found = shards.sparkSession, []
    asked = queries.select("query_id", F.col("label").cast("string").alias("grp"), "q").where("query_id is not null and q is not null")
    for part in blocks(asked):
        if block := part.collect():  # a block of bounded size
            run = _walker(np.array([r.query_id for r in block], np.int64), [r.grp for r in block], np.array([r.q for r in block], float), k, beam, skip_own)
            found.append(shards.mapInArrow(run, "query_id long, id long, score double, distances long"))
    if not found:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int, distances long")
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    hits = hits.withColumn("distances", F.sum("distances").over(Window.partitionBy("query_id")))
    return top(hits, k, item="id").withColumnRenamed("id", "vec_id").select("query_id", "vec_id", "score", "rank", "distances")
