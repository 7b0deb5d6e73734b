"""Approximate nearest neighbours by inner product: probed lists scanned with adaptive dimension tests.

Vectors are extended by one component so that all have the norm of the longest, which turns the largest inner product
into the least distance, then rotated at random, once. Centroids come from a k-means over a bounded sample (`sample` rows
of least hash); every vector is put in the list of its nearest centroid, and lists are stored in blocks of bounded size,
each with its rotated and its original coordinates.

A query first scans its nearest lists, until they hold 4 (k + 1) vectors; its k-th distance so far is carried to the
other lists that it probes, nearest first until all hold `probe_share` of all vectors. In a block, the rotated coordinates
are read in blocks of columns: after each, a candidate whose partial distance, scaled to all dimensions, exceeds what the
carried distance allows at `epsilon` standard errors is abandoned. While many candidates are left, a block of columns is one
matrix product for all; once few are, only these are read on. What is left is scored anew, in double precision, on the
original vectors. Blocks and bundles of queries meet by list, block and chunk of bundles, so that a large list is many
tasks, and none of them sees more than one block with `chunk` bundles.

Equal vectors are stored once, as a node with their k + 1 smallest ids: no more of them can be among a query's k nearest. Nodes have
numbers of their own, in order of their least id.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose
length isn't the most frequent one (ties: the longest); rows that repeat an id and vector count once; rows that share an id and not
the vector are rows of their own, each a candidate with its own score, also for each other, and each a query with its own ranks; ties go to
the smaller id; fewer candidates than k are all returned if their lists are probed (probing goes on until 4 (k + 1) vectors
are reached); an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, staged


@dataclass(frozen=True)
class Adaptive:
    """Parameters of index and search."""

    sample: int = 16_384
    rounds: int = 10
    list_rows: int = 2_048
    block_rows: int = 8_192
    query_rows: int = 256
    chunk: int = 64
    probe_share: float = 0.8
    columns: int = 16
    epsilon: float = 2.1
    seed: int = 7


@dataclass(frozen=True)
class Space:
    """The transformation and the centroids, a few thousand rows at most."""

    longest: float
    rotation: np.ndarray
    centroids: np.ndarray

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, rest]) @ self.rotation

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))]) @ self.rotation

    def far(self, points: np.ndarray) -> np.ndarray:
        """Distances (squared, less what a row shares) to the centroids."""
        return (self.centroids**2).sum(axis=1) - 2.0 * points @ self.centroids.T


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of double."""
    v = F.col("embedding").cast("array<double>")
    v = F.transform(v, lambda x: x + F.lit(0.0))  # one zero
    sound = F.size("v") > 0
    sound = sound & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    most = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return df.where(F.size("v") == (most.n if most else 0))


def fit(points: DataFrame, rows: int, p: Adaptive) -> Space:
    """points: (node, v) of distinct vectors, `rows` of them; only the sample reaches the driver."""
    longest = points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] ** 0.5
    sample = np.array([r.v for r in points.orderBy(F.xxhash64("v"), "node").limit(p.sample).collect()])
    rng = np.random.default_rng(p.seed)
    rotation = np.linalg.qr(rng.standard_normal((sample.shape[1] + 1,) * 2))[0]
    lists = max(1, min(len(sample) // 8, max(round(rows**0.5 / 8), rows // p.list_rows), 4096))
    space = Space(longest, rotation, np.zeros((1, 1)))
    x = space.points(sample)
    centroids = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(p.rounds):
        own = Space(longest, rotation, centroids).far(x).argmin(axis=1)
        sums, n = np.zeros_like(centroids), np.bincount(own, minlength=lists)
        np.add.at(sums, own, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return Space(longest, rotation, centroids)


def _assigner(space: Space):
    def assign(batches):
        for b in batches:
            own = space.far(space.points(np.stack(b["v"]))).argmin(axis=1) if len(b) else np.zeros(0, int)
            yield pd.DataFrame({"node": b["node"], "list": own, "v": b["v"]})

    return assign


def _prober(space: Space, counts: np.ndarray, share: float, least: int):
    """Lists to probe, in two parts: the nearest that hold `least` vectors, and those up to the share of all."""
    need = max(least, int(np.ceil(share * counts.sum())))

    def probe(batches):
        for b in batches:
            if not len(b):
                continue
            order = space.far(space.queries(np.stack(b["v"]))).argsort(axis=1, kind="stable")
            reached = np.cumsum(counts[order], axis=1)
            first, takes = (reached < least).sum(axis=1) + 1, (reached < need).sum(axis=1) + 1
            for i, node in enumerate(b["node"]):
                lists = order[i, : takes[i]]
                yield pd.DataFrame({"list": lists, "node": node, "first": np.arange(len(lists)) < first[i]})

    return probe


def _blocker(space: Space):
    def block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        x = np.stack(group["v"])
        return pd.DataFrame({"list": [group["list"].iloc[0]], "shard": [group["shard"].iloc[0]], "nodes": [group["node"].to_numpy("<i8").tobytes()], "matrix": [x.astype("<f8").tobytes()], "points": [space.points(x).astype("<f8").tobytes()]})

    return block


def _bundler(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node")
    whole = [group["node"].to_numpy("<i8").tobytes(), np.stack(group["v"]).astype("<f8").tobytes(), group["bound"].to_numpy("<f8").tobytes()]
    return pd.DataFrame({"list": [group["list"].iloc[0]], "bundle": [group["bundle"].iloc[0]], "q_nodes": [whole[0]], "q_matrix": [whole[1]], "bounds": [whole[2]]})


def scan(qs: np.ndarray, xs: np.ndarray, bound: np.ndarray, p: Adaptive) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate row) of what survives the tests; qs and xs rotated, bound: each query's squared distance to stay within."""
    dims = xs.shape[1]
    cuts = [*range(0, dims, p.columns), dims]
    limit = lambda d: bound * (d / dims) * (1 + p.epsilon / d**0.5) ** 2 if d < dims else bound
    have, alive, i, j, sparse = np.zeros((len(qs), len(xs))), None, None, None, False
    for a, b in zip(cuts, cuts[1:], strict=False):
        if sparse:
            diff = qs[i, a:b] - xs[j, a:b]
            have = have + (diff * diff).sum(axis=1)
            keep = have <= limit(b)[i]
            i, j, have = i[keep], j[keep], have[keep]
            continue
        have += (qs[:, a:b] ** 2).sum(axis=1)[:, None] + (xs[:, a:b] ** 2).sum(axis=1) - 2 * qs[:, a:b] @ xs[:, a:b].T
        within = have <= limit(b)[:, None]
        alive = within if alive is None else alive & within
        if alive.mean() < 0.02:
            sparse, (i, j) = True, np.nonzero(alive)
            have = have[i, j]
    return (i, j) if sparse else np.nonzero(alive)


def _scanner(space: Space, k: int, p: Adaptive):
    schema = pa.schema([("q", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for qn, qm, bounds, xn, xm, xp in zip(*(batch[c] for c in ("q_nodes", "q_matrix", "bounds", "nodes", "matrix", "points")), strict=True):
                qn, xn, bound = np.frombuffer(qn.as_py(), "<i8"), np.frombuffer(xn.as_py(), "<i8"), np.frombuffer(bounds.as_py(), "<f8")
                q = np.frombuffer(qm.as_py(), "<f8").reshape(len(qn), -1)
                x, xs = np.frombuffer(xm.as_py(), "<f8").reshape(len(xn), -1), np.frombuffer(xp.as_py(), "<f8").reshape(len(xn), -1)
                qs = space.queries(q)
                for at in range(0, len(xn), 2048):
                    i, j = scan(qs, xs[at : at + 2048], bound, p)
                    j = j + at
                    score = np.concatenate([(q[i[s : s + 65_536]] * x[j[s : s + 65_536]]).sum(axis=1) for s in range(0, len(i), 65_536)]) if len(i) else np.zeros(0)
                    order = np.lexsort((xn[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    top = np.arange(len(i)) - np.searchsorted(i, i) < k
                    yield pa.RecordBatch.from_arrays([pa.array(qn[i[top]]), pa.array(xn[j[top]]), pa.array(score[top])], schema=schema)

    return run


def _scanned(probes: DataFrame, blocks: DataFrame, shards: DataFrame, space: Space, k: int, bundles: int, p: Adaptive, name: str) -> DataFrame:
    """(q, node, score) of what probes (list, node, v, bound) find in the blocks of their lists."""
    made = probes.withColumn("bundle", F.pmod(F.xxhash64("node"), F.lit(bundles)).cast("int")).groupBy("list", "bundle").applyInPandas(_bundler, "list int, bundle int, q_nodes binary, q_matrix binary, bounds binary")
    chunks = -(-bundles // p.chunk)
    made = attach(made.withColumn("chunk", F.pmod("bundle", F.lit(chunks))), shards, {"list": "s_list"}, ["bundle"]).where("shards is not null").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    wide = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    met = wide.join(made, ["list", "shard", "chunk"]).select("q_nodes", "q_matrix", "bounds", "nodes", "matrix", "points")
    found = met.mapInArrow(_scanner(space, k, p), "q long, node long, score double")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))
    return staged(found.withColumn("i", best).where(F.col("i") <= k).drop("i"), name)


def search(vectors: DataFrame, is_query: Column, k: int = 20, p: Adaptive = Adaptive()) -> DataFrame:
    """The k nearest of each row of vectors (vec_id, embedding) for which is_query: query_id, rank, vec_id, score.

    is_query is a condition on vec_id; a row is no candidate of its own.
    """
    spark = vectors.sparkSession
    clean = valid(vectors).distinct()
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = clean.withColumn("i", place).where(F.col("i") <= k + 1)
    # Numbers that rise with the least id, so that ties between nodes go to it.
    held = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).orderBy(F.get("ids", F.lit(0)), "v")
    nodes = staged(held.withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
    rows = nodes.count()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = staged(clean.where(is_query).join(nodes.select("v", "node"), "v").select(F.col("vec_id").alias("query_id"), "node"), "ann-asked")
    space = fit(nodes, rows, p)
    listed = staged(nodes.select("node", "v").mapInPandas(_assigner(space), "node long, list int, v array<double>"), "ann-lists")
    per = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # at most a few thousand lists
    counts = np.array([per.get(i, 0) for i in range(len(space.centroids))])
    shards = staged(listed.groupBy("list").agg(F.ceil(F.count("*") / p.block_rows).cast("int").alias("shards")).withColumnRenamed("list", "s_list"), "ann-shards")
    dealt = attach(listed, shards, {"list": "s_list"}, ["node"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    blocks = staged(dealt.groupBy("list", "shard").applyInPandas(_blocker(space), "list int, shard int, nodes binary, matrix binary, points binary"), "ann-blocks")
    asking = staged(asked.select("node").distinct().join(nodes.select("node", "v"), "node"), "ann-queries")
    bundles = max(1, -(-asking.count() // p.query_rows))
    probes = staged(asking.mapInPandas(_prober(space, counts, p.probe_share, 4 * (k + 1)), "list int, node long, first boolean"), "ann-probes")
    far = float("inf")
    first = _scanned(probes.where("first").join(asking, "node").withColumn("bound", F.lit(far)), blocks, shards, space, k + 1, bundles, p, "ann-first")
    # The k-th distance so far: of extended vectors, so that all have the same norm.
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    kth = first.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).withColumnRenamed("q", "node")
    bound = F.when(F.col("n") > k, (norm + space.longest**2 - 2 * F.col("least")) * (1 + 1e-9) + 1e-12).otherwise(F.lit(far))
    rest = probes.where("not first").join(asking.join(kth, "node").select("node", "v", bound.alias("bound")), "node")
    second = _scanned(rest, blocks, shards, space, k + 1, bundles, p, "ann-second")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))
    top = first.union(second).withColumn("i", best).where(F.col("i") <= k + 1).select("q", "node", "score")
    rows_of = top.join(nodes.select("node", "ids"), "node").select("q", "node", "score", F.explode("ids").alias("vec_id"))
    again = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "node"))
    short = rows_of.withColumn("i", again).where(F.col("i") <= k + 1)
    near = staged(short.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("i", "vec_id", "score", "node"))).alias("near")), "ann-near")
    # The row itself, and no other of its id, is left out.
    itself = lambda x: (x["vec_id"] == F.col("query_id")) & (x["node"] == F.col("q"))
    own = asked.join(near, asked["node"] == near["q"]).select("query_id", F.filter("near", lambda x: ~itself(x)).alias("near"))
    out = own.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
