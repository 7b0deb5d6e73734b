"""Sparse and dense retrieval, rank fusion, and what follows it.

A query is searched in the documents of its language, or in all where its language has none (there is no sparse corpus
then). `bm25` joins documents with the queries' terms right where they are tokenized, so that postings of other
terms are never shuffled; `sparse_scan` scores documents against blocks of queries where they are read. So does dense search,
which keeps the best of each task. Ranks among all documents are counted for the few fused candidates only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULT, Config
from ..functions import text as tx
from ..functions.vectors import hash_cells
from ..sources.work import written
from . import sparse_scan
from .embedders import Embedder, vectors
from .sparse_index import SparseIndex

#: Queries of one block of dense search, and rows that may be broadcast.
BLOCK, FEW = 4096, 200_000
#: Languages that documents may have.
MOST_LANGUAGES = 10_000


def few(df: DataFrame, limit: int = FEW) -> Callable[[DataFrame], DataFrame]:
    """Marks frames of no more rows than df for broadcast if df has at most `limit` (counted here), else leaves them."""
    return F.broadcast if df.limit(limit + 1).count() <= limit else lambda x: x


def _key(docs: DataFrame) -> Column:
    return tx.language_key(F.col("lang")) if "lang" in docs.columns else F.lit("")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(corpus, term, n, size): documents of each language with each term; term null: all of them, size their tokens."""
    t = docs.select(_key(docs).alias("corpus"), tx.bm25_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    row = lambda term, size: F.struct(term.alias("term"), size.cast("long").alias("size"))
    entries = F.concat(F.array(row(F.lit(None).cast("string"), F.size("t"))), F.transform(F.array_distinct("t"), lambda x: row(x, F.lit(0))))
    return t.select("corpus", F.explode(entries).alias("e")).groupBy("corpus", "e.term").agg(F.count("*").alias("n"), F.sum("e.size").alias("size"))


def weights(vocab: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(corpus, term, idf, avgdl): Okapi weights; negative ones become a share of the mean over the corpus' vocabulary."""
    corpora = vocab.where("term is null").select("corpus", F.col("n").alias("docs"), (F.col("size") / F.col("n")).alias("avgdl"))  # a row per language
    small = few(corpora)
    corpora = small(corpora)
    raw = vocab.where("term is not null").join(corpora, "corpus").select("corpus", "term", "avgdl", (F.log(F.col("docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)).alias("raw"))
    mean = small(raw.groupBy("corpus").agg(F.avg("raw").alias("mean")))
    return raw.join(mean, "corpus").select("corpus", "term", "avgdl", F.when(F.col("raw") < 0, F.col("mean") * config.bm25_epsilon).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term with a query of their language; scores to six places.

    docs: doc_id, text, lang; queries: query_id, text, lang; without lang there is one corpus.
    """
    asked = queries.select("query_id", _key(queries).alias("corpus"), F.explode(tx.bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "corpus", "term").agg(F.count("*").alias("qf"))
    small = few(asked)
    terms = small(asked.select("corpus", "term").distinct())
    weighed = weights(vocabulary(docs), config).join(terms, ["corpus", "term"], "left_semi")
    toks = docs.select("doc_id", _key(docs).alias("corpus"), tx.bm25_tokens(F.col("text")).alias("t")).select("doc_id", "corpus", F.size("t").alias("dl"), F.explode("t").alias("term"))
    posts = toks.join(terms, ["corpus", "term"], "left_semi").groupBy("doc_id", "corpus", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    hit = posts.join(small(asked.join(weighed, ["corpus", "term"])), ["corpus", "term"])
    k1, b = config.bm25_k1, config.bm25_b
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def hash_vectors(texts: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """(key, bucket, value): unit vectors of hashed lower-case words, as their cells; no words: the first axis.

    The sign of a word is that of its bucket, as the number of axes is even. Words are hashed once per Python worker, and
    only cells that aren't zero leave it.
    """
    kind = texts.schema[key].dataType
    made = texts.select(key, "text").mapInArrow(hash_cells(config.dims, to_arrow_type(kind)), f"key {kind.simpleString()}, bucket int, value double")
    return made.withColumnRenamed("key", key)


def blocks(queries: DataFrame, size: int = BLOCK) -> list[DataFrame]:
    """queries in parts of about `size` rows."""
    n = -(-queries.count() // size)
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _scorer(matrix: Callable[[pa.RecordBatch], np.ndarray], ids: np.ndarray, groups: list[str | None], asked: Any, made: Callable[[Any], np.ndarray], k: int, skip_own: bool):
    """For mapInArrow on rows (id, grp and what matrix reads): the k best of a task for each query."""
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def best(at: np.ndarray, own: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best (place of a query, id, score) of each query, in order of the queries."""
        order = np.lexsort((own, -score, at))
        at, own, score = at[order], own[order], score[order]
        top = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[top], own[top], score[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.ascontiguousarray(made(asked).T)
        odd = not np.isfinite(wanted).all()
        kept, more, n = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        bar = np.full(len(ids), -np.inf)  # the k-th best score so far
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                own, group = batch["id"].to_numpy(), np.array(batch["grp"].to_pylist(), object)
                score = np.round((x := matrix(batch)) @ wanted, 9)
                if odd or not np.isfinite(x).all():
                    score[np.isnan(score)] = -np.inf
                for g in set(groups):
                    if g is not None:
                        score[np.ix_(group != g, [i for i, x in enumerate(groups) if x == g])] = -np.inf
                if skip_own:
                    score[own[:, None] == ids[None, :]] = -np.inf
                if not np.isfinite(bar).all() and len(own) > k:
                    bar = np.maximum(bar, np.partition(score, -k, axis=0)[-k])
                r, c = np.nonzero((score >= bar) & (score > -np.inf))
                more.append((c, own[r], score[r, c]))
                n += len(r)
                if n >= k * len(ids):  # no more than these are held beside those that are kept
                    kept, more, n = best(*map(np.concatenate, zip(kept, *more, strict=True))), [], 0
                    full = np.bincount(kept[0], minlength=len(ids)) == k
                    last = np.searchsorted(kept[0], np.nonzero(full)[0], "right") - 1
                    bar[full] = np.maximum(bar[full], kept[2][last])
        kept = best(*map(np.concatenate, zip(kept, *more, strict=True)))
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], schema=schema)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, matrix: Callable[[pa.RecordBatch], np.ndarray], skip_own: bool = False, made: Callable[[list[bytes]], np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, score, rank): each query's k best rows by inner product (to nine places), ties to the smaller id.

    rows: id, grp and what matrix reads; queries: query_id, grp (null: all rows) and the vector q. Queries are taken in
    blocks, each against all rows; a row meets a query where it is read, and only the best of a task are shuffled. made: makes the
    queries' vectors of their q in a task, where q is binary and smaller than a vector. Several blocks read rows and queries again and again:
    such ones should be written tables.
    """
    found = []
    for part in blocks(queries):
        if block := part.collect():  # about BLOCK queries
            asked = [bytes(r.q) for r in block] if made else np.array([r.q for r in block], float)
            run = _scorer(matrix, np.array([r.query_id for r in block], np.int64), [r.grp for r in block], asked, made or np.asarray, k, skip_own)
            found.append(rows.mapInArrow(run, "query_id long, id long, score double"))
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return top(_union(found), k, item="id")


def _own_corpus(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """queries with grp: the language if there are documents in it, else null."""
    known = [r.corpus for r in docs.select(_key(docs).alias("corpus")).distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is lang a language?")
    return queries.withColumn("grp", F.when(_key(queries).isin(known), _key(queries)))


def dense_top(docs: DataFrame, queries: DataFrame, k: int, config: Config = DEFAULT, embed: Embedder | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the nearest documents by unit vectors (hashed ones without an embedder), in the query's language or in all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _key(docs).alias("grp"), "text")
    asked = _own_corpus(docs, queries)
    made = embed or Embedder(config.dims)
    asked = asked.select("query_id", "grp", vectors(made, F.col("text")).alias("q"))
    return nearest(rows, asked, k, lambda batch: made.matrix(batch["text"].to_pylist())).withColumnRenamed("id", "doc_id")


def top(scores: DataFrame, k: int, by: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank from 0, ties by item."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), item)
    # The row number itself is filtered: so each task drops what can't be among the best before it is shuffled.
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(corpus, doc_id, place, docs) of the few rows of wanted (corpus, doc_id): smaller ids in the corpus, and its size.

    Documents are counted in the gaps between the wanted ids where they are read; only counts of gaps are added up.
    """
    cuts: dict[str, list[int]] = {}
    for r in wanted.distinct().orderBy("corpus", "doc_id").collect():
        cuts.setdefault(r.corpus, []).append(r.doc_id)
    sorted_cuts = {c: np.array(ids, np.int64) for c, ids in cuts.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corpus, ids = np.array(batch["corpus"].to_pylist(), object), batch["id"].to_numpy()
            for c, own in sorted_cuts.items():
                gap, n = np.unique(np.searchsorted(own, ids[corpus == c], "right"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(gap), pa.string()), pa.array(gap, pa.int64()), pa.array(n, pa.int64())], names=["corpus", "gap", "n"])

    rows = docs.select(_key(docs).alias("corpus"), F.col("doc_id").cast("long").alias("id")).where("id is not null")
    counted: dict[str, np.ndarray] = {c: np.zeros(len(ids) + 1, np.int64) for c, ids in cuts.items()}
    for r in rows.mapInArrow(count, "corpus string, gap long, n long").groupBy("corpus", "gap").agg(F.sum("n").alias("n")).collect():
        counted[r.corpus][r.gap] = r.n
    made = [(c, d, int(p), int(n.sum())) for c, n in counted.items() for d, p in zip(cuts[c], np.cumsum(n), strict=False)]
    return docs.sparkSession.createDataFrame(made, "corpus string, doc_id long, place long, docs long")


def fuse(dense: DataFrame, sparse: DataFrame, spots: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Reciprocal ranks of the dense candidates: (query_id, doc_id, dense_rank, sparse_rank, rrf).

    dense: query_id, corpus (null: no sparse part), doc_id, rank, at most `candidates` rows a query. The sparse rank counts the better
    documents of the whole corpus; those without a shared term score 0, and equals stand in order of doc_id. spots: see `places`.
    Each hit of a query is counted once, by its place among the query's candidates, in order of score and in order of id.
    """
    small = few(dense)
    own = dense.select("query_id", "corpus", "doc_id", F.col("rank").alias("dense_rank")).join(sparse, ["query_id", "doc_id"], "left").withColumn("s", F.coalesce("score", F.lit(0.0))).drop("score")
    by_score = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("k"), "doc_id"))), lambda x: F.struct((-x["k"]).alias("s"), x["doc_id"].alias("doc_id")))
    lists = own.where("corpus is not null").groupBy("query_id").agg(by_score.alias("best"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    hit = sparse.join(small(lists), "query_id")
    ahead = F.size(F.filter("best", lambda x: (x["s"] > F.col("score")) | ((x["s"] == F.col("score")) & (x["doc_id"] <= F.col("doc_id")))))
    cells = hit.select("query_id", ahead.alias("a"), F.size(F.filter("ids", lambda x: x <= F.col("doc_id"))).alias("b")).groupBy("query_id", "a", "b").agg(F.count("*").alias("n"))
    tables = cells.groupBy("query_id").agg(F.collect_list(F.struct("a", "b", "n")).alias("cells"), F.sum("n").alias("hits"))  # at most a cell for each pair of places
    added = lambda keep: F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    at = lambda kind: F.col(f"p.{kind}")
    spot = F.transform("best", lambda x, i: F.struct(x["doc_id"].alias("doc_id"), i.alias("a"), (F.array_position("ids", x["doc_id"]) - 1).alias("b")))
    counted = lists.join(tables, "query_id").select("query_id", "cells", "hits", F.explode(spot).alias("p")).select(
        "query_id", at("doc_id").alias("doc_id"), "hits", added(lambda x: x["a"] <= F.col("p.a")).alias("above"), added(lambda x: x["b"] <= F.col("p.b")).alias("before")
    )
    both = own.join(counted, ["query_id", "doc_id"], "left").na.fill(0, ["above", "before", "hits"]).join(F.broadcast(spots), ["corpus", "doc_id"], "left")
    zeros = F.when(F.col("s") < 0, F.col("docs") - F.col("hits")).when(F.col("s") == 0, F.col("place") - F.col("before")).otherwise(F.lit(0))
    both = both.withColumn("sparse_rank", F.when(F.col("corpus").isNotNull(), F.col("above") + zeros))
    return both.select("query_id", "doc_id", "dense_rank", "sparse_rank", reciprocal(config).alias("rrf"))


def reciprocal(config: Config = DEFAULT) -> Column:
    """The fused score of dense_rank and sparse_rank, which may be null."""
    return F.round(1 / (config.rrf_k + F.col("dense_rank")) + F.coalesce(config.sparse_weight / (config.rrf_k + F.col("sparse_rank")), F.lit(0.0)), 9)


def hybrid(docs: DataFrame, queries: DataFrame, config: Config = DEFAULT, index: SparseIndex | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """The final_k documents of each query: dense candidates re-ranked by fusion with the sparse ranks of their language.

    A query of a language without documents, or without a token, keeps its dense order. Queries are taken in blocks. With an index
    of docs, sparse scores come from its postings and statistics; else documents are counted where they are read. vocab: `vocabulary` of
    docs, if it is written already.
    """
    if index is None and vocab is None:
        vocab = written(sparse_scan.vocabulary(docs), "vocabulary")
    parts = [_hybrid(docs, part, config, index, vocab) for part in blocks(queries)]
    return _union(parts) if parts else docs.sparkSession.createDataFrame([], "query_id long, doc_id long, rrf double, rank int")


def _hybrid(docs: DataFrame, queries: DataFrame, config: Config, index: SparseIndex | None, vocab: DataFrame | None) -> DataFrame:
    found = dense_top(docs, queries, config.candidates, config).select("query_id", "doc_id", "rank").collect()  # `candidates` rows a query
    near = docs.sparkSession.createDataFrame(found, "query_id long, doc_id long, rank int")
    corpus = F.when(F.size(tx.bm25_tokens(F.coalesce("text", F.lit("")))) > 0, F.col("grp"))
    near = near.join(_own_corpus(docs, queries).select("query_id", corpus.alias("corpus")), "query_id")
    if index:
        spots = places(docs, near.where("corpus is not null").select("corpus", "doc_id"))
        fused = fuse(near, written(index.scores(queries), "sparse-scores"), spots, config)
    else:
        counted = sparse_scan.ranks(docs, queries, near.where("corpus is not null").select("query_id", "corpus", "doc_id"), vocab, config)
        fused = near.withColumnRenamed("rank", "dense_rank").join(counted, ["query_id", "doc_id"], "left").withColumn("rrf", reciprocal(config))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "dense_rank")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.final_k).select("query_id", "doc_id", "rrf", "rank")


def _arrays(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch["v"].to_pylist(), float).reshape(batch.num_rows, -1)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest of each query among the rows of its label: (query_id, vec_id, score, rank).

    vectors: vec_id, label, embedding; queries: query_id, label, q. A row is no neighbour of its own.
    """
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("grp"), F.col("embedding").alias("v"))
    asked = queries.select("query_id", F.col("label").cast("string").alias("grp"), "q")
    return nearest(rows, asked, k, _arrays, skip_own=True).withColumnRenamed("id", "vec_id")


def best_per_document(hits: DataFrame, keep: int) -> DataFrame:
    """The best hit of each document, then the best `keep` of each query."""
    one = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "id")
    return top(hits.withColumn("i", F.row_number().over(one)).where("i = 1").drop("i"), keep, item="id")


def to_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Children replaced by their parent's text, first child per parent only; a missing parent keeps the child."""
    first = Window.partitionBy("query_id", "parent_id").orderBy("rank")
    one = hits.withColumn("i", F.row_number().over(first)).where("i = 1").drop("i")
    p = chunks.select(F.col("id").alias("parent_id"), F.col("text").alias("parent_text"))
    return one.join(p, "parent_id", "left").withColumn("text", F.coalesce("parent_text", "text")).drop("parent_text")
