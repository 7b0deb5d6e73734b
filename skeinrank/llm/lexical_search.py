"""Ranked lexical search of all documents for a set of items, by dual trees with exact pruning.

Documents are read once per block of items: each becomes a profile of its length and its counts of the block's terms, which
is written. From these come the number of documents, their length and the terms' document frequencies, and with them
every score is a product of an item's weights and a document's parts, both without negative numbers.

The items of a block are put into a tree, as are the profiles of each slice of an Arrow batch: a node's members are split in two by their
likeness to a member and to the one least like it, and it holds the maxima of its members' coordinates. The product of
two nodes' maxima bounds every score between their members. A task goes down both trees at once and leaves a pair of nodes
whose bound is below the weakest k-th score that the node's items have so far: whole batches of documents for whole groups
of items. Leaves are scored from the highest bound down. Nothing is dropped on a bound that equals a k-th score, as
a smaller id may win the tie, so the result is exact.

The k-th scores start from a first round over a share of the documents, which the second round, over all others, takes over. A
task hands on only what may be among an item's best, at most k rows an item; these are ranked at last.

Edge cases: a null text or one without terms has none: such an item finds nothing, such a document counts nowhere; equal
rows of items are one item, rows that share an id and not a text are items of their own, each with its own ranks; a null
doc_id ranks last among equal scores and comes out as null; documents that share an id are found each by itself; with an
empty table on either side there are no rows; texts of any length are taken whole; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

NO_ID = 2**63 - 1
#: Letters and digits and all bytes from 128 on stay, A-Z in lower case; everything else separates terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Sums of products below this are exact in double precision.
_EXACT = 2**53


@dataclass(frozen=True)
class Lexical:
    """k best documents an item; a score's length normalisation counts `length_share` percent; items are taken by about `block`."""

    k: int = 50
    length_share: int = 50
    block: int = 256
    slice_rows: int = 1024
    leaf: int = 16
    item_leaf: int = 4
    first_share: int = 16


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Tree:
    """Rows of a matrix, halved again and again; node 0 is the root.

    Node i holds the rows order[lo[i]:hi[i]] and their maxima top[i]; its children are kids[i] and kids[i] + 1, or it is a leaf (-1).
    """

    def __init__(self, rows: np.ndarray, leaf: int):
        norm = np.linalg.norm(rows, axis=1)
        self.order, self.lo, self.hi, self.kids, top = np.arange(len(rows)), [0], [len(rows)], [], []
        i = 0
        while i < len(self.lo):
            lo, hi = self.lo[i], self.hi[i]
            own = self.order[lo:hi]
            x = rows[own]
            top.append(x.max(axis=0))
            if hi - lo <= leaf:
                self.kids.append(-1)
            else:
                n = np.maximum(norm[own], 1e-300)
                near = x @ x[np.argmax(n)] / n
                far = x @ x[np.argmin(near)] / n
                side = near / np.maximum(near.max(), 1e-300) - far / np.maximum(far.max(), 1e-300)
                mid = (lo + hi) // 2
                self.order[lo:hi] = own[np.argsort(side, kind="stable")]
                self.kids.append(len(self.lo))
                self.lo += [lo, mid]
                self.hi += [mid, hi]
            i += 1
        self.top, self.kids = np.array(top), np.array(self.kids)


class Search:
    """The best documents of a block of items, over the slices of one task. weights: items x terms; least: what a score must reach."""

    def __init__(self, weights: np.ndarray, least: np.ndarray, how: Lexical):
        self.weights, self.how, self.least = weights, how, np.maximum(least, 1).astype(np.int64)
        self.tree = Tree(weights.astype(float), how.item_leaf)
        self.scores = [np.zeros(0, np.int64) for _ in weights]
        self.ids = [np.zeros(0, np.int64) for _ in weights]
        self.scored = self.pairs = self.pruned = 0

    def add(self, ids: np.ndarray, parts: np.ndarray, cols: np.ndarray) -> None:
        """A slice of documents: parts has the terms cols only."""
        docs, w = Tree(parts.astype(float), self.how.leaf), self.weights[:, cols]
        exact = float(w.sum(axis=1).max(initial=0)) * float(parts.max(initial=0)) < _EXACT
        kind = float if exact else np.int64
        self._down(0, np.zeros(1, np.int64), docs, ids, parts.astype(kind), w.astype(kind), self.tree.top[:, cols])

    def _down(self, item: int, nodes: np.ndarray, docs: Tree, ids: np.ndarray, parts: np.ndarray, w: np.ndarray, top: np.ndarray) -> None:
        mine = self.tree.order[self.tree.lo[item] : self.tree.hi[item]]
        while True:
            # Rounding of the bound must not take it below a score.
            bound = (docs.top[nodes] @ top[item]) * (1 + 1e-9)
            keep = bound >= self.least[mine].min()
            self.pairs += len(nodes)
            self.pruned += int((~keep).sum())
            nodes, bound = nodes[keep], bound[keep]
            kids = docs.kids[nodes]
            if not len(nodes) or self.tree.kids[item] >= 0 or (kids < 0).all():
                break
            nodes = np.concatenate([nodes[kids < 0], kids[kids >= 0], kids[kids >= 0] + 1])
        if not len(nodes):
            return
        if self.tree.kids[item] >= 0:
            nodes = np.concatenate([nodes[kids < 0], kids[kids >= 0], kids[kids >= 0] + 1])
            for child in (self.tree.kids[item], self.tree.kids[item] + 1):
                self._down(int(child), nodes, docs, ids, parts, w, top)
            return
        order = np.argsort(-bound, kind="stable")
        step = max(1, 2 * self.how.k // self.how.leaf)
        for at in range(0, len(order), step):
            some = order[at : at + step]
            if bound[some[0]] < self.least[mine].min():
                self.pruned += len(order) - at
                return
            rows = np.concatenate([docs.order[docs.lo[n] : docs.hi[n]] for n in nodes[some]])
            self.scored += len(rows) * len(mine)
            for i, score in zip(mine, (w[mine] @ parts[rows].T).astype(np.int64), strict=True):
                hit = np.flatnonzero(score >= self.least[i])
                if len(hit):
                    self._merge(i, score[hit], ids[rows[hit]])

    def _merge(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.scores[i], score]), np.concatenate([self.ids[i], ids])
        best = np.lexsort((ids, -score))[: self.how.k]
        self.scores[i], self.ids[i] = score[best], ids[best]
        if len(best) == self.how.k:
            self.least[i] = max(self.least[i], int(score[best[-1]]))


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def profiles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with a term: all their terms' number, and the counts of those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                own = terms(text.as_py())
                if own:
                    counts = Counter(map(find, own))
                    counts.pop(None, None)
                    rows.append({"doc_id": doc, "n": len(own), "terms": list(counts), "counts": list(counts.values())})
            yield pa.RecordBatch.from_pylist(rows, _PROFILE)

    core = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return core.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def parts_of(n: np.ndarray, counts: np.ndarray, documents: int, total: int, share: int) -> np.ndarray:
    """What each count of a term in a document of n terms gives per unit of the term's weight."""
    m = 100 - share + (share * n * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def _seeker(weights: np.ndarray, least: np.ndarray, documents: int, total: int, how: Lexical):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(weights, least, how)
        for whole in batches:
            for at in range(0, whole.num_rows, how.slice_rows):
                batch = whole.slice(at, how.slice_rows)
                sizes = np.diff(batch["terms"].offsets.to_numpy()).astype(np.int64)
                term = batch["terms"].flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), sizes)
                cols, col = np.unique(term, return_inverse=True)
                if len(cols):
                    parts = np.zeros((batch.num_rows, len(cols)), np.int64)
                    parts[row, col] = parts_of(batch["n"].to_numpy()[row], batch["counts"].flatten().to_numpy().astype(np.int64), documents, total, how.length_share)
                    search.add(batch["doc_id"].to_numpy(), parts, cols)
        item = np.repeat(np.arange(len(weights)), [len(s) for s in search.scores])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(search.ids)), pa.array(np.concatenate(search.scores))], names=["item", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list, how: Lexical) -> DataFrame | None:
    """(item_id, rank, doc_id, score) for the items of one block, given as rows (item_id, text)."""
    own = [set(terms(r.text)) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*own)))}
    if not vocabulary:
        return None
    seen = staged(profiles(docs, vocabulary), "profiles")
    documents, total = seen.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    # At most one row a term of the block.
    df = {r.term: r.df for r in seen.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = np.zeros((len(own), len(vocabulary)), np.int64)
    for i, words in enumerate(own):
        for t in words:
            if n := df.get(vocabulary[t]):
                weights[i, vocabulary[t]] = floor(1000 * log((2 * documents + 2) / (2 * n + 1)))
    share = F.pmod(F.xxhash64("doc_id", "n"), F.lit(how.first_share)) == 0
    shape = "item long, doc_id long, score long"
    first = staged(seen.where(share).mapInArrow(_seeker(weights, np.zeros(len(own)), documents, total, how), shape), "first-round")
    least = np.zeros(len(own), np.int64)
    for r in _ranked(first, how.k).where(F.col("rank") == how.k).select("item", "score").collect():  # at most one row an item
        least[r.item] = r.score
    rest = seen.where(~share).mapInArrow(_seeker(weights, least, documents, total, how), shape)
    names = F.broadcast(docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item long, item_id long"))  # a row an item of the block
    found = _ranked(first.unionByName(rest), how.k).join(names, "item")
    return found.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, how: Lexical = Lexical()) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents. docs: doc_id, text; items: item_id, text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    n = -(-rows.count() // how.block)
    parts = [rows] if n <= 1 else [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]
    found = None
    for part in parts:
        block = part.collect()  # about how.block items
        if block and (one := _block(docs, block, how)) is not None:
            found = one if found is None else found.unionByName(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
