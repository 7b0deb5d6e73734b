"""A slot for embedders: named makers of unit vectors, any of which dense search takes.

An embedder is a small object that is sent to the workers and loads what it needs there, once for each. `hash` is the tier that needs nothing;
`fitted_svd` makes a second tier from a corpus: the leading directions of the hashed term matrix, by one pass in which every task adds up
the products of its rows, a matrix of `dims` by `dims`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from ..functions.vectors import hash_matrix, unit_rows


@dataclass
class Embedder:
    """Unit vectors of `dims` hashed words; load() is called once per Python worker, before the first texts."""

    dims: int = DEFAULT.dims
    loaded: bool = field(default=False, repr=False)

    def load(self) -> None:
        pass

    def encode(self, texts: list[str | None]) -> np.ndarray:
        return hash_matrix(texts, self.dims)

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        if not self.loaded:
            self.load()
            self.loaded = True
        return unit_rows(self.encode(texts))


@dataclass
class Projected(Embedder):
    """Hashed words, weighed by how rare their axis is, on the leading directions of a corpus."""

    directions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)), repr=False)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)

    def encode(self, texts: list[str | None]) -> np.ndarray:
        return (unit_rows(np.sign(x := hash_matrix(texts, self.dims)) * np.log1p(np.abs(x))) * self.weights) @ self.directions


_NAMED: dict[str, Embedder] = {"hash": Embedder()}


def register(name: str, embedder: Embedder) -> None:
    """Puts an embedder into the slot of a name; it must give vectors for texts."""
    if not callable(getattr(embedder, "matrix", None)):
        raise TypeError(f"{name}: no embedder")
    _NAMED[name] = embedder


def embedder(name: str) -> Embedder:
    if name not in _NAMED:
        raise KeyError(f"no embedder {name}; there are {', '.join(sorted(_NAMED))}")
    return _NAMED[name]


def vectors(named: str | Embedder, texts: Column) -> Column:
    """The vectors of texts, as a column: an iterator over Arrow batches that loads the embedder, or that of a name, once."""
    made = embedder(named) if isinstance(named, str) else named

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(made.matrix(batch.tolist())), dtype=object)

    return run(texts)


def fitted_svd(docs: DataFrame, rank: int = 64, dims: int = DEFAULT.dims) -> Projected:
    """The embedder of the `rank` leading directions of docs (text)."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, present, n = np.zeros((dims, dims)), np.zeros(dims), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = hash_matrix(batch.slice(at, 1024)["text"].to_pylist(), dims)
                present, n = present + (x != 0).sum(axis=0), n + len(x)
                x = unit_rows(np.sign(x) * np.log1p(np.abs(x)))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(present), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "n", "present", "sums"])

    cells = docs.select("text").mapInArrow(products, "row int, n long, present double, sums array<double>").select("row", "n", "present", F.posexplode("sums").alias("col", "x"))
    rows = cells.groupBy("row", "col").agg(F.sum("x").alias("x"), F.sum(F.when(F.col("col") == 0, F.col("present"))).alias("present"), F.sum(F.when(F.col("col") == 0, F.col("n"))).alias("n")).collect()  # dims * dims numbers
    gram, present, n = np.zeros((dims, dims)), np.zeros(dims), 0
    for r in rows:
        gram[r.row, r.col] = r.x
        if r.col == 0:
            present[r.row], n = r.present, r.n
    weights = np.log((n + 1) / (present + 1)) + 0.1
    values, directions = np.linalg.eigh(weights[:, None] * gram * weights)
    order = np.argsort(-values)[:rank]
    # The sign of a direction is free: its largest part is positive.
    directions = directions[:, order]
    return Projected(dims, directions=directions * np.sign(directions[np.abs(directions).argmax(axis=0), range(directions.shape[1])]), weights=weights)
