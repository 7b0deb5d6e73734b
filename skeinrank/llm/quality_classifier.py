"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled good rows) and unlabelled documents train a logistic model on statistics of whole texts by
minimising the non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
The prior is estimated first: a plain classifier of positives against unlabelled ranks both, and over its upper regions
that hold at least `PRIOR_REGION` of the positives, the least ratio of the unlabelled share to the positive share bounds
the share of positives among the unlabelled. Training sees at most `sample` rows of each kind, those of least hash (of
at most as many ids), however many rows share an id; every document is scored.

Edge cases: null and empty texts have zero statistics and get a score; null doc_ids are not held out; documents that
share a doc_id are scored each; without positives every score is 0.5; very long texts are read whole; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_words", "word_len", "long_words", "short_words", "upper_words", "symbols", "pipes", "marks", "digits",
    "line_words", "dup_lines", "word_variety", "top_word", "next_same", "repeated_pairs", "odd_ends",
)
PRIOR_REGION = 0.3
_SYMBOLS = re.compile(r"[#*$%&<>=~^\\{}\[\]_]")
_ODD_END = re.compile(r"[^\w\s.,;:?!)'\"»”’](?=\s|$)|!!(?=\s|$)")


def features(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of FEATURES."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    again = sum(c for c in pairs.values() if c > 1) / max(1, n - 1)
    lens = [len(w) for w in words]
    return [
        np.log(n),
        sum(lens) / n,
        sum(x > 12 for x in lens) / n,
        sum(x <= 3 for x in lens) / n,
        sum(map(str.isupper, words)) / n,
        len(_SYMBOLS.findall(text)) / chars,
        text.count("|") / n,
        text.count("!") / n,
        sum(map(text.count, "0123456789")) / chars,
        np.log(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        np.log(n / len(count)) / (1 + np.log(n)),
        max(count.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        again,
        len(_ODD_END.findall(text)) / n,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_expand((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)))


def _expand(z: np.ndarray) -> np.ndarray:
    """Bounded statistics and their sizes either way."""
    z = np.clip(z, -6, 6)
    return np.column_stack([z, np.abs(z)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam on a vector of parameters."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """positive, unlabelled: scores of a classifier of the one against the other."""
    cuts = np.quantile(positive, np.linspace(0.0, 1 - PRIOR_REGION, 71))
    slack = lambda n: np.sqrt(0.5 / max(1, n))
    ratios = [(np.mean(unlabelled >= c) + slack(len(unlabelled)) * 0.1) / max(1e-9, np.mean(positive >= c)) for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    both = np.concatenate([positive, unlabelled])
    # Robust scales: the good documents' spread, so that junk stands out.
    mean, scale = np.median(positive, axis=0), np.maximum(positive.std(axis=0), 1e-3)
    p, u = (np.column_stack([_expand((x - mean) / scale), np.ones(len(x))]) for x in (positive, unlabelled))

    def apart(w: np.ndarray) -> np.ndarray:
        return -(p.T @ _sigmoid(-p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + decay * w

    first = _descend(apart, p.shape[1], steps // 2, rate)
    prior = estimate_prior(p @ first, u @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        # Sigmoid loss: l(+) = s(-g), l(-) = s(g).
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        dp, du = sp * (1 - sp), su * (1 - su)
        rest = su.mean() - prior * sp.mean()
        up, down = -prior * (p.T @ dp) / len(p), (u.T @ du) / len(u) - prior * (p.T @ dp) / len(p)
        return (up + down if rest >= 0 else -down) + decay * w

    w = _descend(risk, p.shape[1], steps, rate)
    return Model(mean, scale, w[:-1], float(w[-1]), prior) if len(both) else Model(mean, scale, w[:-1], 0.0, prior)


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def _featured(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["h"], pa.array([features(t.as_py()) for t in batch["text"]], pa.list_(pa.float64()))], names=["h", "x"])


def _matrix(rows: DataFrame, sample: int) -> np.ndarray:
    """The statistics of at most sample of the rows (doc_id, text): only numbers reach the driver, never more than these."""
    marked = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(_featured, "h long, x array<double>")
    got = marked.orderBy("h").limit(sample).collect()
    return np.array([r.x for r in got]).reshape(len(got), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> Model | None:
    """docs: doc_id, text; labels: doc_id, quality. At most sample positives and as many unlabelled documents are used."""
    good = labels.where((F.col("quality") == 1) & (fold(F.col("doc_id")) != 1)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    core = docs.select("doc_id", "text")
    positive = _matrix(core.join(F.broadcast(good), "doc_id", "left_semi"), sample)
    some = core.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)
    unlabelled = _matrix(core.join(F.broadcast(some), "doc_id", "left_semi"), sample)
    return train(positive, unlabelled) if len(positive) and len(unlabelled) else None


def _scorer(model: Model | None):
    def score(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch["text"]]).reshape(batch.num_rows, len(FEATURES))
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64())], names=["doc_id", "score"])

    return score


def scores(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    core = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = core.mapInArrow(_scorer(fit(docs, labels, sample)), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
