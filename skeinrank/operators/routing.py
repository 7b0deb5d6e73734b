"""Routing of queries: caches and nearest centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.shaping import asked_language
from ..functions.text import strip


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, c): unit means of vectors (label, embedding), one row per label."""
    cell = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label"))), F.lit(1e-9))
    return cell.select("label", "i", (F.col("m") / norm).alias("c"))


def route(vectors: DataFrame, cells: DataFrame, reject: list[int], config: Config = DEFAULT) -> DataFrame:
    """(vec_id, nearest, score, rejected): the nearest centroid, ties to the smaller label; cells: label, i, c.

    The centroids, one per label (at most `config.labels` of them), are one array in every task: no vector is shuffled.
    """
    held = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cells")).orderBy("label").limit(config.labels + 1).collect()
    if len(held) > config.labels:
        raise ValueError(f"more than {config.labels} labels; raise config.labels")
    labels = np.array([r.label for r in held], np.int64)
    matrix = np.array([[x.c for x in r.cells] for r in held])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(labels):
                score = np.round(np.array(batch["embedding"].to_pylist(), float) @ matrix.T, 9)
                best = score.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(labels[best]), pa.array(score[np.arange(len(best)), best])], names=["vec_id", "nearest", "score"])

    kind = dict(cells.dtypes)["label"]
    best = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(nearest, "vec_id long, nearest long, score double")
    return best.select("vec_id", F.col("nearest").cast(kind).alias("nearest"), "score", (F.col("nearest").isin(reject) & (F.col("score") >= config.guardrail)).alias("rejected"))


def exact_probe(asked: DataFrame, cached: DataFrame) -> DataFrame:
    """First cached response of each asked text over its own language, then auto, ta, hi, en, te.

    asked: query_id, lang, text; cached: lang, text, response. (query_id, hit_lang, response). Languages count by their first part,
    in lower case, on both sides; none is auto.
    """
    key = lambda c: F.lower(strip(c))
    langs = F.array(asked_language(F.col("lang"), "auto"), *[F.lit(x) for x in ("auto", "ta", "hi", "en", "te")])
    tries = asked.select("query_id", key(F.col("text")).alias("k"), F.posexplode(langs).alias("ord", "hit_lang"))
    kept = cached.select(asked_language(F.col("lang"), "auto").alias("hit_lang"), key(F.col("text")).alias("k"), "response")
    hit = tries.join(kept, ["hit_lang", "k"])
    return hit.groupBy("query_id").agg(F.min(F.struct("ord", "response", "hit_lang")).alias("b")).select("query_id", F.col("b.hit_lang").alias("hit_lang"), F.col("b.response").alias("response"))


def semantic_probe(best: DataFrame, threshold: float = DEFAULT.cache_threshold) -> DataFrame:
    """best: query_id, lang, and the nearest cached entry (vec_id, score, entry_lang): hits above the threshold in the language."""
    lang = asked_language(F.col("lang"), "auto")
    ok = (lang == "auto") | (lang == asked_language(F.col("entry_lang"), "auto"))
    return best.where((F.col("score") >= threshold) & ok)


def admitted(responses: DataFrame) -> DataFrame:
    """Responses (answer, refused) that may enter a cache."""
    return responses.where((F.coalesce("answer", F.lit("")) != "") & ~F.coalesce("refused", F.lit(False)))


def oldest_out(entries: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The newest cache_items of entries (seq), in first-in first-out order: a top-k of each task's own, then of these."""
    return entries.orderBy(F.desc("seq")).limit(config.cache_items)
