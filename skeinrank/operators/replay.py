"""The two-tier cache replayed in order: a request sees what was put before it, and, by likeness, only what hasn't been pushed out.

Puts are numbered in order, and a request's number is that of the last put before it. The exact tier keeps the latest put of
a key for ever: an as-of join. The tier by likeness keeps the last `items` puts, first in, first out: a request meets the put
numbers from its own back to `items` before. Requests are taken in blocks of put numbers, and a put goes to the blocks that can see it,
`items` / `block` + 1 of them, so that no task holds more than a block's window; blocks of very many requests are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.shaping import asked_language, cache_key
from ..functions.text import strip
from ..sources.work import written
from .retrieval import few

#: Languages that the exact tier tries after the asked one, in order.
FALLBACK = ("auto", "ta", "hi", "en", "te")
HITS = "query_id long, put_id long, score double"


def _numbered(puts: DataFrame) -> DataFrame:
    """puts with n, their place in order from 1: sorted by ranges, numbered in each, and offset by what stands before."""
    ranged = written(puts.repartitionByRange("seq").sortWithinPartitions("seq", "put_id").withColumn("part", F.spark_partition_id()), "ranged-puts")
    own = ranged.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("seq", "put_id")))
    before = ranged.groupBy("part").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return own.join(F.broadcast(before.select("part", "before")), "part").withColumn("n", F.col("i") + F.col("before")).drop("part", "i", "before")


def _as_of(requests: DataFrame, puts: DataFrame) -> DataFrame:
    """requests with n, the number of the last put before them (0: none): counts by range of n, no join on inequality."""
    step = max(1024, -(-puts.count() // 100_000))
    bounds = [r.seq for r in puts.where((F.col("n") - 1) % step == 0).orderBy("n").select("seq").collect()]  # at most 100,000
    edge = np.array(bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["query_id"], b["seq"], pa.array(np.maximum(np.searchsorted(edge, b["seq"].to_numpy(), "left") - 1, 0))], names=["query_id", "seq", "slot"])

    at = requests.select("query_id", "seq").mapInArrow(place, "query_id long, seq long, slot long")
    both = at.select("slot", "seq", "query_id", F.lit(None).cast("long").alias("n")).unionByName(puts.select(F.floor((F.col("n") - 1) / step).alias("slot"), "seq", F.lit(None).cast("long").alias("query_id"), "n"))
    # A request at a put's own time doesn't see it yet.
    order = Window.partitionBy("slot").orderBy("seq", F.col("n").isNotNull(), "n").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.max("n").over(order)).where("query_id is not null")
    return seen.select("query_id", F.coalesce("last", F.col("slot") * step).alias("n"))


def _nearest(left: pa.Table, right: pa.Table, items: int, threshold: float) -> pa.Table:
    """The first of the likest visible puts (right) of each request (left), if it is like enough and of its language."""
    schema = pa.schema([("query_id", pa.int64()), ("put_id", pa.int64()), ("score", pa.float64())])
    out: dict[str, list] = {"query_id": [], "put_id": [], "score": []}
    if left.num_rows and right.num_rows:
        order = np.argsort(right["n"].to_numpy(), kind="stable")
        n, ids, langs = right["n"].to_numpy()[order], right["put_id"].to_numpy()[order], np.array(right["lang"].to_pylist(), object)[order]
        unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
        held = unit(np.array(right["v"].to_pylist(), float)[order])
        for a in range(0, left.num_rows, 512):
            part = left.slice(a, 512)
            score = np.round(unit(np.array(part["v"].to_pylist(), float)) @ held.T, 9)
            own = part["n"].to_numpy()[:, None]
            score[(n[None, :] > own) | (n[None, :] <= own - items)] = -np.inf
            best = score.argmax(axis=1)
            top = score[np.arange(len(best)), best]
            for q, lang, j, s in zip(part["query_id"].to_pylist(), part["lang"].to_pylist(), best, top, strict=True):
                if s >= threshold and lang in ("auto", langs[j]):
                    for c, value in zip(out, (q, int(ids[j]), float(s)), strict=True):
                        out[c].append(value)
    return pa.Table.from_pydict(out, schema=schema)


def replayed(requests: DataFrame, puts: DataFrame, config: Config = DEFAULT, block: int = 1_000, deal: int = 4) -> DataFrame:
    """(query_id, tier, put_id, score): what each request found: its exact key (score null), else the likest entry; requests that found nothing are missing.

    requests: query_id, seq, lang, text, v; puts: put_id, seq (each its own), lang, text, v, answer, refused. Puts without an answer or refused don't enter.
    A put without a vector is in the exact tier only.
    """
    puts = puts.where((F.coalesce("answer", F.lit("")) != "") & ~F.coalesce("refused", F.lit(False)))
    lang = lambda d: d.withColumn("lang", asked_language(F.col("lang"), "auto"))
    kept = lang(puts).select(F.col("put_id").cast("long"), F.col("seq").cast("long").alias("seq"), "lang", cache_key(F.col("lang"), F.col("text")).alias("key"), "v")
    asked = written(lang(requests).select(F.col("query_id").cast("long"), F.col("seq").cast("long").alias("seq"), "lang", F.lower(strip(F.col("text"))).alias("text"), "v"), "replay-requests")
    every = written(kept, "replay-puts")
    # Exact: the first language in order that has the text, by its latest put before the request.
    tries = asked.select("query_id", "seq", "text", F.posexplode(F.array(F.col("lang"), *map(F.lit, FALLBACK))).alias("ord", "l")).withColumn("key", F.concat_ws(":", "l", "text"))
    small = few(every)
    hit = tries.join(small(every.select("key", F.col("seq").alias("put_seq"), "put_id")), "key").where("put_seq < seq").groupBy("query_id", "ord").agg(F.max(F.struct("put_seq", "put_id")).alias("p"))
    exact = written(hit.groupBy("query_id").agg(F.min_by("p", "ord").alias("p")).select("query_id", F.col("p.put_id").alias("put_id")), "exact-hits")
    # By likeness, for the others.
    held = written(_numbered(every.where("v is not null").select("put_id", "seq", "lang", "v")), "numbered-puts")
    rest = asked.where("v is not null").join(exact, "query_id", "left_anti")
    rest = rest.join(_as_of(rest, held), "query_id").where("n > 0").withColumns({"b": F.floor(F.col("n") / block), "salt": F.pmod(F.xxhash64("query_id"), F.lit(deal)).cast("int")})
    spans = F.sequence(F.floor(F.col("n") / block), F.floor((F.col("n") + config.cache_items - 1) / block))
    wide = held.withColumn("b", F.explode(spans)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    items, threshold = config.cache_items, config.cache_threshold
    near = rest.select("b", "salt", "query_id", "n", "lang", "v").groupBy("b", "salt").cogroup(wide.select("b", "salt", "put_id", "n", "lang", "v").groupBy("b", "salt")).applyInArrow(lambda x, y: _nearest(x, y, items, threshold), HITS)
    return exact.select("query_id", F.lit("exact").alias("tier"), "put_id", F.lit(None).cast("double").alias("score")).unionByName(near.select("query_id", F.lit("semantic").alias("tier"), "put_id", "score"))
