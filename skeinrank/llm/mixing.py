"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, a target per source follows from the weights, and the repetition rate of a source is its
target over its size. Every document is emitted floor(rate) times, and once more with probability equal to the
fraction: a Bernoulli draw on the hash of a seed with the document's id, source and text, so that a document's copies
depend on nothing but itself and its source's rate, and `emit` draws on the rows themselves, without a join.

Where few documents hold most of a source's words, one set of draws may miss the target by far. So `seeds` sets of draws
are tried, each with its own seed, in one aggregation of partial sums, and every source takes the seed whose total comes
nearest to its target (the first of equals). The draws stay one Bernoulli draw per document.

Edge cases: a null text has size 0 and takes no words, though its row is drawn like any other; a null source is a source
of its own, last in order; an empty table gives no rows; rows that repeat a document in all of id, source and text draw
alike; other columns, whatever their names, are ignored by `plan` and kept by `emit`; texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, staged

#: Draws of a document are told apart by these columns.
_IDENTITY = ("doc_id", "source", "text_md5")


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, equal in any engine that has md5."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def weigh(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources (one row each: source, total) with their weights: by code point, null last, repeating.

    Sources are sorted in ranges; each row counts its place in its range and adds the sizes of those before.
    """
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    placed = staged(dealt.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))), "mix-order")
    per = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row per range
    base = per.select(F.col("part").alias("b_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("b_before"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    place = F.pmod(F.col("b_before") + F.col("i") - 1, F.lit(len(weights))) + 1
    return attach(placed, base, {"part": "b_part"}, ["source"]).withColumn("weight", F.element_at(w, place.cast("int"))).drop("part", "i", "b_before")


def targets(weighted: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds target: share of all sizes dealt by weight, at most cap times the source's own, the excess dealt anew.

    Only two sums reach the driver in each round; a round in which no further source meets its cap is the last.
    """
    limit = F.col("total") * F.lit(cap)
    amount = weighted.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] * share
    level, met = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        row = weighted.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(full).alias("met"),
        ).first()
        if row.met == met or not row.open:
            return weighted.withColumn("target", F.when(full, limit).otherwise(F.col("weight") * F.lit(level)).cast("double"))
        met, level = row.met, (amount - row.held) / row.open


def _drawn(seed: Column) -> Column:
    """Whether a document takes its extra copy, by the seed."""
    return hash_unit(seed, *[F.col(c) for c in _IDENTITY]) < F.col("rate") - F.floor("rate")


def _rated(rows: DataFrame, dim: DataFrame) -> DataFrame:
    return attach(rows, dim, {"source": "d_source"}, ["doc_id", "text_md5"]).withColumnsRenamed({f"d_{c}": c for c in ("source_size", "target", "rate", "seed") if f"d_{c}" in dim.columns})


def _sized(docs: DataFrame) -> DataFrame:
    """Per row of docs, in its order: row (all its columns), doc_id, source, size and the md5 of the text."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.struct("*").alias("row"), "doc_id", "source", words.alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def rates(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int, seeds: int) -> DataFrame:
    """Per source of sizes (staged): d_source, d_source_size, d_target, d_rate, and d_seed, the seed of its draws."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("total"))
    rate = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    dim = staged(targets(staged(weigh(per, weights), "mix-weights"), share, cap).select(F.col("source").alias("d_source"), F.col("total").alias("d_source_size"), F.col("target").alias("d_target"), rate.alias("d_rate")), "mix-targets")
    sums = [F.sum(F.when(_drawn(F.lit(seed + i)), F.col("size")).otherwise(0)).alias(f"s{i}") for i in range(seeds)]
    tried = _rated(sizes, dim).groupBy("source", "target", "source_size", "rate").agg(*sums)
    miss = lambda i: F.abs(F.floor("rate") * F.col("source_size") + F.col(f"s{i}") - F.col("target"))
    best = F.least(*[F.struct(miss(i).alias("miss"), F.lit(seed + i).alias("seed")) for i in range(seeds)])["seed"]
    return staged(tried.select(F.col("source").alias("d_source"), F.col("source_size").alias("d_source_size"), F.col("target").alias("d_target"), F.col("rate").alias("d_rate"), best.alias("d_seed")), "mix-rates")


def _copies(rows: DataFrame, dim: DataFrame) -> DataFrame:
    return _rated(rows, dim).withColumn("copies", (F.floor("rate") + F.when(_drawn(F.col("seed")), 1).otherwise(0)).cast("int"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, seeds: int = 16) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, rate, copies, taken (= size * copies)."""
    sizes = staged(_sized(docs).drop("row"), "mix-sizes")
    out = _copies(sizes, rates(sizes, weights, share, cap, seed, seeds))
    return out.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def emit(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, seeds: int = 16) -> DataFrame:
    """The mixed rows of docs, with the columns of docs: each document exactly as often as `plan` says."""
    sizes = staged(_sized(docs).drop("row"), "mix-sizes")
    out = _copies(_sized(docs), rates(sizes, weights, share, cap, seed, seeds))
    return out.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
