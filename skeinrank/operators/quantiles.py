"""Exact percentiles of groups of any size.

Groups of up to `limit` rows take the built-in exact percentile, whose buffer is that small. In larger ones the wanted ranks
are selected: a sketch cuts a group's values into ranges, rows are counted per range, and only ranges that hold a wanted
rank go on, to be cut again until they have at most `limit` rows or one value. A value that is itself a cut has a range of
its own, so that ties end at once. No buffer grows with a group's rows or its distinct values.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written

#: Cuts of a range in one round.
CUTS = 32


def _interpolated(values: Column, n: Column, p: float) -> Column:
    """The percentile between the values (by rank) at its neighbouring ranks."""
    at = F.lit(p) * (n - 1)
    low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
    below, above = F.try_element_at(values, low), F.try_element_at(values, high)
    return F.when(low == high, below).otherwise((high - at) * below + (at - low) * above)


def _ranks(n: Column, points: Iterable[float]) -> Column:
    return F.array_distinct(F.flatten(F.array(*[F.array(f(F.lit(p) * (n - 1)).cast("long")) for p in points for f in (F.floor, F.ceil)])))


def _selected(rows: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """(k, rank, value) of wanted (k, rank) among rows (k, v)."""
    found: list[DataFrame] = []
    open_ = rows.withColumn("r", F.lit("")).withColumn("base", F.lit(0).cast("long"))
    wanted = wanted.withColumn("r", F.lit(""))
    while True:
        open_ = written(open_, "ranges")
        cuts = open_.groupBy("k", "r").agg(F.percentile_approx("v", F.array(*[F.lit((i + 0.5) / CUTS) for i in range(CUTS)]), F.lit(40 * CUTS)).alias("cuts"))
        cuts = written(cuts, "cuts")
        each = [F.get("cuts", F.lit(i)) for i in range(CUTS)]
        below = reduce(lambda a, b: a + b, [(c < F.col("v")).cast("int") for c in each])
        upto = reduce(lambda a, b: a + b, [(c <= F.col("v")).cast("int") for c in each])
        binned = open_.join(cuts, ["k", "r"]).select("k", "r", "base", "v", (below + upto).alias("b"))
        counts = binned.groupBy("k", "r", "base", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = Window.partitionBy("k", "r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        spans = counts.withColumn("from", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        hit = written(wanted.join(spans, ["k", "r"]).where("rank >= from and rank < from + n").select("k", "r", "b", "rank", "from", "n", "lo", "hi"), "ranks")
        found.append(hit.where("lo = hi").select("k", "rank", F.col("lo").alias("value")))
        rest = hit.where("lo <> hi")
        few = rest.where(F.col("n") <= limit)
        ranges = few.groupBy("k", "r", "b", "from").agg(F.collect_set("rank").alias("ranks"))
        lists = binned.join(ranges, ["k", "r", "b"]).groupBy("k", "r", "b", "from", "ranks").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # at most `limit` values
        found.append(lists.select("k", "vs", "from", F.explode("ranks").alias("rank")).select("k", "rank", F.get("vs", (F.col("rank") - F.col("from")).cast("int")).alias("value")))
        many = rest.where(F.col("n") > limit)
        if many.isEmpty():
            return reduce(DataFrame.unionByName, found)
        name = F.concat("r", F.lit("."), F.col("b").cast("string"))
        keys = many.select("k", "r", "b", "from").distinct()
        open_ = binned.drop("base").join(keys, ["k", "r", "b"]).select("k", name.alias("r"), "v", F.col("from").alias("base"))
        wanted = many.select("k", "rank", name.alias("r"))


def percentiles(rows: DataFrame, by: list[str], column: str, points: dict[str, float], digits: int | None = None, limit: int = 100_000) -> DataFrame:
    """by and a column for each of points (name: fraction), by linear interpolation; null values don't count; groups without values are missing."""
    shown = lambda c: c if digits is None else F.round(c, digits)
    # A struct: null keys are keys as well.
    narrow = rows.select(F.struct(*by, F.lit(0).alias("__")).alias("k"), F.col(column).cast("double").alias("v")).where("v is not null")
    sizes = written(narrow.groupBy("k").agg(F.count("*").alias("n")), "sizes")
    big = sizes.where(F.col("n") > limit)
    plain = lambda d: d.groupBy("k").agg(*[shown(F.percentile("v", F.lit(p))).alias(name) for name, p in points.items()])
    if big.isEmpty():
        out = plain(narrow)
    else:
        # Of the rows, at most one in `limit` is such a key.
        large = narrow.join(big.select("k"), "k", "left_semi")
        wanted = big.select("k", F.explode(_ranks(F.col("n"), points.values())).alias("rank"))
        values = _selected(large, wanted, limit).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("values")).join(big, "k")
        chosen = values.select("k", *[shown(_interpolated(F.col("values"), F.col("n"), p)).alias(name) for name, p in points.items()])
        out = plain(narrow.join(big.select("k"), "k", "left_anti")).unionByName(chosen)
    return out.select(*[F.col(f"k.{c}").alias(c) for c in by], *points)
