"""Helpers that the operators share: the shared work folder, written intermediate tables, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bits of one block of a key filter (those of a bitmap of Spark's).
BLOCK_BITS = 32_768

_scratch: list[list[str]] = []
#: Tables that the last stage of a chain has left, for its successor to delete.
_left: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); only a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _scratch:
        paths.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders, if they are there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in paths:
        path = hadoop(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `staged` returned and that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, [df._staged])


def chained(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose result is written before the next stage is called on what was written: what it has staged is deleted then.

    Nothing that docs still reads is deleted.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        gone = [p for p in _left if not any(p.rpartition("/")[2] in f for f in read)]
        delete(spark, gone)
        _left.clear()
        _scratch.append(_left)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _scratch[:] = [x for x in _scratch if x is not _left]

    return run


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is staged inside when it ends: what is to outlive it must have been written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        delete(spark, _scratch.pop())


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of pairs of columns, as a join condition."""
    cond = F.lit(True)
    for a, b in keys.items():
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def attach(df: DataFrame, dim: DataFrame, keys: dict[str, str], spread: list[str], limit: int = 20_000, salts: int = 32) -> DataFrame:
    """Left join of df with dim, one row per key of dim; keys maps columns of df to those of dim (null-safe).

    dim is broadcast only if it has at most `limit` rows (counted here). Otherwise a salted join deals each key's
    rows of df to `salts` tasks by the hash of `spread`, and dim is repeated once per salt. dim must be cheap to
    read twice (pass a staged table). The columns of dim must not occur in df.
    """
    if dim.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(dim), same(df, dim, keys), "left").drop(*keys.values())
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int"))
    wide = dim.withColumn("__dim_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(wide, same(salted, wide, keys | {"__salt": "__dim_salt"}), "left").drop(*keys.values(), "__salt", "__dim_salt")


def heavy(total: int, hot: int = 4096, limit: int = 20_000) -> int:
    """The rows a key may have before it is treated as a hot one; of `total` rows fewer than `limit` keys have more."""
    return max(hot, -(-total // limit))


def meet(df: DataFrame, dim: DataFrame, key: list[str], total: int, **bounds: int) -> DataFrame:
    """Inner join of df with dim on key (never null), where dim has one row per key and in n the key's rows in df, `total` in all.

    Hot keys (see `heavy`, whose bound holds for any data) are broadcast. The others are dealt by key, none of them to a
    large task. dim must be cheap to read twice.
    """
    most = heavy(total, **bounds)
    big, small = dim.where(F.col("n") > most), dim.where(F.col("n") <= most)
    if big.isEmpty():
        return df.join(small, key)
    rest = df.join(F.broadcast(big.select(*key)), key, "left_anti").join(small, key)
    return rest.unionByName(df.join(F.broadcast(big), key))


def fan(df: DataFrame, few: DataFrame, key: str, n: str, most: int, spread: str, salts: int = 64) -> DataFrame:
    """Inner join of df with few, which has some rows per key; n, in both, is the key's rows in df.

    The rows of keys with more than `most` are dealt to `salts` tasks by the hash of spread, the rows of few to all of them.
    """
    cold = df.where(F.col(n) <= most).drop(n).join(few.where(F.col(n) <= most).drop(n), key)
    hot = df.where(F.col(n) > most).drop(n).withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    wide = few.where(F.col(n) > most).drop(n).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cold.unionByName(hot.join(wide, [key, "__salt"]).drop("__salt"))


def _places(key: list[str], blocks: int) -> tuple[Column, list[Column]]:
    """The block of a row's key in a filter, and its three places there."""
    a, b = F.xxhash64(*key), F.xxhash64(*key, F.lit(1))
    return F.pmod(a, F.lit(blocks)).cast("int"), [F.shiftrightunsigned(b, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(3)]


def _screened(df: DataFrame, ids: DataFrame, key: list[str], n: int, most_blocks: int) -> DataFrame:
    """df with __maybe: false only if the row's key isn't among the n keys of ids.

    A blocked Bloom filter of 16 bits a key, built by bitmap aggregation; its blocks, at most `most_blocks` of 4 kB, are
    broadcast and joined by the key's block.
    """
    blocks = max(1, min(most_blocks, -(-16 * n // BLOCK_BITS)))
    block, at = _places(key, blocks)
    bits = ids.select(block.alias("__block"), F.explode(F.array(*at)).alias("p")).groupBy("__block").agg(F.bitmap_construct_agg("p").alias("__bits"))
    bits = staged(bits, "key-filter")
    byte = lambda p: F.conv(F.hex(F.substring("__bits", (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.lit(True)
    for p in at:
        hit = hit & (F.getbit(byte(p), (p % 8).cast("int")) == 1)
    return df.withColumn("__block", block).join(F.broadcast(bits), "__block", "left").withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__block", "__bits")


def among(df: DataFrame, ids: DataFrame, key: list[str], limit: int = 1_000, most_blocks: int = 4096) -> DataFrame:
    """Rows of df whose key is among ids (distinct keys, staged), without shuffling most others.

    ids are broadcast if they are at most `limit`; else a Bloom filter of bounded size lets through few others, and only
    these rows are shuffled for the exact join. With very many more keys than the filter is for, it lets all through.
    """
    n = ids.count()
    if n <= limit:
        return df.join(F.broadcast(ids), key, "left_semi")
    return _screened(df, ids, key, n, most_blocks).where("__maybe").drop("__maybe").join(ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: list[str], limit: int = 1_000, most_blocks: int = 4096) -> DataFrame:
    """Rows of df whose key isn't among ids (distinct keys, staged), without shuffling most of them; see `among`."""
    n = ids.count()
    if n <= limit:
        return df.join(F.broadcast(ids), key, "left_anti")
    tagged = _screened(df, ids, key, n, most_blocks)
    sure, maybe = tagged.where("not __maybe").drop("__maybe"), tagged.where("__maybe").drop("__maybe")
    return sure.unionByName(maybe.join(ids, key, "left_anti"))
