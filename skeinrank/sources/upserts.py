"""Upserts into a collection: sinks that rewrite only what a batch touches, and counters taken beside a write."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .work import exists, written


@dataclass(frozen=True)
class Collection:
    """A folder of rows known by their key, dealt by its hash to `buckets` parts; the rows of a part are sorted by `cluster`.

    A row is in the part of its key whatever else it holds, so that a batch rewrites the parts of its keys and no others,
    also where a row has changed its language.
    """

    spark: SparkSession
    path: str
    key: str = "id"
    buckets: int = 64
    cluster: str = "lang_code"

    @property
    def _rows(self) -> str:
        return f"{self.path}/rows"

    def read(self) -> DataFrame | None:
        """The rows; none: nothing has been put in yet."""
        return self.spark.read.parquet(self._rows).drop("bucket") if exists(self.spark, self._rows) else None

    def done(self, batch_id: int) -> bool:
        marks = f"{self.path}/batches"
        return exists(self.spark, marks) and not self.spark.read.schema("batch long").parquet(marks).where(F.col("batch") == batch_id).isEmpty()

    def upsert(self, batch: DataFrame, batch_id: int, order: str | None = None) -> int:
        """Puts the rows of batch in, in place of those with their keys, and gives their number; a batch that has been put in changes nothing.

        Of rows of one key in a batch the greatest by order stays, ties by all columns. The new parts are worked out and written aside first: what
        is lost half-way is written again by the batch's next attempt.
        """
        if self.done(batch_id):
            return batch.count()
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = written(batch.withColumn("bucket", bucket), "upsert-batch")
        n = new.count()
        if n:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
            rest = [c for c in batch.columns if c not in (self.key, order)]
            latest = new.groupBy("bucket", self.key).agg(F.max(F.struct(*([order] if order else []), *rest)).alias("r"))
            latest = latest.select(*[F.col(c) if c == self.key else F.col(f"r.{c}").alias(c) for c in batch.columns], "bucket")
            if exists(self.spark, self._rows):
                old = self.spark.read.parquet(self._rows).where(F.col("bucket").isin(touched))
                latest = latest.unionByName(old.join(latest.select(self.key), self.key, "left_anti"), allowMissingColumns=True)
            aside = written(latest, "upsert-parts")
            parts = aside.repartition(min(len(touched), self.buckets), "bucket").sortWithinPartitions("bucket", *([self.cluster] if self.cluster in batch.columns else []), self.key)
            parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._rows)
        self.spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return n

    def sink(self, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """For `foreachBatch` of a stream."""

        def put(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, batch_id, order)

        return put


def counted(rows: DataFrame, counters: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, float]:
    """Writes rows and gives the counters, taken on the way in the same pass, with rows and rows_per_second."""
    seen = Observation()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in counters.items()])
    began = time.monotonic()
    write(watched)
    took = max(time.monotonic() - began, 1e-9)
    got = dict(seen.get)
    return got | {"rows_per_second": got["rows"] / took}
