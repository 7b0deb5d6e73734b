"""Audio as columns: energy, block averages, and frames cut from chunks of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rms(samples: Column, threshold: float = 0.01) -> Column:
    """Speech probability of samples in [-1, 1] by their energy; none: 0."""
    n = F.size(samples)
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / n
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(power) / max(threshold, 1e-6)))


def downsampled(samples: Column, rate: int, to: int = 16_000) -> Column:
    """Means of the samples that fall on each place of a lower rate; a rate that isn't higher leaves them."""
    if rate <= to:
        return samples
    ratio = F.lit(rate / to)
    half_up = lambda x: F.floor(x + 0.5).cast("int")
    n = half_up(F.size(samples) / ratio)

    def mean(i: Column) -> Column:
        part = F.slice(samples, half_up(i * ratio) + 1, half_up((i + 1) * ratio) - half_up(i * ratio))
        return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)).otherwise(0.0)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), mean)).otherwise(F.array().cast("array<double>"))


def frames(chunks: DataFrame, size: int = 960) -> DataFrame:
    """Frames of `size` units cut from the chunks (stream_id, seq, n) of each stream: stream_id, frame, seq (of the chunk that completes it).

    What a chunk leaves over is carried to the next, and an incomplete last frame is not given out: frame i is complete
    with the chunk whose running total first reaches (i + 1) * size. Running totals are a window over sorted rows; no
    stream is gathered in one row.
    """
    total = F.sum("n").over(Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    ends = chunks.withColumn("end", total).select("stream_id", "seq", F.floor((F.col("end") - F.col("n")) / size).alias("a"), F.floor(F.col("end") / size).alias("b"))
    return ends.where("b > a").select("stream_id", F.explode(F.sequence("a", F.col("b") - 1)).alias("frame"), "seq")
