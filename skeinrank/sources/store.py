"""Reading tables and keeping collections of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_path(root: str, language: str, split: str) -> str:
    """The file of a language's split."""
    return f"{root}/{split}/{language}{'train' if split == 'train' else 'val'}.parquet"


def scan(rows: DataFrame, column: str, value: str, order: str, n: int) -> DataFrame:
    """The first n rows with a value, in an order of their own: the filter reaches the scan, each task keeps n rows."""
    return rows.where(F.col(column) == value).orderBy(order).limit(n)


def without_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    return rows.drop(vector)


def lookup(asked: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """asked with the stored row of its key, null columns where there is none; stored has one row per key."""
    return asked.join(stored, key, "left")


def records(raw: DataFrame) -> DataFrame:
    """Nested question rows to passages: query_id, idx, lang_code, text, is_selected (0 past the flags' end)."""
    p = raw.select("query_id", "target_lang", F.posexplode("passages.Translated_passages").alias("idx", "text"), F.col("passages.is_selected").alias("flags"))
    lang = F.lower(F.substring(F.substring_index("target_lang", "_", 1), 1, 2))
    return p.where(strip(F.col("text")) != "").select("query_id", "idx", lang.alias("lang_code"), "text", F.coalesce(F.get("flags", F.col("idx")), F.lit(0)).alias("is_selected"))


def write_collection(chunks: DataFrame, path: str) -> None:
    """chunks (with lang_code) under path, one folder per language."""
    chunks.write.mode("overwrite").partitionBy("lang_code").parquet(path)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored evaluation reports, newest first; files that are no JSON are left out."""
    return spark.read.json(path, multiLine=True, mode="DROPMALFORMED").withColumn("modified", F.col("_metadata.file_modification_time")).orderBy(F.desc("modified"))
