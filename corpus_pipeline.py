"""A training corpus from raw documents: quality rules, near duplicates, personal data, mixing, packing.

Each stage is written as Parquet to the shared work folder and read again as the next one's documents; what it wrote on
its way is deleted then, by `run` and by the next stage that is called: a stage's result must be written before that.

Every stage takes documents with any other columns, whatever their names, and nulls in every one, and keeps them up to mixing; an empty
table gives an empty one. A null or empty text is rejected by the quality rules; behind them, it would be nobody's near copy, hold
no personal data, count no words and be packed as its end id alone. Rows that share an id, or have none, are taken each by
its own text. Repeated rows are near copies of each other: one stays. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinrank.llm import mixing, near_dup, packing, pii, quality_rules
from skeinrank.llm.common import chained, delete, fresh_path, scratch
from skeinrank.llm.queries import pii_key
from skeinrank.llm.tokens import byte_bpe_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


@chained
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; with no language or source they are judged in groups of their own."""
    return quality_rules.keep(docs)


@chained
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8) stays: the least id, null ids last."""
    return near_dup.keep(docs)


@chained
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = pii.replace(docs, pii_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@chained
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by their source's target; those without a source are a source."""
    return mixing.emit(docs)


@chained
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed into sequences; a piece each, with the columns of the packing and no others."""
    return packing.pack(docs, byte_bpe_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("pii_surrogates", personal_data),
    ("source_mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over sf_dir's documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs, before = spark.read.parquet(path), delete(spark, [before] if before else []) or path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near duplicates and robust outliers can't be put into SQL: run() is tested against a brute-force version.
ORACLE_SQL = None
