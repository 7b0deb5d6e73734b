"""Passages to chunks: sentence children with parents, token windows, character windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as tx
from ..functions.ids import chunk_id


def sentence_chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to children: doc_id, id, parent_id, text, chunk_index."""
    doc = F.col("doc_id").cast("string")
    parent = chunk_id(F.col("text"), F.concat(F.lit("parent:"), doc))
    child = docs.where(tx.strip(F.col("text")) != "").select("doc_id", parent.alias("parent_id"), F.explode(tx.merged_sentences(tx.sentences(F.col("text")))).alias("c"))
    made = chunk_id(F.col("c.text"), F.concat(F.lit("child:"), doc, F.lit(":"), F.col("c.chunk_index").cast("string")))
    return child.select("doc_id", made.alias("id"), "parent_id", F.col("c.text").alias("text"), F.col("c.chunk_index").alias("chunk_index"))


def parents(docs: DataFrame) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return docs.where(tx.strip(F.col("text")) != "").select("doc_id", chunk_id(F.col("text"), F.concat(F.lit("parent:"), doc)).alias("id"), "text")


def window_chunks(docs: DataFrame, config: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs to token windows: doc_id, id, text, chunk_index, and the columns of docs named in keep."""
    doc = F.col("doc_id").cast("string")
    cut = docs.where(tx.strip(F.col("text")) != "").select("doc_id", *keep, F.explode(tx.token_windows(F.col("text"), config.window_tokens, config.window_overlap)).alias("c"))
    made = chunk_id(F.col("c.text"), F.concat(F.lit("slide:"), doc, F.lit(":"), F.col("c.chunk_index").cast("string")))
    return cut.select("doc_id", made.alias("id"), F.col("c.text").alias("text"), F.col("c.chunk_index").alias("chunk_index"), *keep)


def char_chunks(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return docs.select("doc_id", F.posexplode(tx.char_windows(F.col("text"), config.eval_chunk, config.eval_overlap)).alias("chunk_index", "text"))
