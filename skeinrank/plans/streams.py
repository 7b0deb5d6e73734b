"""Queries of what streams give, over tables: sessions with time limits, and frames cut from bytes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import replay
from ..sources.store import table
from ..streaming import live
from .registry import query

_KINDS = ("open", "partial", "final", "end", "partial")


@query("""WITH m AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, ts, (['open', 'partial', 'final', 'end', 'partial'])[(event_id % 5 + 1)::INT] AS kind, event_type || event_id AS text FROM events),
d AS (SELECT *, ts + CASE WHEN kind = 'end' THEN INTERVAL 2 HOUR ELSE INTERVAL 40 HOUR END AS due FROM m),
s AS (SELECT *, coalesce(lag(kind = 'final') OVER w, true) OR kind = 'open' OR lag(due) OVER w < ts AS starts, lead(ts) OVER w AS next_ts, lead(kind) OVER w AS next_kind FROM d WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
p AS (SELECT *, sum(starts::INT) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS part FROM s),
l AS (SELECT *, row_number() OVER (PARTITION BY session_id, part ORDER BY ts DESC, seq DESC) AS back, last_value(CASE WHEN kind = 'partial' THEN text END IGNORE NULLS) OVER (PARTITION BY session_id, part ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS partial FROM p)
SELECT session_id, CASE WHEN kind = 'final' THEN text ELSE coalesce(partial, '') END AS text, kind = 'final' AS is_final, kind <> 'final' AS timed_out, CASE WHEN kind = 'final' THEN ts ELSE due END AS ended
FROM l WHERE back = 1 AND NOT (kind <> 'final' AND coalesce(next_kind = 'open' AND next_ts <= due, false))""")
def session_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of messages to their final text, or, when their time has passed, to their last partial one."""
    e = table(spark, sf, "events")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS) + 1).cast("int"))
    messages = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return live.sessions(messages, timedelta(hours=2), timedelta(hours=40)).withColumnRenamed("at", "ended")


@query("""WITH h AS (SELECT conv_id::VARCHAR AS stream_id, string_agg(hex(encode(text)), '' ORDER BY turn) AS h FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT stream_id, i::BIGINT AS frame, md5(substr(h, i * 640 + 1, 640)) AS digest FROM (SELECT stream_id, h, unnest(range(0, length(h) // 640)) AS i FROM h)""")
def byte_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of any number of bytes cut into frames of 320, the rest carried to the next chunk."""
    chunks = table(spark, sf, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").cast("binary").alias("pcm"))
    return live.byte_frames(chunks, 320).select("stream_id", "frame", F.md5(F.hex("pcm")).alias("digest"))


_LANGS = ("en", "ta", "auto", "hi-IN", "TE_in")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, (['en', 'ta', 'auto', 'hi', 'te'])[(vec_id % 5 + 1)::INT] AS lang, 't' || vec_id * 7 % 300 AS text FROM embeddings),
p AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS n FROM e WHERE vec_id % 3 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 <> 0),
r AS (SELECT *, (SELECT count(*) FROM p WHERE p.vec_id < e.vec_id) AS n FROM e WHERE vec_id % 3 = 0),
t AS (SELECT vec_id, text, unnest([lang, 'auto', 'ta', 'hi', 'en', 'te']) AS l, unnest(range(0, 6)) AS ord FROM r),
x AS (SELECT t.vec_id AS query_id, p.vec_id AS put_id, row_number() OVER (PARTITION BY t.vec_id ORDER BY ord, p.vec_id DESC) AS i FROM t JOIN p ON p.lang = t.l AND p.text = t.text AND p.vec_id < t.vec_id),
s AS (SELECT r.vec_id AS query_id, p.vec_id AS put_id, r.lang AS asked, p.lang AS kept, round(list_inner_product(r.v, p.v) / ((sqrt(list_inner_product(r.v, r.v)) + 1e-9) * (sqrt(list_inner_product(p.v, p.v)) + 1e-9)), 9) AS score, p.n
  FROM r JOIN p ON p.n <= r.n AND p.n > r.n - 150 WHERE r.vec_id NOT IN (SELECT query_id FROM x)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n) AS i FROM s)
SELECT query_id, 'exact' AS tier, put_id, NULL::DOUBLE AS score FROM x WHERE i = 1
UNION ALL SELECT query_id, 'semantic', put_id, round(score, 6) FROM b WHERE i = 1 AND score >= 0.3 AND (asked = 'auto' OR asked = kept)""")
def cache_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every third vector asks, the others are put in, by their number in time: what each request finds in a cache of 150 entries."""
    e, n = table(spark, sf, "embeddings"), F.col("vec_id")
    lang = F.element_at(F.array(*map(F.lit, _LANGS)), (n % len(_LANGS) + 1).cast("int"))
    rows = e.select(n.alias("id"), n.alias("seq"), lang.alias("lang"), F.concat(F.lit("T"), (n * 7 % 300).cast("string"), F.lit(" ")).alias("text"), F.col("embedding").cast("array<double>").alias("v"))
    puts = rows.where("id % 3 <> 0").withColumnRenamed("id", "put_id").withColumns({"answer": F.when(F.col("seq") % 11 == 0, "").otherwise("x"), "refused": F.col("seq") % 13 == 0})
    found = replay.replayed(rows.where("id % 3 = 0").withColumnRenamed("id", "query_id"), puts, Config(cache_items=150, cache_threshold=0.3))
    return found.withColumn("score", F.round("score", 6))
