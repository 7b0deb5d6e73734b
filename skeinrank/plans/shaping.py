"""Queries of sources, requests, replies, caches and audio: small projections over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LANGUAGE_TAGS
from ..functions import shaping
from ..functions import text as tx
from ..functions.vectors import pooled, unit
from ..operators import chunking, records, routing
from ..sources import store
from ..sources.store import table
from ..streaming import audio
from .queries import _docs
from .registry import query

_S = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _pick(column: str, values: tuple[str | None, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


def _sql_pick(column: str, values: tuple[str | None, ...]) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({column} % {len(values)} + 1)::INT]"


_RAW_LANGS = ("en", "hi-IN", "TA_in", None, "auto", " te ", "xx")
_TAG_LIST = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in LANGUAGE_TAGS) + "}"


@query(f"""WITH r AS (SELECT doc_id, {_sql_pick("doc_id", _RAW_LANGS)} AS l FROM documents),
k AS (SELECT doc_id, lower(trim(split_part(split_part(coalesce(l, 'auto'), '-', 1), '_', 1))) AS cache_lang, lower(trim(split_part(split_part(coalesce(l, 'en'), '-', 1), '_', 1))) AS lang FROM r)
SELECT doc_id, cache_lang, lang, coalesce({_TAG_LIST}[lang], 'en-IN') AS tag FROM k""")
def language_tags(spark: SparkSession, sf: str) -> DataFrame:
    raw = _pick("doc_id", _RAW_LANGS)
    lang = shaping.asked_language(raw, "en")
    return table(spark, sf, "documents").select("doc_id", shaping.asked_language(raw, "auto").alias("cache_lang"), lang.alias("lang"), shaping.language_tag(lang).alias("tag"))


@query(f"""SELECT conv_id, turn, {_sql_pick("conv_id", ("en", "ta", None))} IS NOT NULL AS tagged,
  lower(coalesce({_sql_pick("conv_id", ("en", "ta", None))}, 'auto')) || ':' || lower({_S.format("text")}) AS key FROM conversations""")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    lang = _pick("conv_id", ("en", "ta", None))
    return table(spark, sf, "conversations").select("conv_id", "turn", lang.isNotNull().alias("tagged"), shaping.cache_key(lang, F.col("text")).alias("key"))


@query("""SELECT coalesce('orig' || nullif(doc_id % 3, 0), 'id' || doc_id) AS id, n_chars / 1000.0::DOUBLE AS score, text, coalesce(CASE WHEN doc_id % 4 > 0 THEN lang END, '') AS lang_code, 'd' || doc_id AS doc_id,
  CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id END AS query_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END::INT AS is_selected, 'window' AS chunk_type, '' AS parent_id, 0::INT AS chunk_index FROM documents""")
def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Stored payloads with gaps to hits with every default."""
    d = F.col("doc_id")
    number = lambda c: c.cast("string")
    payload = F.struct(
        F.when(d % 3 != 0, F.concat(F.lit("orig"), number(d % 3))).alias("original_id"), F.concat(F.lit("id"), number(d)).alias("id"), F.col("text"), F.when(d % 4 > 0, F.col("lang")).alias("lang_code"),
        F.concat(F.lit("d"), number(d)).alias("doc_id"), F.when(d % 5 != 0, d).alias("query_id"), F.when(d % 2 != 0, F.lit(1)).alias("is_selected"), F.lit("window").alias("chunk_type"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("chunk_index"),
    )
    return table(spark, sf, "documents").select(shaping.hit(payload, F.col("n_chars") / 1000).alias("h")).select("h.*")


@query(f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 4 = 0 THEN '' ELSE text END AS asked, CASE WHEN conv_id % 3 = 0 THEN 'heard' END AS heard, CASE WHEN turn % 2 = 1 THEN text ELSE '' END AS said,
  CASE WHEN conv_id % 2 = 0 THEN 0.5 END::DOUBLE AS sure, {_sql_pick("conv_id", ("en-IN", "", None))} AS spoken, CASE WHEN conv_id % 5 = 0 THEN true END AS no FROM conversations)
SELECT conv_id, turn, CASE WHEN asked = '' THEN 'No query provided' ELSE coalesce(heard, asked) END AS transcription, CASE WHEN asked = '' THEN 'Please speak or type a question.' ELSE coalesce(nullif(said, ''), 'Acknowledged.') END AS reply,
  CASE WHEN asked = '' THEN 0 ELSE coalesce(sure, 0.95) END::DOUBLE AS confidence, CASE WHEN asked = '' THEN 'hi-IN' ELSE coalesce(nullif(spoken, ''), 'hi-IN') END AS language, asked <> '' AND coalesce(no, false) AS refused FROM a""")
def api_replies(spark: SparkSession, sf: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    document = F.struct(
        F.when(c % 3 == 0, "heard").alias("transcription"), F.when(t % 2 == 1, F.col("text")).otherwise("").alias("answer"), F.when(c % 2 == 0, 0.5).alias("confidence"),
        _pick("conv_id", ("en-IN", "", None)).alias("language"), F.when(c % 5 == 0, True).alias("refused"),
    )
    asked = F.when((t == 0) & (c % 4 == 0), "").otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", shaping.reply(document, asked, F.lit("hi-IN")).alias("r")).select("conv_id", "turn", "r.*")


@query(f"""SELECT conv_id, turn, NULL::VARCHAR AS answer, 0::INT AS sources, 0.0::DOUBLE AS confidence, coalesce({_sql_pick("conv_id", ("hi-IN", None))}, 'en-IN') AS language, true AS refused,
  CASE WHEN turn % 2 = 0 THEN 'off_topic' ELSE 'insufficient_context' END AS refusal_reason FROM conversations""")
def refusal_documents(spark: SparkSession, sf: str) -> DataFrame:
    made = shaping.refusal(F.when(F.col("turn") % 2 == 0, "off_topic").otherwise("insufficient_context"), _pick("conv_id", ("hi-IN", None)))
    return table(spark, sf, "conversations").select("conv_id", "turn", made.alias("r")).select("conv_id", "turn", "r.answer", F.size("r.sources").alias("sources"), "r.confidence", "r.language", "r.refused", "r.refusal_reason")


_REQUIRED = ("answer", "sources", "confidence", "language", "refused", "refusal_reason")


@query(f"""SELECT conv_id, turn, array_to_string(list_filter([{", ".join(f"'{k}'" for k in _REQUIRED)}], lambda k: NOT list_contains(CASE WHEN turn % 2 = 0 THEN ['answer', 'extra'] ELSE ['sources', 'refused', 'language'] END, k)), ',') AS missing FROM conversations""")
def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    present = F.when(F.col("turn") % 2 == 0, F.array(F.lit("answer"), F.lit("extra"))).otherwise(F.array(F.lit("sources"), F.lit("refused"), F.lit("language")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(shaping.missing_keys(list(_REQUIRED), present), ",").alias("missing"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'query: ' WHEN conv_id % 3 = 1 THEN 'passage: ' ELSE '' END || text AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN starts_with(t, 'query: ') OR starts_with(t, 'passage: ') THEN t ELSE 'query: ' || t END AS text FROM t""")
def embedder_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(_pick("conv_id", ("query: ", "passage: ", "")), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", shaping.prefixed(t, "query").alias("text"))


_MIMES = ("audio/webm;codecs=opus", "Audio/WAV", "audio/ogg; x", "audio/mp4", "", None)


@query(f"""WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'data:audio/webm;base64,' ELSE '' END || to_base64(encode(text)) AS body, {_sql_pick("conv_id", _MIMES)} AS mime, text FROM conversations)
SELECT conv_id, turn, sha256(from_base64(CASE WHEN contains(body, ',') THEN split_part(body, ',', 2) ELSE body END)) AS digest,
  CASE WHEN lower(coalesce(nullif(mime, ''), 'audio/webm')) LIKE '%webm%' THEN '.webm' WHEN lower(mime) LIKE '%wav%' THEN '.wav' WHEN lower(mime) LIKE '%ogg%' THEN '.ogg' ELSE '.mp4' END AS suffix FROM b""")
def audio_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies, plain or as data URLs, to bytes (their digest) and a file suffix."""
    plain = F.translate(F.base64(F.col("text").cast("binary")), "\r\n", "")
    body = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("data:audio/webm;base64,")).otherwise(F.lit("")), plain)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(shaping.audio_body(body), 256).alias("digest"), shaping.audio_suffix(_pick("conv_id", _MIMES)).alias("suffix"))


@query("SELECT event_id, 'q' || epoch_us(ts) // 1000 AS request_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def request_marks(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", shaping.request_id("q", ts).alias("request_id"), shaping.utc_text(ts).alias("at"))


@query("SELECT 'documents' AS collection, coalesce(lang, '') AS lang, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM documents GROUP BY lang")
def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"))
    return per.select(F.lit("documents").alias("collection"), "lang", "n").join(F.broadcast(per.agg(F.sum("n").alias("total"))), F.lit(True))


@query(r"""WITH w AS (SELECT lang, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE trim(text) <> '')
SELECT lang, 'window' AS strategy, count(*) AS documents, sum(1 + greatest(ceil((len(ws) - 256) / 218.0), 0))::BIGINT AS chunks FROM w GROUP BY lang""")
def ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and chunks of each language."""
    made = chunking.window_chunks(_docs(spark, sf), keep=("lang",))
    return made.groupBy("lang").agg(F.count_if(F.col("chunk_index") == 0).alias("documents"), F.count("*").alias("chunks")).withColumn("strategy", F.lit("window"))


@query("SELECT doc_id, lang, md5(text) AS digest FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE lang = 'de') WHERE i <= 50")
def language_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 rows of a language, by an order of their own."""
    return store.scan(table(spark, sf, "documents"), "lang", "de", "doc_id", 50).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("SELECT vec_id, label FROM embeddings")
def collection_view(spark: SparkSession, sf: str) -> DataFrame:
    """A collection without its vectors: the scan reads the other columns only."""
    return store.without_vectors(table(spark, sf, "embeddings"), "embedding")


@query("SELECT o.o_orderkey AS key, c.c_name AS name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey + o.o_orderkey % 2 * 1000000")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Keys to payloads; a key that isn't stored keeps its row."""
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1_000_000).alias("k"))
    return store.lookup(asked, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k").select("key", "name")


@query("""WITH d AS (SELECT doc_id, substr(md5(doc_id::VARCHAR), 1, 24) AS id, text, lang FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE ('0x' || substr(id, 10, 15))::BIGINT % 2147483648 END AS query_id, md5(text || '?') AS query, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(lang, '') END AS answer,
  'squad://' || CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE 't' || doc_id END AS url, md5(text) AS digest FROM d""")
def squad_records(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of a second source in the shape of question records; ids that aren't hexadecimal are shown as -1 here."""
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(d % 7 == 0, F.concat(F.lit("x"), d.cast("string"))).otherwise(F.substring(F.md5(d.cast("string")), 1, 24)).alias("id"), F.when(d % 4 != 0, F.concat(F.lit("t"), d.cast("string"))).alias("title"),
        F.col("text").alias("context"), F.concat("text", F.lit("?")).alias("question"), F.struct(F.when(d % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.coalesce("lang", F.lit("")))).alias("text")).alias("answers"),
    )
    made = records.from_squad(rows, keep=("doc_id",))
    return made.select("doc_id", F.when(d % 7 == 0, F.lit(-1)).otherwise(F.col("query_id")).alias("query_id"), F.md5("query").alias("query"), F.col("Eng_Answer").alias("answer"), F.get("passages.url", F.lit(0)).alias("url"), F.md5(F.get("passages.Translated_passages", F.lit(0))).alias("digest"))


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS i FROM events WHERE event_type <> 'error' AND value > 1) WHERE i <= 5000")
def cache_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Responses that are neither refused nor empty enter the cache; the newest ones stay."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value", F.when(F.col("value") > 1, F.lit("x")).otherwise("").alias("answer"), (F.col("event_type") == "error").alias("refused"), F.col("event_id").alias("seq"))
    return routing.oldest_out(routing.admitted(e)).select("event_id", "user_id", "value")


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings v JOIN embeddings q ON v.label = q.label AND q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS i FROM p)
SELECT query_id, vec_id, score FROM k WHERE i = 1 AND score >= 0.3 AND (query_id % 3 = 0 OR query_id % 3 = vec_id % 3)""")
def semantic_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest cached entry counts only above the threshold, and in the asked language (0 stands for auto)."""
    from .queries import _neighbours

    names = ("auto", "en", "hi")
    lang = lambda c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 3 + 1).cast("int"))
    best = _neighbours(spark, sf, 1).select("query_id", "vec_id", "score", lang("query_id").alias("lang"), lang("vec_id").alias("entry_lang"))
    return routing.semantic_probe(best, threshold=0.3).select("query_id", "vec_id", "score")


@query("""SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 1e-9), 6) AS norm,
  round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 1e-9), 6) AS first FROM embeddings""")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    u = unit(v)
    dot = F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(dot, 6).alias("norm"), F.round(F.get(u, F.lit(0)), 6).alias("first"))


@query("""WITH t AS (SELECT vec_id // 5 AS text_id, i, avg(x) FILTER (vec_id % 3 > 0) AS m FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY ALL)
SELECT text_id, i::INT AS place, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY text_id)), 1e-9), 9) AS x FROM t""")
def pooled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Five vectors stand for a text's tokens, every third is masked: masked mean pooling to unit vectors."""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("text_id"), F.struct("vec_id", "embedding").alias("t"))
    texts = e.groupBy("text_id").agg(F.array_sort(F.collect_list("t")).alias("t"))  # five rows a text
    v = pooled(F.transform("t", lambda x: x["embedding"]), F.transform("t", lambda x: F.when(x["vec_id"] % 3 > 0, 1).otherwise(0)))
    return texts.select("text_id", F.posexplode(v).alias("place", "x")).select("text_id", "place", F.round("x", 9).alias("x"))


@query("SELECT vec_id, CASE WHEN len(embedding) = 0 THEN 0 ELSE round(least(1, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / 50) * (x::DOUBLE / 50))) / len(embedding)) / 0.01), 9) END::DOUBLE AS p FROM embeddings")
def speech_energy(spark: SparkSession, sf: str) -> DataFrame:
    """The energy of samples, for which a vector stands."""
    return table(spark, sf, "embeddings").select("vec_id", F.round(audio.rms(F.transform("embedding", lambda x: x.cast("double") / 50)), 9).alias("p"))


@query("""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS e, floor(len(embedding) / (44100 / 16000.0::DOUBLE) + 0.5)::INT AS n FROM embeddings)
SELECT vec_id, i::INT AS place, round(list_avg(e[floor(i * 2.75625::DOUBLE + 0.5)::INT + 1 : floor((i + 1) * 2.75625::DOUBLE + 0.5)::INT]), 9) AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM b)""")
def downsampled_audio(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(audio.downsampled(v, 44_100)).alias("place", "x")).select("vec_id", "place", F.round("x", 9).alias("x"))


@query("""WITH c AS (SELECT user_id AS stream_id, event_id AS seq, (event_id % 7 * 400 + 100)::BIGINT AS n FROM events), t AS (SELECT *, sum(n) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM c)
SELECT stream_id, unnest(range((b - n) // 960, b // 960)) AS frame, seq FROM t""")
def audio_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of any size cut into frames; what is left over goes on with the next chunk."""
    return audio.frames(table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 * 400 + 100).alias("n")))


@query("""WITH p AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'தமிழ் ' ELSE '' END || text AS anchored, CASE conv_id % 4 WHEN 1 THEN 'తెలుగు ' ELSE '' END || CASE WHEN turn % 3 = 0 THEN text || '.' WHEN turn % 3 = 1 THEN reverse(text) ELSE split_part(text, ' ', 1) END AS general FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(anchored, '[\\x{0B80}-\\x{0BFF}\\x{0900}-\\x{097F}]') THEN anchored WHEN regexp_matches(general, '[\\x{0C00}-\\x{0C7F}]') THEN general WHEN length(general) > length(anchored) THEN general ELSE anchored END AS winner FROM p""")
def two_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Two transcripts of the same speech, by different calls, to one."""
    c, turn = F.col("conv_id") % 4, F.col("turn") % 3
    heard = F.when(turn == 0, F.concat("text", F.lit("."))).when(turn == 1, F.reverse("text")).otherwise(F.substring_index("text", " ", 1))
    anchored = F.concat(F.when(c == 0, F.lit("தமிழ் ")).otherwise(""), "text")
    general = F.concat(F.when(c == 1, F.lit("తెలుగు ")).otherwise(""), heard)
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.transcript_winner(anchored, general).alias("winner"))


_ASKS = ("", "what ", "tell me how ", "समझाओ ", "x y z a b c why ")


@query(rf"""WITH q AS (SELECT conv_id, turn, {_sql_pick("conv_id", _ASKS)} || CASE WHEN turn % 2 = 0 THEN 'one two three' ELSE text END AS q FROM conversations),
w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(q), '\s+'), lambda x: x <> '') AS w FROM q)
SELECT conv_id, turn, CASE WHEN len(w) <= 4 THEN 'sliding' WHEN list_has_any(w[1:6], ['what', 'how', 'why', 'tell', 'समझाओ']) THEN 'semantic' ELSE 'default' END AS strategy FROM w""")
def strategy_of_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The chunking strategy of short questions, of those that ask for an explanation, and of the rest.

    The words that the texts here can hold are five of the list's.
    """
    q = F.concat(_pick("conv_id", _ASKS), F.when(F.col("turn") % 2 == 0, F.lit("one two three")).otherwise(F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.strategy(q, default="default").alias("strategy"))
