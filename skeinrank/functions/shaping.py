"""Requests, replies, hits and contexts: small projections with the defaults of the interfaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_TAG, LANGUAGE_TAGS
from .text import strip

_HIT = {"text": "", "lang_code": "", "doc_id": "", "query_id": -1, "is_selected": 0, "chunk_type": "", "parent_id": "", "chunk_index": 0}


def asked_language(lang: Column, default: str) -> Column:
    """The first part of a language tag, in lower case; a missing one is the default (auto for caches, en for the pipeline)."""
    return F.lower(strip(F.substring_index(F.substring_index(F.coalesce(lang, F.lit(default)), "-", 1), "_", 1)))


def language_tag(key: Column) -> Column:
    """The speech service's tag of a language key."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_TAGS for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(DEFAULT_TAG))


def chunk_language(lang: Column) -> Column:
    return F.lower(F.substring(F.substring_index(lang, "_", 1), 1, 2))


def cache_key(lang: Column, query: Column) -> Column:
    return F.concat_ws(":", asked_language(lang, "auto"), F.lower(strip(query)))


def hit(payload: Column, score: Column) -> Column:
    """A search hit of a stored payload, with every field's default."""
    rest = [F.coalesce(payload[c], F.lit(v)).alias(c) for c, v in _HIT.items()]
    return F.struct(F.coalesce(payload["original_id"], payload["id"], F.lit("")).alias("id"), score.alias("score"), *rest)


def reply(answer: Column, query: Column, lang: Column) -> Column:
    """The interface's reply to an answer document (null: nothing was asked)."""
    blank = lambda c: F.when(c != "", c)
    made = F.struct(
        F.coalesce(blank(answer["transcription"]), query).alias("transcription"), F.coalesce(blank(answer["answer"]), F.lit("Acknowledged.")).alias("reply"),
        F.coalesce(answer["confidence"], F.lit(0.95)).alias("confidence"), F.coalesce(blank(answer["language"]), lang).alias("language"), F.coalesce(answer["refused"], F.lit(False)).alias("refused"),
    )
    empty = F.struct(F.lit("No query provided").alias("transcription"), F.lit("Please speak or type a question.").alias("reply"), F.lit(0.0).alias("confidence"), F.coalesce(lang, F.lit(DEFAULT_TAG)).alias("language"), F.lit(False).alias("refused"))
    return F.when(F.coalesce(query, F.lit("")) == "", empty).otherwise(made)


def refusal(reason: Column, lang: Column) -> Column:
    """The answer document of a refusal without a call."""
    return F.struct(F.lit(None).cast("string").alias("answer"), F.array().cast("array<string>").alias("sources"), F.lit(0.0).alias("confidence"), F.coalesce(lang, F.lit(DEFAULT_TAG)).alias("language"), F.lit(True).alias("refused"), reason.alias("refusal_reason"))


#: What a question's body may hold.
REQUEST = "query string, message string, textInput string, audioBase64 string, mimeType string, persona string, lang_code string, strategy string"


def request(body: Column) -> Column:
    """A request of any of the three shapes (question, chat, chat with voice) with its defaults; a broken body is null."""
    r = F.from_json(body, REQUEST)
    valid = F.try_parse_json(body).isNotNull()
    kind = F.when(r["query"].isNotNull(), "query").when(r["message"].isNotNull(), "chat").otherwise("voice")
    made = F.struct(
        kind.alias("kind"), F.coalesce(r["query"], r["message"], r["textInput"]).alias("text"), F.when(kind == "voice", r["audioBase64"]).alias("audio"),
        F.when(kind == "voice", F.coalesce(r["mimeType"], F.lit("audio/webm"))).alias("mime"), F.when(kind != "query", F.coalesce(r["persona"], F.lit("brutalist"))).alias("persona"),
        F.when(kind == "query", F.coalesce(r["lang_code"], F.lit("en"))).otherwise(r["lang_code"]).alias("lang"), r["strategy"].alias("strategy"),
    )
    return F.when(valid, made)


def missing_keys(required: list[str], present: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), present)


def prefixed(text: Column, kind: str) -> Column:
    """text with the embedder's mark of a query or passage, unless it has one."""
    done = F.startswith(text, F.lit("query: ")) | F.startswith(text, F.lit("passage: "))
    return F.when(done, text).otherwise(F.concat(F.lit(f"{kind}: "), text))


def audio_body(body: Column) -> Column:
    """The bytes of a base64 body or data URL."""
    parts = F.split(body, ",")
    return F.unbase64(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(body))


def audio_suffix(mime: Column) -> Column:
    kind = F.lower(strip(F.substring_index(F.coalesce(F.when(mime != "", mime), F.lit("audio/webm")), ";", 1)))
    return F.when(F.contains(kind, F.lit("webm")), ".webm").when(F.contains(kind, F.lit("wav")), ".wav").when(F.contains(kind, F.lit("ogg")), ".ogg").otherwise(".mp4")


def source_tag(query_id: Column, lang: Column) -> Column:
    return F.concat(F.lit("msmarco-xi/q"), query_id.cast("string"), F.lit("/"), lang)


def passages(texts: Column) -> Column:
    """Numbered passages of the non-empty texts; a passage keeps the number of its place."""
    numbered = F.transform(texts, lambda x, i: F.when(strip(x) != "", F.concat(F.lit("[Passage "), (i + 1).cast("string"), F.lit("]\n"), strip(x))))
    return F.array_join(F.array_compact(numbered), "\n\n")


def cleaned_thinking(raw: Column) -> Column:
    """What is left of a model's reply without its reasoning, list marks and quotes.

    Where it shows reasoning: what follows the mark of a formulated answer, else the last line that is no list item and
    speaks of no step, else the last line.
    """
    raw = F.coalesce(raw, F.lit(""))
    low = F.lower(raw)
    shows = F.contains(low, F.lit("thinking process")) | F.contains(low, F.lit("**analyze")) | F.contains(low, F.lit("<think>"))
    cut = F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")
    after = F.regexp_extract(cut, r"(?is)\*\*Formulate Answer:?\*\*\s*[\r\n]+(.+)$", 1)
    lines = F.filter(F.transform(F.split(cut, "\n"), strip), lambda x: x != "")
    steps = ("thinking process", "analyze", "determine", "formulate")
    listed = lambda x: F.rlike(x, F.lit(r"^(?:[1-5]\.|[-*#])"))
    meta = lambda x: F.exists(F.array(*map(F.lit, steps)), lambda s: F.contains(F.lower(x), s))
    plain = F.filter(lines, lambda x: ~listed(x) & ~meta(x))
    last = F.when(F.size(plain) > 0, F.element_at(plain, -1)).when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(cut)
    text = F.when(~shows, raw).when(after != "", strip(after)).otherwise(last)
    return strip(F.regexp_replace(F.regexp_replace(text, r"""^[-\s*•"'`:]+""", ""), r"""["'`]+$""", ""))


def request_id(prefix: str, at: Column) -> Column:
    """prefix and the milliseconds of a time."""
    return F.concat(F.lit(prefix), F.unix_millis(at).cast("string"))


def utc_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
