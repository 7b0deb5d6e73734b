"""Answer documents: repair of model output, context and verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shaping import cleaned_thinking
from ..functions.text import strip

#: Fixed value: the form of a prompt.
PROMPT = """USER QUERY:
%s

CONTEXT PASSAGES:
%s

Remember: Respond with ONLY valid JSON matching the required schema. No other text."""
ANSWER = "struct<answer:string,sources:array<string>,confidence:double,language:string,refused:boolean,refusal_reason:string>"


#: Options under which only JSON itself is read.
_STRICT = {"allowSingleQuotes": "false"}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _is_object(text: Column) -> Column:
    """Whether text is one JSON object to its end: as a member beside a mark it is read whole, and the mark after it."""
    framed = F.concat(F.lit('{"v":'), text, F.lit(',"e":1}'))
    read = F.from_json(framed, "v string, e int", _STRICT)
    return F.startswith(text, F.lit("{")) & (F.json_object_keys(framed) == F.array(F.lit("v"), F.lit("e"))) & read["v"].isNotNull() & (read["e"] == 1)


def _bare(raw: Column) -> Column:
    """What follows the reasoning, out of its fence, from the first { to the last }."""
    after = lambda t, mark: strip(F.substring(t, F.instr(t, F.lit(mark)) + F.lit(len(mark)), F.length(t)))
    spoken = _let(raw, lambda t: F.when(F.contains(t, F.lit("</think>")), after(t, "</think>")).when(F.contains(t, F.lit("<think>")), after(t, "<think>")).otherwise(t))
    unnamed = lambda p: F.when(F.startswith(p, F.lit("json")), strip(F.substring(p, F.lit(5), F.length(p)))).otherwise(p)
    parts = lambda t: F.transform(F.transform(F.split(t, "```"), strip), unnamed)
    fenced = lambda t: F.get(F.filter(parts(t), lambda p: F.startswith(p, F.lit("{")) & F.endswith(p, F.lit("}"))), F.lit(0))
    unfenced = _let(spoken, lambda t: F.coalesce(F.when(F.contains(t, F.lit("```")), fenced(t)), t))
    return _let(unfenced, lambda t: _let(F.regexp_extract(t, r"(?s)\{.*\}", 0), lambda c: F.when(c != "", c).otherwise(t)))


def _loose_answer(text: Column) -> Column:
    """The answer of broken JSON, its escapes read where they are sound; null without one."""
    closed, open_ = r'"answer"\s*:\s*"((?:[^"\\]|\\[^\n])*+)"', r'"answer"\s*:\s*"([^"]+)'
    found = F.when(F.rlike(text, F.lit(closed)), F.regexp_extract(text, closed, 1)).when(F.rlike(text, F.lit(open_)), F.regexp_extract(text, open_, 1))
    trimmed = strip(F.rtrim(strip(found), F.lit('",}')))
    read = lambda t: F.from_json(F.concat(F.lit('{"s":"'), t, F.lit('"}')), "s string", _STRICT | {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"})["s"]
    escaped = lambda t: F.contains(t, F.lit("\\u")) | F.contains(t, F.lit("\\n"))
    return _let(trimmed, lambda t: F.when(escaped(t), F.coalesce(read(t), t)).otherwise(t))


def repaired(raw: Column, language: Column | str = "en") -> Column:
    """The answer document of a model's raw output, whatever state it is in; language: the asked one, for documents that name none.

    One JSON object gives its fields, missing ones their defaults (fields that are null stay null). Broken JSON gives the answer found by pattern,
    with the ids in quotes as sources; text under 300 characters is an answer; the rest is refused. Answers are cleaned of reasoning. Escapes
    in answers found by pattern are read as JSON's; characters beyond ASCII beside them stay what they are.
    """
    lang = F.lit(language) if isinstance(language, str) else language

    def made(answer: Column, sources: Column, confidence: float, refused: bool, reason: str | None) -> Column:
        return F.struct(answer.alias("answer"), sources.alias("sources"), F.lit(confidence).alias("confidence"), lang.alias("language"), F.lit(refused).alias("refused"), F.lit(reason).cast("string").alias("refusal_reason"))

    none, empty, general = F.lit(None).cast("string"), F.array().cast("array<string>"), F.array(F.lit("general_knowledge"))

    def full(text: Column) -> Column:
        def patched(doc: Column, keys: Column) -> Column:
            absent = lambda name, value: F.when(F.array_contains(keys, name), doc[name]).otherwise(value).alias(name)
            answer = F.when(doc["answer"] != "", cleaned_thinking(doc["answer"])).otherwise(doc["answer"])
            return F.struct(answer.alias("answer"), absent("sources", empty), absent("confidence", F.lit(0.0)), absent("language", lang), absent("refused", F.lit(False)), doc["refusal_reason"].alias("refusal_reason"))

        return _let(F.struct(F.from_json(text, ANSWER, _STRICT).alias("doc"), F.json_object_keys(text).alias("keys")), lambda x: patched(x["doc"], x["keys"]))

    def broken(text: Column) -> Column:
        ids = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r'"(q\d+_p\d+|general_knowledge)"'), F.lit(1)))
        sources = _let(ids(text), lambda x: F.when(F.size(x) > 0, x).otherwise(general))
        direct = lambda t: F.when((t != "") & (F.length(t) < 300) & ~F.startswith(t, F.lit("{")), made(t, general, 0.9, False, None)).otherwise(made(none, empty, 0.0, True, "parse_error"))
        loose = lambda a: F.when(a.isNotNull(), made(cleaned_thinking(a), sources, 0.95, False, None)).otherwise(_let(cleaned_thinking(text), direct))
        return _let(_loose_answer(text), loose)

    whole = lambda t: F.when(t == "", made(none, empty, 0.0, True, "insufficient_context")).otherwise(_let(_bare(t), lambda x: F.when(_is_object(x), full(x)).otherwise(broken(x))))
    return _let(strip(F.coalesce(raw, F.lit(""))), whole)


def verdict(raw: Column) -> Column:
    """The boolean verdict of a judge's JSON; anything else counts as false."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.verdict", "boolean"), F.lit(False))


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query (query_id, text): the prompt with its numbered passages; hits (query_id, doc_id, text, lang, score, rank) are few for each."""
    line = F.format_string("(doc_id=%s, lang=%s, relevance=%.3f)", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("??")), F.coalesce("score", F.lit(0.0)))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(line, F.lit("\n"), strip(F.coalesce("text", F.lit("")))).alias("line")))).alias("lines"))
    numbered = F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("[PASSAGE "), (i + 1).cast("string"), F.lit("] "), x["line"])), "\n\n")
    asked = F.format_string(PROMPT, F.col("text"), F.coalesce(numbered, F.lit("[NO CONTEXT AVAILABLE]")))
    return queries.join(listed, "query_id", "left").select("query_id", asked.alias("prompt"))
