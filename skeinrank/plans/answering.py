"""Queries of what goes between services: requests, transcript messages, and models' replies in whatever state they come.

The tables' texts are put whole into JSON, with quotes and backslashes among their words, so that the parsers meet escapes, line feeds and
characters beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shaping
from ..operators import answers
from ..sources.store import table
from ..streaming import voice
from .registry import query

_S = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: The texts with quotes and backslashes behind their commas.
_QUOTED = """replace(text, ', ', ', "\\" ')"""


def _said(spark: SparkSession, sf: str, *columns: Column) -> DataFrame:
    """conv_id, turn, t: the quoted texts of the conversations, and columns made of these."""
    c = table(spark, sf, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.replace("text", F.lit(", "), F.lit(', "\\" ')).alias("t")).select("conv_id", "turn", "t", *columns)


def _turned(by: Column, forms: tuple[Column, ...]) -> Column:
    """forms in turn, by a number from 0."""
    chosen = F.when(by % len(forms) == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        chosen = chosen.when(by % len(forms) == i, form)
    return chosen


def _json(**fields: Column | str | float | None) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


@query(f"""WITH t AS (SELECT conv_id, turn, {_QUOTED} AS t, turn % 5 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'query' WHEN 1 THEN 'chat' ELSE 'voice' END AS kind, CASE WHEN k < 3 THEN t END AS text, CASE WHEN k = 3 THEN 'YWI=' END AS audio, CASE WHEN k = 2 THEN 'audio/webm' WHEN k = 3 THEN 'audio/wav' END AS mime,
  CASE k WHEN 1 THEN 'calm' WHEN 2 THEN 'brutalist' WHEN 3 THEN 'brutalist' END AS persona, CASE k WHEN 0 THEN 'en' WHEN 1 THEN 'hi-IN' END AS lang, CASE WHEN k = 0 THEN 'sliding' END AS strategy FROM t WHERE k < 4""")
def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of each of the interface's shapes to requests; broken ones are left out."""
    t = F.col("t")
    forms = (_json(query=t, strategy="sliding"), _json(message=t, persona="calm", lang_code="hi-IN"), _json(textInput=t, history=F.array()), _json(audioBase64="YWI=", mimeType="audio/wav", n=t), F.concat(F.lit('{"query": "'), t))
    return _said(spark, sf, shaping.request(_turned(F.col("turn"), forms)).alias("r")).where("r is not null").select("conv_id", "turn", "r.*")


@query(f"""WITH x AS (SELECT conv_id AS session_id, turn AS seq, {_QUOTED} AS t, CASE WHEN turn % 6 IN (0, 1, 4) THEN 1 WHEN turn % 6 IN (2, 5) THEN 2 ELSE 0 END AS kind FROM conversations),
l AS (SELECT session_id, kind, arg_max(t, seq) AS t FROM x WHERE kind = 1 OR (kind = 2 AND t <> '') GROUP BY session_id, kind)
SELECT session_id, max(t) FILTER (kind = 1) AS partial, max(t) FILTER (kind = 2) AS final FROM l GROUP BY session_id""")
def transcript_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages in each form of the speech service, also broken ones, to each session's last partial and final text."""
    t = F.col("t")
    forms = (
        _json(event="transcript.partial", transcript=t), _json(transcript=t), _json(event="transcript.final", transcript=t), F.concat(F.lit('{"transcript": "'), t),
        _json(transcript=t, is_final=False, x=1), _json(type="data", data=F.struct(t.alias("transcript"))),
    )
    return voice.transcripts(voice.messages(_said(spark, sf, _turned(F.col("turn"), forms).alias("body")).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "body")))


def _cleaned(source: str) -> str:
    """SQL that cleans raw of source (conv_id, turn, raw) of reasoning: the last of its tables is `cleaned`, with text."""
    return rf"""clean_cut AS (SELECT conv_id, turn, raw, regexp_replace(raw, '<think>.*?</think>', '', 'gis') AS cut, contains(lower(raw), 'thinking process') OR contains(lower(raw), '**analyze') OR contains(lower(raw), '<think>') AS shows FROM {source}),
clean_lines AS (SELECT *, regexp_extract(cut, '\*\*Formulate Answer:?\*\*\s*[\r\n]+(.+)$', 1, 'is') AS after, list_filter(list_transform(string_split(cut, chr(10)), lambda x: {_S.format("x")}), lambda x: x <> '') AS lines FROM clean_cut),
clean_plain AS (SELECT *, list_filter(lines, lambda x: NOT regexp_matches(x, '^([1-5]\.|[-*#])') AND NOT regexp_matches(lower(x), 'thinking process|analyze|determine|formulate')) AS plain FROM clean_lines),
clean_text AS (SELECT conv_id, turn, CASE WHEN NOT shows THEN raw WHEN after <> '' THEN {_S.format("after")} WHEN len(plain) > 0 THEN plain[-1] WHEN len(lines) > 0 THEN lines[-1] ELSE cut END AS x FROM clean_plain),
cleaned AS (SELECT conv_id, turn, {_S.format('''regexp_replace(regexp_replace(x, '^[-\\s*•"''`:]+', ''), '["''`]+$', '')''')} AS text FROM clean_text)"""


_THOUGHTS = ("{t}", "<think>hm {t}</think>- \"{t}\"", "Thinking Process:\n1. Analyze {t}\nIt is so.\n2. {t}", "**Analyze** x\n**Formulate Answer:**\n\n* {t}", "thinking process\n- a\n- {t}")


def _sql_thoughts() -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{t}", "' || t || '") + "'" for x in _THOUGHTS) + "]"


@query(f"WITH t AS (SELECT conv_id, turn, {_QUOTED} AS t FROM conversations), r AS (SELECT conv_id, turn, ({_sql_thoughts()})[(conv_id % 5 + 1)::INT] AS raw FROM t), {_cleaned('r')} SELECT * FROM cleaned")
def cleaned_thinking(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with their reasoning, in every form it is shown in, cleaned."""
    forms = tuple(F.replace(F.lit(x), F.lit("{t}"), F.col("t")) for x in _THOUGHTS)
    return _said(spark, sf, shaping.cleaned_thinking(_turned(F.col("conv_id"), forms)).alias("text")).drop("t")


#: Forms 0, 1, 3 and 10 are one JSON object; 2, 4, 7 and 8 are broken, with the answer in a (escaped, or open in 7); 5 is beyond repair; 6 and 9 are text.
@query(rf"""WITH m AS (SELECT conv_id, turn, {_QUOTED} AS t, (conv_id + turn) % 11 AS k FROM conversations),
e AS (SELECT *, substr(to_json(t)::VARCHAR, 2, length(to_json(t)::VARCHAR) - 2) AS escaped FROM m),
o AS (SELECT *, {_S.format('''rtrim(''' + _S.format("CASE WHEN k = 7 THEN replace(t, '\"', '') ELSE escaped END") + ''', '",}')''')} AS open FROM e),
a AS (SELECT conv_id, turn, k, CASE WHEN k IN (0, 1, 3) THEN t WHEN k = 10 THEN 'Thinking process: 1' || chr(10) || '- x' || chr(10) || t WHEN k IN (2, 4, 7, 8) THEN CASE WHEN (contains(open, '\u') OR contains(open, '\n')) AND json_valid('"' || replace(open, chr(10), '\n') || '"')
    THEN ('"' || replace(open, chr(10), '\n') || '"')::JSON ->> '$' ELSE open END WHEN k = 6 THEN {_S.format("t")} WHEN k = 9 THEN 'Thinking process: 1' || chr(10) || '- x' || chr(10) || {_S.format("t")} ELSE '' END AS raw FROM o), {_cleaned('a')}
SELECT conv_id, turn, CASE WHEN k IN (0, 1, 2, 3, 4, 7, 8, 10) OR k IN (6, 9) AND length(text) BETWEEN 1 AND 299 THEN text END AS answer,
  CASE WHEN k IN (0, 10) THEN 0.5 WHEN k IN (2, 4, 7, 8) THEN 0.95 WHEN k IN (6, 9) AND length(text) BETWEEN 1 AND 299 THEN 0.9 ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN k = 0 THEN 'fr' ELSE coalesce((['hi-IN', NULL, 'de'])[(turn % 3 + 1)::INT], 'en-IN') END AS language, k = 5 OR k IN (6, 9) AND length(text) NOT BETWEEN 1 AND 299 AS refused,
  CASE WHEN k = 5 OR k IN (6, 9) AND length(text) NOT BETWEEN 1 AND 299 THEN 'parse_error' WHEN k = 10 THEN 'none' END AS refusal_reason,
  CASE k WHEN 0 THEN 'q1_p2,q3_p4' WHEN 2 THEN 'q7_p0' WHEN 4 THEN 'general_knowledge' WHEN 7 THEN 'general_knowledge' WHEN 8 THEN 'q3_p1,general_knowledge' WHEN 10 THEN NULL
    ELSE CASE WHEN k IN (6, 9) AND length(text) BETWEEN 1 AND 299 THEN 'general_knowledge' ELSE '' END END AS sources FROM cleaned JOIN a USING (conv_id, turn)""")
def answer_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A model's replies to answer documents: whole JSON in a fence, with keys missing behind a closed and an open think tag, with null
    fields and reasoning in the answer, cut off, with matter behind it, with an open string, beyond repair, and as text with and without reasoning."""
    t = F.col("t")
    escaped = F.regexp_extract(F.to_json(F.struct(t.alias("t"))), r'(?s)^\{"t":"(.*)"\}$', 1)
    parts = lambda *x: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in x])
    ids = F.array(F.lit("q1_p2"), F.lit("q3_p4"))
    forms = (
        parts("```json\n", _json(answer=t, sources=ids, confidence=0.5, language="fr", refused=False, refusal_reason=None), "\n``` done"), parts('<think>hm {"answer": "no"}</think> ', _json(answer=t), " bye"), parts('{"answer": "', escaped, '", "sources": ["q7_p0"'),
        parts('<think>unclosed {"answer": "', escaped, '"}'), parts(_json(answer=t, confidence=0.5), ' and {"b": 1}'), parts("{nothing of use: ", t), t, parts('{"answer": "', F.replace(t, F.lit('"'), F.lit(""))),
        parts('Of "q3_p1", "general_knowledge", "q3_p1" and q5_p5: "answer" : "', escaped, '" '), parts("Thinking process: 1\n- x\n", t), _json(answer=parts("Thinking process: 1\n- x\n", t), sources=None, confidence=0.5, refused=False, refusal_reason="none"),
    )
    lang = F.coalesce(_turned(F.col("turn"), (F.lit("hi-IN"), F.lit(None).cast("string"), F.lit("de"))), F.lit("en-IN"))
    a = _said(spark, sf, answers.repaired(_turned(F.col("conv_id") + F.col("turn"), forms), lang).alias("a"))
    return a.select("conv_id", "turn", "a.answer", "a.confidence", "a.language", "a.refused", "a.refusal_reason", F.array_join("a.sources", ",").alias("sources"))
