"""Queries of the evaluation family: examples, gold chunks, and the checks' reports, over records made of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, REFUSALS
from ..functions import text as tx
from ..functions.vectors import axes_matrix, hash_axes, unit_rows
from ..operators import answers, evaluation, records, reports, retrieval
from ..sources.store import records as flat_records
from ..sources.store import table
from ..sources.work import written
from .queries import _BUCKET, _WORDS
from .registry import query

LANGS = ("hin_Deva", "tam_Taml", "ben_Beng")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question record of each conversation: its turns are the passages, "> " marks the translation, some are picked.

    Every eleventh lacks a translated passage, every third has no answer, every seventh an empty one.
    """
    c = table(spark, sf, "conversations").where("text is not null")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    by = lambda role: F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: x["text"])
    en = F.transform("t", lambda x: x["text"])
    hi = F.transform(en, lambda x: F.concat(F.lit("> "), x))
    asked = F.get(by("user"), F.lit(0))
    said = F.try_element_at(by("assistant"), F.lit(-1))
    answer = F.when(F.col("conv_id") % 3 == 0, F.lit("No Answer Present.")).when(F.col("conv_id") % 7 == 0, F.lit("")).otherwise(said)
    passages = F.struct(
        F.when(F.col("conv_id") % 11 == 0, F.slice(hi, 1, F.greatest(F.size(hi) - 1, F.lit(0)))).otherwise(hi).alias("Translated_passages"), en.alias("English_passages"),
        F.transform("t", lambda x: F.when((F.col("conv_id") + x["turn"]) % 5 == 0, 1).otherwise(0)).alias("is_selected"),
    )
    lang = F.element_at(F.array(*map(F.lit, LANGS)), (F.col("conv_id") % 3 + 1).cast("int"))
    return turns.select(F.col("conv_id").alias("query_id"), F.concat(F.lit("> "), asked).alias("query"), asked.alias("Eng_Query"), answer.alias("Eng_Answer"), lang.alias("target_lang"), passages.alias("passages"), said.alias("said"))


_S = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_QUESTIONS = f"""t AS (SELECT conv_id AS query_id, list(text ORDER BY turn) AS en, list('> ' || text ORDER BY turn) AS hi0, list(CASE WHEN (conv_id + turn) % 5 = 0 THEN 1 ELSE 0 END ORDER BY turn) AS sel,
  first(text ORDER BY turn) FILTER (role = 'user') AS asked, last(text ORDER BY turn) FILTER (role = 'assistant') AS said FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
q AS (SELECT *, CASE WHEN query_id % 11 = 0 THEN hi0[1 : len(hi0) - 1] ELSE hi0 END AS hi, CASE WHEN query_id % 3 = 0 THEN 'No Answer Present.' WHEN query_id % 7 = 0 THEN '' ELSE said END AS answer,
  (['hin_Deva', 'tam_Taml', 'ben_Beng'])[(query_id % 3 + 1)::INT] AS target_lang FROM t)"""
_EXAMPLES = f"""{_QUESTIONS}, p AS (SELECT *, nullif(coalesce(list_position(sel, 1), 0), 0) AS pos, {_S.format("coalesce(answer, '')")} AS a, {_S.format("coalesce(asked, '')")} AS qe FROM q),
e AS (SELECT query_id, qe AS query_en, {_S.format("'> ' || asked")} AS query_hi, pos IS NOT NULL AS is_answerable, CASE WHEN pos IS NOT NULL THEN a END AS gt_answer_en, (pos - 1)::INT AS gt_passage_index, en, hi, said
  FROM p WHERE qe <> '' AND len(en) > 0 AND len(hi) = len(en) AND ((pos IS NOT NULL AND lower(a) NOT IN ('no answer present.', '') AND en[pos] <> '') OR (pos IS NULL AND lower(a) IN ('no answer present.', ''))))"""


@query(f"""WITH {_QUESTIONS} SELECT query_id, (k - 1)::INT AS idx, left(target_lang, 2) AS lang_code, hi[k] AS text, coalesce(sel[k], 0)::INT AS is_selected
  FROM (SELECT *, unnest(range(1, len(hi) + 1)) AS k FROM q) WHERE trim(hi[k]) <> ''""")
def nested_passages(spark: SparkSession, sf: str) -> DataFrame:
    return flat_records(questions(spark, sf))


@query(f"WITH {_EXAMPLES} SELECT query_id, query_en, query_hi, is_answerable, gt_answer_en, gt_passage_index, len(en)::INT AS candidates, md5(array_to_string(hi, '|')) AS digest FROM e")
def question_examples(spark: SparkSession, sf: str) -> DataFrame:
    ex = records.examples(questions(spark, sf))
    return ex.select("query_id", "query_en", "query_hi", "is_answerable", "gt_answer_en", "gt_passage_index", F.size("candidates_en").alias("candidates"), F.md5(F.array_join("candidates_hi", "|")).alias("digest"))


@query(f"WITH {_EXAMPLES} SELECT query_id, is_answerable FROM (SELECT *, row_number() OVER (PARTITION BY is_answerable ORDER BY md5(query_id || ':42'), query_id) AS i FROM e) WHERE i <= 25")
def example_sample(spark: SparkSession, sf: str) -> DataFrame:
    """25 answerable and 25 unanswerable examples, the same for a seed."""
    return evaluation.sample(records.examples(questions(spark, sf)), "is_answerable", "query_id", 25, 42).select("query_id", "is_answerable")


_GOLD = f"""{_EXAMPLES}, s AS (SELECT query_id, gt_passage_index, 'en' AS lang, en AS texts FROM e UNION ALL SELECT query_id, gt_passage_index, 'hi', hi FROM e),
x AS (SELECT query_id, lang, (k - 1)::INT AS passage, coalesce(k - 1 = gt_passage_index, false) AS is_selected, {_S.format("texts[k]")} AS t FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS k FROM s)),
y AS (SELECT *, list_filter(list_transform(range(0, greatest(ceil((length(t) - 400) / 340.0), 0)::BIGINT + 1), lambda i: {_S.format("substr(t, i * 340 + 1, 400)")}), lambda v: v <> '') AS l FROM x),
g AS (SELECT query_id, lang, passage, is_selected, (k - 1)::INT AS chunk_index, l[k] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM y))"""


@query(f"WITH {_GOLD} SELECT * FROM g")
def gold_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return records.gold_chunks(records.examples(questions(spark, sf)))


#: Chunks are numbered in an order of their own, which settles ties.
_NUMBER = "(query_id * 2 + (lang = 'hi')::INT) * 1000000 + passage * 1000 + chunk_index"
_CELLS = """{0} AS (SELECT id, bucket, CASE WHEN bucket % 2 = 0 THEN n ELSE -n END / sqrt(sum(n * n) OVER (PARTITION BY id)) AS value FROM
  (SELECT id, {1} AS bucket, count(*) AS n FROM (SELECT id, unnest({2}) AS w FROM {3}) GROUP BY ALL))"""
_HITS = f"""{_GOLD}, gi AS (SELECT *, {_NUMBER} AS id FROM g), gq AS (SELECT query_id * 2 + s AS id, CASE WHEN s = 0 THEN query_en ELSE query_hi END AS text FROM e, range(2) r(s)),
{_CELLS.format("gc", _BUCKET, _WORDS.format("lower(text)"), "gi")}, {_CELLS.format("qc", _BUCKET, _WORDS.format("lower(text)"), "gq")},
sc AS (SELECT qc.id AS qid, gc.id AS gid, round(sum(qc.value * gc.value), 9) AS score FROM gc JOIN qc USING (bucket) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, gid) AS rank FROM sc),
h AS (SELECT qid // 2 AS query_id, CASE WHEN qid % 2 = 0 THEN 'en' ELSE 'hi' END AS side, rank, gi.query_id AS hit_query_id, gi.lang AS hit_lang, gi.is_selected, score FROM rk JOIN gi ON gi.id = gid WHERE rank <= 5)"""


def asked_examples(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, query_en, query_hi, is_answerable of the examples, written: they are read in several places, their passages in one."""
    return written(records.examples(questions(spark, sf)).select("query_id", "query_en", "query_hi", "is_answerable"), "examples")


def hits(spark: SparkSession, sf: str, ex: DataFrame, english: bool = False) -> DataFrame:
    """The five gold chunks nearest to each example's question, asked in both languages or in English only; ex: `asked_examples`.

    Chunks and questions are written once as the axes of their words, as blocks of questions read all chunks in turn.
    """
    dims = DEFAULT.dims
    g = records.gold_chunks(records.examples(questions(spark, sf))).withColumn("id", F.expr("(query_id * 2 + int(lang = 'hi')) * 1000000 + passage * 1000 + chunk_index"))
    g = written(g.select("id", F.lit("").alias("grp"), hash_axes(dims)(F.col("text")).alias("v"), "query_id", "lang", "is_selected"), "gold-chunks")
    sides = F.posexplode(F.array("query_en") if english else F.array("query_en", "query_hi")).alias("side", "text")
    asked = ex.select("query_id", sides).select((F.col("query_id") * 2 + F.col("side")).alias("query_id"), F.lit(None).cast("string").alias("grp"), hash_axes(dims)(F.col("text")).alias("q"))
    made = lambda axes: unit_rows(axes_matrix(axes, dims))
    found = retrieval.nearest(g.select("id", "grp", "v"), written(asked, "questions"), 5, lambda b: made(b["v"].to_pylist()), made=made)
    side = F.when(F.col("f.query_id") % 2 == 0, F.lit("en")).otherwise(F.lit("hi"))
    return found.alias("f").join(g.drop("v").alias("g"), "id").select(
        F.floor(F.col("f.query_id") / 2).alias("query_id"), side.alias("side"), (F.col("rank") + 1).alias("rank"), F.col("g.query_id").alias("hit_query_id"), F.col("g.lang").alias("hit_lang"), "is_selected", "score",
    )


def _at(k: int) -> str:
    return f"round(count(*) FILTER (r <= {k}) / greatest(count(*), 1)::DOUBLE, 4) AS recall_{k}"


@query(f"""WITH {_HITS}, b AS (SELECT query_id, min(rank) AS cross_lingual, min(rank) FILTER (hit_lang = side) AS same_language FROM h WHERE is_selected AND hit_query_id = query_id GROUP BY query_id),
v AS (SELECT unnest(['cross_lingual', 'same_language']) AS variant, unnest([cross_lingual, same_language]) AS r FROM (SELECT query_id FROM e WHERE is_answerable) a LEFT JOIN b USING (query_id))
SELECT variant, count(*) AS n, round(coalesce(sum(1.0::DOUBLE / r), 0) / greatest(count(*), 1), 4) AS mrr, {_at(1)}, {_at(3)}, {_at(5)} FROM v GROUP BY variant""")
def retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    ex = asked_examples(spark, sf)
    return reports.retrieval_report(ex.withColumn("error", F.lit(None).cast("string")), hits(spark, sf, ex), 5)


@query(f"WITH {_HITS} SELECT query_id, coalesce(max(score), 0) AS best, coalesce(max(score), 0) < 0.35 AS refused FROM e LEFT JOIN (SELECT query_id, score FROM h WHERE side = 'en') USING (query_id) GROUP BY query_id")
def grounding_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Questions whose best passage scores under a threshold are refused; the default threshold refuses negative ones only."""
    ex = asked_examples(spark, sf)
    english = hits(spark, sf, ex, english=True).select("query_id", "score")
    return evaluation.grounding(ex.select("query_id").join(english, "query_id", "left"), threshold=0.35)


@query(f"WITH {_HITS} SELECT query_id, CASE WHEN count(*) FILTER (hit_query_id = query_id AND is_selected) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM h WHERE side = 'en' GROUP BY query_id")
def gold_hit(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a question's passages include a picked one: two sets of ids that overlap."""
    found = hits(spark, sf, asked_examples(spark, sf), english=True).select("query_id", F.concat_ws("/", "hit_query_id", "is_selected").alias("doc_id"))
    gold = found.select("query_id", F.array(F.concat_ws("/", "query_id", F.lit("true"))).alias("gold")).distinct()
    return evaluation.gold_hit(found, gold)


_PHRASES = ", ".join("'" + p.replace("'", "''") + "'" for p in REFUSALS)
#: Results: the answer is the last assistant turn, every fourth a refusal; one run in eight failed; the judge's raw words follow the question's number.
_RESULTS = f"""{_EXAMPLES}, r AS (SELECT query_id, query_en, is_answerable, gt_answer_en, CASE WHEN query_id % 4 = 0 THEN 'I cannot answer that. ' ELSE '' END || coalesce(said, '') AS answer,
  CASE WHEN query_id % 8 = 1 THEN 'timeout ' || query_id END AS error, query_id % 5 IN (0, 1, 3) AS verdict FROM e),
x AS (SELECT *, NOT (trim(answer) = '' OR len(list_filter([{_PHRASES}], lambda p: contains(lower(answer), p))) > 0) AS grounded FROM r)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    ex = records.examples(q).join(q.select("query_id", "said"), "query_id")
    answer = F.concat(F.when(F.col("query_id") % 4 == 0, F.lit("I cannot answer that. ")).otherwise(F.lit("")), F.coalesce("said", F.lit("")))
    words = F.array(*map(F.lit, ('{"verdict": true, "reason": "yes"}', '{"reason": "x", "verdict": true}', "not json", '{"verdict": true}', '{"verdict": false}')))
    raw = F.element_at(words, (F.col("query_id") % 5 + 1).cast("int"))
    out = ex.select("query_id", "query_en", "is_answerable", "gt_answer_en", answer.alias("answer"), F.when(F.col("query_id") % 8 == 1, F.concat(F.lit("timeout "), F.col("query_id").cast("string"))).alias("error"), raw.alias("raw"))
    return out.withColumns({"grounded": ~tx.refused(F.col("answer")), "verdict": answers.verdict(F.col("raw"))})


@query(f"""WITH {_RESULTS} SELECT count(*) FILTER (is_answerable) AS answerable, count(*) FILTER (NOT is_answerable) AS unanswerable,
  round(count(*) FILTER (is_answerable AND NOT grounded) / greatest(count(*) FILTER (is_answerable), 1)::DOUBLE, 4) AS false_refusal,
  round(count(*) FILTER (NOT is_answerable AND grounded) / greatest(count(*) FILTER (NOT is_answerable), 1)::DOUBLE, 4) AS false_confidence FROM x WHERE error IS NULL""")
def reliability_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.reliability(results(spark, sf).where("error is null").withColumnRenamed("is_answerable", "answerable"))


@query(f"""WITH {_RESULTS}, k AS (SELECT *, row_number() OVER (PARTITION BY is_answerable ORDER BY query_id) AS place FROM x WHERE error IS NULL AND is_answerable <> grounded)
SELECT is_answerable, place::INT AS place, query_id, query_en, left(CASE WHEN is_answerable THEN gt_answer_en ELSE answer END, 200) AS detail FROM k WHERE place <= 5""")
def reliability_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Up to five false refusals and five false confidences."""
    wrong = records.first(results(spark, sf).where("error is null and is_answerable <> grounded"), "is_answerable", ["query_id"], 5)
    return wrong.select("is_answerable", "place", "query_id", "query_en", F.left(F.when(F.col("is_answerable"), F.col("gt_answer_en")).otherwise(F.col("answer")), F.lit(200)).alias("detail"))


@query(f"""WITH {_RESULTS} SELECT count(*) AS num_evaluated, round(count(*) FILTER (verdict) / count(*)::DOUBLE, 4) AS faithful_rate, round(1 - count(*) FILTER (verdict) / count(*)::DOUBLE, 4) AS hallucination_rate,
  count(*) FILTER (grounded) AS num_confident_answers, round(1 - count(*) FILTER (grounded AND NOT verdict) / greatest(count(*) FILTER (grounded), 1)::DOUBLE, 4) AS self_report_precision FROM x WHERE error IS NULL AND answer <> ''""")
def faithfulness_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.faithfulness(results(spark, sf).where("error is null and answer <> ''").withColumn("judge_error", F.lit(None).cast("string")))


@query(f"WITH {_RESULTS} SELECT count(*) AS num_evaluated, round(count(*) FILTER (verdict) / greatest(count(*), 1)::DOUBLE, 4) AS correct_rate FROM x WHERE error IS NULL AND is_answerable AND answer <> ''")
def correctness_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.correctness(results(spark, sf).where("error is null and is_answerable and answer <> ''").withColumn("judge_error", F.lit(None).cast("string")))


@query(f"WITH {_RESULTS}, k AS (SELECT query_id, error, count(*) OVER () AS errors, row_number() OVER (ORDER BY query_id) AS place FROM x WHERE error IS NOT NULL) SELECT query_id, left(error, 120) AS error, errors FROM k WHERE place <= 5")
def error_report(spark: SparkSession, sf: str) -> DataFrame:
    """The number of failed runs with the first five."""
    failed = results(spark, sf).where("error is not null").select("query_id", F.left("error", F.lit(120)).alias("error"))
    return failed.orderBy("query_id").limit(5).join(F.broadcast(failed.agg(F.count("*").alias("errors"))), F.lit(True))


@query(f"WITH {_HITS} SELECT query_id, string_agg('[Passage ' || rank || ']' || chr(10) || 'msmarco-xi/q' || hit_query_id || '/' || hit_lang, chr(10) || chr(10) ORDER BY rank) AS context FROM h WHERE side = 'en' GROUP BY query_id")
def source_context(spark: SparkSession, sf: str) -> DataFrame:
    """A question's numbered passages, here their source tags."""
    from ..functions import shaping

    few = hits(spark, sf, asked_examples(spark, sf), english=True).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", shaping.source_tag(F.col("hit_query_id"), F.col("hit_lang")).alias("tag")))).alias("h"))  # five a question
    return few.select("query_id", shaping.passages(F.transform("h", lambda x: x["tag"])).alias("context"))


_KINDS = """r AS (SELECT value AS embed_ms_en, value % 7 AS search_ms_en, value * 0.5 AS embed_ms_hi, value % 5 AS search_ms_hi, CASE WHEN event_type = 'error' THEN 0 ELSE value * 16 END AS generation_ms FROM events WHERE event_type <> 'signup'),
k AS (SELECT 'embed' AS kind, embed_ms_en AS ms FROM r UNION ALL SELECT 'embed', embed_ms_hi FROM r UNION ALL SELECT 'search', search_ms_en FROM r UNION ALL SELECT 'search', search_ms_hi FROM r
  UNION ALL SELECT 'retrieval_total', embed_ms_en + search_ms_en FROM r UNION ALL SELECT 'generation', generation_ms FROM r WHERE generation_ms > 0)"""


@query(f"""WITH {_KINDS}, l AS (SELECT kind, ms, CASE kind WHEN 'retrieval_total' THEN 50.0::DOUBLE WHEN 'generation' THEN 1500.0::DOUBLE END AS limit_ms FROM k)
SELECT kind, count(*) AS n, round(avg(ms), 2) AS avg, round(quantile_cont(ms, 0.5), 2) AS p50, round(quantile_cont(ms, 0.95), 2) AS p95, round(quantile_cont(ms, 0.99), 2) AS p99,
  any_value(limit_ms) AS limit_ms, quantile_cont(ms, 0.95) <= any_value(limit_ms) AS within FROM l GROUP BY kind""")
def latency_report(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    generated = F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(v * 16)
    run = table(spark, sf, "events").select(v.alias("embed_ms_en"), (v % 7).alias("search_ms_en"), (v * 0.5).alias("embed_ms_hi"), (v % 5).alias("search_ms_hi"), generated.alias("generation_ms"), F.when(F.col("event_type") == "signup", F.lit("failed")).alias("error"))
    return reports.latency_report(run)


_LOG = """l AS (SELECT event_id, value % 60 AS stt_ms, value % 9 AS retrieval_ms, value AS ttft_ms, value % 60 + value % 9 + value AS total_ms, event_type = 'error' AS rejected, event_type = 'signup' AS refused FROM events)"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    stages = table(spark, sf, "events").select("event_id", (v % 60).alias("stt_ms"), (v % 9).alias("retrieval_ms"), v.alias("ttft_ms"), (v % 60 + v % 9 + v).alias("total_ms"), (F.col("event_type") == "error").alias("guardrail_rejected"), (F.col("event_type") == "signup").alias("llm_refused"))
    return stages


def _points(c: str, more: str = "") -> str:
    return ", ".join(f"round(quantile_cont({c}_ms, {int(p) / 100}), 2) AS {c}_p{p}" for p in ("50 70 100" + more).split())


@query(f"""WITH {_LOG} SELECT count(*) AS n_queries, {_points("total", " 90")}, {_points("stt")}, {_points("retrieval")}, {_points("ttft")},
  round(avg(CASE WHEN total_ms <= 200 THEN 1.0::DOUBLE ELSE 0 END) * 100, 4) AS within_budget_pct, count(*) FILTER (rejected) AS guardrail_rejected, count(*) FILTER (refused) AS llm_refused FROM l""")
def latency_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latency_totals(_log(spark, sf))


@query("""WITH s AS (SELECT event_id, 100.0::DOUBLE AS t0, 100 + value % 60 / 1000 AS t1, 100 + (value % 60 + value % 9) / 1000 AS t2, 100 + (value % 60 + value % 9 + value) / 1000 AS t3 FROM events)
SELECT event_id, round((t1 - t0) * 1000, 2) AS stt_ms, round((t2 - t1) * 1000, 2) AS retrieval_ms, round((t3 - t2) * 1000, 2) AS llm_ttft_ms, round((t3 - t0) * 1000, 2) AS total_ms, (t3 - t0) * 1000 <= 200 AS within_budget FROM s""")
def latency_records(spark: SparkSession, sf: str) -> DataFrame:
    """Milestones of the latency log to rounded durations with the budget flag."""
    v = F.col("value")
    log = table(spark, sf, "events").select("event_id", F.lit(100.0).alias("t0"), (100 + v % 60 / 1000).alias("t1"), (100 + (v % 60 + v % 9) / 1000).alias("t2"), (100 + (v % 60 + v % 9 + v) / 1000).alias("t3"))
    m = evaluation.milestones(log)
    return m.select("event_id", *[F.round(a, 2).alias(b) for a, b in (("stt_ms", "stt_ms"), ("retrieval_ms", "retrieval_ms"), ("ttft_ms", "llm_ttft_ms"), ("total_ms", "total_ms"))], "within_budget")


@query("""WITH r AS (SELECT event_type, avg(CASE WHEN value <= 60 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM events GROUP BY event_type),
g AS (SELECT *, 0.7::DOUBLE AS i, round_even(24 * least(greatest(v, 0), 1), 0)::INT AS f FROM r)
SELECT event_type, '  ' || rpad(event_type, 28, ' ') || printf('%7.3f', v) || '  [' || repeat('#', f) || repeat('.', 24 - f) || ']  ideal ' || printf('%.3f', i) || '  ' ||
  CASE WHEN abs(v - i) < 0.0005 THEN 'PERFECT' WHEN v <= i THEN '-' || printf('%.1f', abs(v - i) * 100) || 'pp short' ELSE '+' || printf('%.1f', abs(v - i) * 100) || 'pp over' END AS line FROM g""")
def gap_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.when(F.col("value") <= 60, 1.0).otherwise(0.0)).alias("v"))
    return r.select("event_type", reports.gap_row(F.col("event_type"), F.col("v"), F.lit(0.7)).alias("line"))
