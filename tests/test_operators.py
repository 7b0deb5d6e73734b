import hashlib
import random
import uuid

from pyspark.sql import functions as F

import __spark_entry__ as entry
from skeinrank.functions import ids
from skeinrank.functions import text as tx
from skeinrank.functions import shaping
from skeinrank.operators import answers, evaluation, records, reports, retrieval, routing
from skeinrank.sources import store
from skeinrank.streaming import audio, voice


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_sentences(spark):
    assert one(spark, "A b. C d? e।  f\ng", tx.sentences) == ["A b.", "C d?", "e।", "f", "g"]
    merged = lambda c: tx.merged_sentences(tx.sentences(c))
    assert [tuple(r) for r in one(spark, "It was historic. Everyone agreed about that result.", merged)] == [("It was historic. Everyone agreed about that result.", 1)]
    assert [r.text for r in one(spark, "Hi. A much longer sentence stands here today.", merged)] == ["A much longer sentence stands here today."]


def test_sentence_split_all_packs_long_sentences(spark, tmp_path):
    def packed(text):
        out, held = [], ""
        for word in text.split():
            held = f"{held} {word}".strip()
            if len(held) >= 150:
                out.append(held)
                held = ""
        return out + [held] if held else out

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde") * rng.randint(1, 12) + rng.choice([" ", "  ", "\t"]) for _ in range(n)) for n in (30, 60, 200, 1000)]
    texts += ["x" * 201, " ".join(["y" * 149] * 3), " ".join(["z" * 150] * 3)]
    assert all(len(t) > 200 for t in texts)
    want = {i: packed(t) for i, t in enumerate(texts)} | {100: ["A b.", "C d?"], 101: [], 102: ["x" * 200], 103: ["a  b"]}
    rows = [*enumerate(texts), (100, "A b. C d?"), (101, ""), (102, "x" * 200), (103, "a  b" + " " * 250)]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_sentences, r.digest) for r in entry.queries()["sentence_split"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(p), hashlib.md5("|".join(p).encode()).hexdigest()) for i, p in want.items()}
    got = {(r.doc_id, r.place): r.sentence for r in entry.queries()["sentence_split_all"](spark, str(tmp_path)).collect()}
    assert got == {(i, k): x for i, p in want.items() for k, x in enumerate(p, 1)}


def test_windows(spark):
    got = one(spark, " ".join(f"w{i}" for i in range(400)), lambda c: tx.token_windows(c, 256, 0.15))
    assert [(r.text.split()[0], len(r.text.split()), r.chunk_index) for r in got] == [("w0", 256, 0), ("w218", 182, 1)]
    assert one(spark, "a  b", lambda c: tx.token_windows(c, 256, 0.15))[0].text == "a  b"
    assert [len(x) for x in one(spark, "x" * 401, lambda c: tx.char_windows(c, 400, 60))] == [400, 61]


def test_small_functions(spark):
    assert one(spark, "Hello, (World)! a । foo-bar/baz", tx.bm25_tokens) == ["hello", "world", "foo", "bar", "baz"]
    assert [one(spark, x, tx.language_key) for x in ("en-IN", "hi_IN", "AUTO", None)] == ["en", "hi", "", ""]
    assert [one(spark, x, tx.strategy) for x in ("one two three four", "tell me why it is so", "a b c d e")] == ["sliding", "semantic", "semantic"]
    assert [one(spark, x, tx.refused) for x in ("I cannot answer that.", "Paris.", "", None)] == [True, False, True, True]
    assert [one(spark, x, tx.script_language) for x in ("தமிழ்", "हिंदी", "తెలుగు", "plain")] == ["ta", "hi", "te", None]


def test_metrics(spark):
    ranks = spark.createDataFrame([(3,), (None,)], "rank int")
    assert tuple(evaluation.recall_mrr(ranks).first()) == (2, 0.1667, 0.0, 0.5, 0.5)
    log = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "ms double")
    row = evaluation.latency_summary(log, []).first()
    assert (row.p50, row.p70, row.p90, row.p100) == (2.5, 3.7, 7.9, 10.0)
    t = evaluation.milestones(spark.createDataFrame([(0.0, 0.048, 0.056, 0.175)], "t0 double, t1 double, t2 double, t3 double")).first()
    assert [round(x) for x in (t.stt_ms, t.retrieval_ms, t.ttft_ms, t.total_ms)] == [48, 8, 119, 175] and t.within_budget
    two = evaluation.reliability(spark.createDataFrame([(True, False), (True, True), (False, True)], "answerable boolean, grounded boolean")).first()
    assert (two.false_refusal, two.false_confidence) == (0.5, 1.0)


def test_fusion_ranks_documents_without_a_shared_term(spark):
    dense = spark.createDataFrame([(1, "en", 10, 0), (1, "en", 11, 1), (1, "en", 14, 2), (2, None, 11, 0)], "query_id long, corpus string, doc_id long, rank int")
    sparse = spark.createDataFrame([(1, 11, 2.0), (1, 13, 1.0), (1, 15, -1.0)], "query_id long, doc_id long, score double")
    docs = spark.createDataFrame([(i, "en") for i in range(10, 16)] + [(99, "de")], "doc_id long, lang string")
    spots = retrieval.places(docs, dense.where("corpus is not null").select("corpus", "doc_id"))
    assert {(r.doc_id, r.place, r.docs) for r in spots.collect()} == {(10, 0, 6), (11, 1, 6), (14, 4, 6)}
    got = {(r.query_id, r.doc_id): (r.sparse_rank, r.rrf) for r in retrieval.fuse(dense, sparse, spots).collect()}
    # In order: 11, 13, then those that score nothing, 10, 12, 14, then 15.
    assert got[1, 10] == (2, round(1 / 60 + 0.3 / 62, 9)) and got[1, 11] == (0, round(1 / 61 + 0.3 / 60, 9)) and got[1, 14][0] == 4
    assert got[2, 11] == (None, round(1 / 60, 9))


def test_hybrid_falls_back_to_all_languages(spark):
    docs = spark.createDataFrame([(i, f"alpha beta word{i}" + (" rare" if i == 3 else ""), "en" if i < 5 else "de") for i in range(8)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "rare alpha", "en-US"), (2, "word6 alpha beta", "it"), (3, "word6 alpha beta", "en")], "query_id long, text string, lang string")
    got = {}
    for r in retrieval.hybrid(docs, asked).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.doc_id
    assert got[1][1] == 3 and got[2][1] == 6 and all(d < 5 for d in got[3].values())
    scores = {(r.query_id, r.doc_id) for r in retrieval.bm25(docs, asked).collect()}
    assert {q for q, _ in scores} == {1, 3} and all(d < 5 for _, d in scores)


def test_nearest_takes_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    assert len(retrieval.blocks(spark.range(10).select(F.col("id").alias("query_id")), 3)) == 4
    v = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(40)], "vec_id long, label int, embedding array<double>")
    q = v.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    got = {(r.query_id, r.rank): r.vec_id for r in retrieval.neighbours(v, q, 2).collect()}
    assert all(got[i, 0] == 38 + i % 2 and got[i, 1] == 36 + i % 2 for i in range(1, 20)) and got[0, 0] == 2


def test_exact_probe(spark):
    asked = spark.createDataFrame([(1, "en", " Hello "), (2, "en", "none")], "query_id int, lang string, text string")
    cached = spark.createDataFrame([("ta", "hello", "r1"), ("te", "hello", "r2")], "lang string, text string, response string")
    assert [tuple(r) for r in routing.exact_probe(asked, cached).collect()] == [(1, "ta", "r1")]


def test_probe_cuts_regions_from_languages(spark):
    asked = spark.createDataFrame([(1, "bn-IN", "Hello"), (2, "EN_us", "hello "), (3, None, "hello"), (4, "te", "x")], "query_id int, lang string, text string")
    cached = spark.createDataFrame([("bn", "hello", "r1"), ("en-GB", "hello", "r2"), (None, "x", "r3")], "lang string, text string, response string")
    assert sorted(tuple(r) for r in routing.exact_probe(asked, cached).collect()) == [(1, "bn", "r1"), (2, "en", "r2"), (3, "en", "r2"), (4, "auto", "r3")]


def test_answers_in_every_state(spark):
    fix = lambda t: tuple(one(spark, t, lambda c: answers.repaired(c, "hi")))
    assert fix('<think>unclosed {"answer":"no"}') == ("no", [], 0.0, "hi", False, None)
    assert fix('{"answer": "x", "confidence": 0.5} and {"b": 1}') == ("x", ["general_knowledge"], 0.95, "hi", False, None)
    assert fix('{"answer": "x"}, {"b": 1}')[2] == fix('{"answer": "x"}} , {"b": 1}')[2] == fix("{'b': 'x', \"answer\": \"x\"}")[2] == 0.95
    assert fix('```json\n{"answer":"A","sources":null,"confidence":null,"language":"te"}\n```') == ("A", None, None, "te", False, None)
    assert fix('{"answer":"a\\u00e9\\nb","x":')[0] == "aé\nb" and fix('{"answer": "é \\n ü"')[0] == "é \n ü" and fix('{"answer": "a \\u12" ')[0] == "a \\u12"
    assert fix('Sources "q1_p2" "general_knowledge" q9_p9 "q1_p2" {"answer": "z')[:2] == ("z", ["q1_p2", "general_knowledge"])
    assert fix('{"answer": "", "sources": [') == ("", ["general_knowledge"], 0.95, "hi", False, None)
    assert fix('{"answer": "Thinking process\\n- a\\nSo it is."}')[0] == "So it is." and fix("thinking process\n1. x\n**Yes.**")[:3] == ("Yes.**", ["general_knowledge"], 0.9)
    assert fix("<think>a</think>")[5] == fix("x" * 300)[5] == fix("{")[5] == "parse_error" and fix(" \n")[5] == fix(None)[5] == "insufficient_context"
    assert len(fix('{"answer": "' + '\\"a' * 50_000 + '", "')[0]) == 150_000


def test_answers(spark):
    fix = lambda t: one(spark, t, answers.repaired)
    assert fix('<think>x</think>```json\n{"answer": "Paris", "confidence": 0.5}\n``` bye').answer == "Paris"
    cut = fix('{"answer": "Paris is", "sources": ["q1_p0"')
    assert (cut.answer, cut.sources) == ("Paris is", ["q1_p0"])
    assert fix("Just text").answer == "Just text" and fix("").refusal_reason == "insufficient_context"
    assert [one(spark, t, answers.verdict) for t in ('{"verdict": true}', "not json", '{"verdict": false}', None)] == [True, False, False, False]


def test_voice(spark):
    p = [0.1, 0.9, 0.9, 0.4, 0.2, 0.2, 0.4, 0.4, 0.2, 0.2, 0.2]
    frames = spark.createDataFrame([("s", i, x) for i, x in enumerate(p)], "stream_id string, seq long, p double")
    assert [(r.seq, r.event) for r in voice.segments(frames).orderBy("seq").collect()] == [(1, "start"), (10, "end")]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_detected_language_and_winner(spark):
    rows = [("vanakkam nanba", "ta"), ("aap kaise hain", "hi"), ("meeru ela unnaru", "te"), ("வணக்கம் नमस्ते", "ta"), ("", "en"), (None, "en"), ("xyz", "en")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", tx.detected_language(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    pairs = [("வண", "longer text", "வண"), ("abc", "తె", "తె"), ("abc", "abcd", "abcd"), ("abc", "xyz", "abc"), (None, None, "")]
    got = spark.createDataFrame(pairs, "a string, g string, want string").select("want", tx.transcript_winner(F.col("a"), F.col("g")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_storage_keys_are_name_based(spark):
    names = ["a", "doc-1", "ü", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.n)) for r in got)


def test_transcripts_keep_the_last_of_each_kind(spark):
    rows = [(1, 1, False, "a"), (1, 3, False, "c"), (1, 2, True, "b"), (2, 1, False, None)]
    got = {r.session_id: (r.partial, r.final) for r in voice.transcripts(spark.createDataFrame(rows, "session_id long, seq long, is_final boolean, text string")).collect()}
    assert got == {1: ("c", "b"), 2: (None, None)}


def test_prompts_number_their_passages(spark):
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, text string")
    hits = spark.createDataFrame([(1, 7, " second ", None, 0.5, 2), (1, 9, "first", "en", 0.75, 1)], "query_id long, doc_id long, text string, lang string, score double, rank int")
    got = {r.query_id: r.prompt for r in answers.prompts(asked, hits).collect()}
    assert "[PASSAGE 1] (doc_id=9, lang=en, relevance=0.750)\nfirst\n\n[PASSAGE 2] (doc_id=7, lang=??, relevance=0.500)\nsecond\n\n" in got[1]
    assert "[NO CONTEXT AVAILABLE]" in got[2]


def test_examples_drop_rows_with_gaps(spark):
    schema = "query_id long, query string, Eng_Query string, Eng_Answer string, passages struct<English_passages:array<string>,Translated_passages:array<string>,is_selected:array<int>>"
    two = (["a", "b"], ["x", "y"], [0, 1])
    rows = [
        (1, "q", "q", "yes", two), (2, "q", "q", "No Answer Present.", (["a"], ["x"], [0])), (3, "q", "q", "No Answer Present.", two), (4, "q", "q", "yes", (["a"], ["x"], [0])),
        (5, "q", " ", "yes", two), (6, "q", "q", "yes", (["a"], ["x", "y"], [0, 1])), (7, "q", "q", "yes", (["a", ""], ["x", "y"], [0, 1])), (8, "q", "q", None, (["a"], ["x"], [0])), (9, None, "q", "yes", two),
    ]
    got = {r.query_id: (r.is_answerable, r.gt_answer_en, r.gt_passage_index) for r in records.examples(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (True, "yes", 1), 2: (False, None, None), 8: (False, None, None)}


def test_squad_records(spark):
    schema = "id string, title string, context string, question string, answers struct<text:array<string>>"
    rows = [("56be4db0acb8001400a502ec", "T", "c", "q", (["a", "b"],)), ("xyz", None, None, None, ([],))]
    got = records.from_squad(spark.createDataFrame(rows, schema)).collect()
    assert got[0].query_id == int("56be4db0acb8001400a502ec", 16) % 2**31 and got[0].Eng_Answer == "a" and got[0].passages.url == ["squad://T"]
    assert 0 <= got[1].query_id < 2**31 and got[1].passages.Translated_passages == [""] and got[1].passages.url == ["squad://unknown"]


def test_reports_of_nothing_and_of_errors(spark):
    schema = "verdict boolean, grounded boolean, judge_error string"
    none, bad = spark.createDataFrame([], schema), spark.createDataFrame([(True, True, None), (False, True, "down")], schema)
    assert tuple(reports.faithfulness(none).first()) == (0, 1.0, 0.0, 0, 1.0) and tuple(reports.correctness(none).first()) == (0, 0.0)
    assert tuple(reports.faithfulness(bad).first()) == (0, None, None, None, None) and tuple(reports.correctness(bad).first()) == (0, None)
    assert tuple(reports.faithfulness(bad.where("judge_error is null or verdict is null")).first()) == (1, 1.0, 0.0, 1, 1.0)
    log = spark.createDataFrame([], "stt_ms double, retrieval_ms double, ttft_ms double, total_ms double, guardrail_rejected boolean, llm_refused boolean")
    assert reports.latency_totals(log).count() == 0
    line = spark.range(1).select(reports.gap_row(F.lit("recall"), F.lit(0.5), F.lit(1.0)).alias("x")).first().x
    assert line == "  " + "recall".ljust(28) + "  0.500  [" + "#" * 12 + "." * 12 + "]  ideal 1.000  -50.0pp short"


def test_collections_logs_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "hi", 1), ("b", "ta", 2)], "id string, lang_code string, n int")
    store.write_collection(rows, f"{tmp_path}/chunks")
    assert spark.read.parquet(f"{tmp_path}/chunks").where("lang_code = 'ta'").first().id == "b" and (tmp_path / "chunks" / "lang_code=hi").is_dir()
    for _ in range(2):
        store.append_log(rows, f"{tmp_path}/log")
        reports.save_report(rows, f"{tmp_path}/reports")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    found = store.reports(spark, f"{tmp_path}/reports").collect()
    assert len(found) >= 2 and [r.modified for r in found] == sorted((r.modified for r in found), reverse=True)
    assert store.split_path("r", "hin", "train") == "r/train/hintrain.parquet" and store.split_path("r", "hin", "validation") == "r/validation/hinval.parquet"
    assert store.lookup(rows.select("id"), rows.where("n = 1"), "id").where("n is null").count() == 1


def test_latest_row_wins_and_ties_are_settled(spark):
    old, new = spark.createDataFrame([(1, 5, "x"), (2, 1, "y")], "k int, at int, v string"), spark.createDataFrame([(1, 5, "z"), (3, 0, "n")], "k int, at int, v string")
    assert sorted(map(tuple, evaluation.upsert(old, new, "k", "at").collect())) == [(1, 5, "z"), (2, 1, "y"), (3, 0, "n")]


def test_frames_and_energy(spark):
    chunks = spark.createDataFrame([("s", 1, 500), ("s", 2, 500), ("s", 3, 2000), ("t", 1, 100)], "stream_id string, seq int, n int")
    assert sorted((r.frame, r.seq) for r in audio.frames(chunks).collect()) == [(0, 2), (1, 3), (2, 3)]
    got = spark.createDataFrame([([0.003, -0.004],), ([],), (None,)], "x array<double>").select(audio.rms(F.col("x")).alias("p")).collect()
    assert [round(r.p, 6) for r in got] == [0.353553, 0.0, 0.0]


def test_voice_segments_of_a_stream(spark, tmp_path):
    raw = [0.1, 0.9, 0.9, 0.9] + [0.0] * 14
    parts = [raw[:6], raw[6:]]
    schema = "stream_id string, seq long, p double"
    (tmp_path / "in").mkdir()
    query = voice.live_segments(spark.readStream.schema(schema).json(f"{tmp_path}/in")).writeStream.format("memory").queryName("heard").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append")
    at, running = 0, None
    for part in parts:
        spark.createDataFrame([("s", at + i, p) for i, p in enumerate(part)], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        at += len(part)
        running = running or query.start()
        running.processAllAvailable()
    running.stop()
    whole = spark.createDataFrame([("s", i, p) for i, p in enumerate(raw)], schema)
    want = [(r.seq, r.event) for r in voice.segments(voice.smoothed(whole)).orderBy("seq").collect()]
    assert [(r.seq, r.event) for r in spark.table("heard").orderBy("seq").collect()] == want and len(want) == 2


def test_requests_and_replies(spark):
    one_of = lambda v, f: one(spark, v, f)
    assert [one_of(x, lambda c: shaping.asked_language(c, "auto")) for x in ("EN-us", None, " hi ")] == ["en", "auto", "hi"]
    assert [one_of(x, shaping.language_tag) for x in ("ne", "zz", None)] == ["ne-NP", "en-IN", "en-IN"]
    assert bytes(one_of("data:x;base64,YWI=", shaping.audio_body)) == b"ab" and one_of(None, shaping.audio_suffix) == ".webm"
    assert one_of("Thinking Process:\n1. x\nAnalyze y\nIt is 4.", shaping.cleaned_thinking) == "It is 4." and one_of('"quoted"', shaping.cleaned_thinking) == "quoted"
