import io
import os
import wave

import numpy as np
from pyspark.sql import functions as F

from skeinrank.operators import chunking
from skeinrank.sources import audio_files, store, upserts

ROWS = "id string, lang_code string, text string, version long"


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_upserts_rewrite_what_they_touch_and_repeat_safely(spark, tmp_path):
    c = upserts.Collection(spark, f"file://{tmp_path}/c", buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    assert c.read() is None and c.upsert(frame([(f"k{i}", "en", f"t{i}", 1) for i in range(200)]), 0) == 200
    before = files(tmp_path / "c" / "rows")
    changed = frame([("k1", "de", "new", 2), ("k1", "fr", "older", 1), ("k500", "en", "more", 1)])
    assert c.upsert(changed, 1, order="version") == 3
    after = files(tmp_path / "c" / "rows")
    touched = {r.b for r in changed.select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).distinct().collect()}
    same = {p for p in before if after.get(p) == before[p]}
    assert same == {p for p in before if int(p.split("bucket=")[1].split("/")[0]) not in touched}
    rows = {r.id: (r.lang_code, r.text) for r in c.read().collect()}
    assert len(rows) == c.read().count() == 201 and rows["k1"] == ("de", "new") and rows["k500"] == ("en", "more")
    assert c.upsert(frame([("k1", "xx", "replayed", 9)]), 1) == 1 and files(tmp_path / "c" / "rows") == after
    assert c.upsert(frame([]), 2) == 0 and c.done(2)


def test_a_stream_upserts_by_batches(spark, tmp_path):
    c = upserts.Collection(spark, f"file://{tmp_path}/c", buckets=4)
    for n in range(2):
        spark.createDataFrame([(f"k{i}", "en", f"v{n}", n) for i in range(n, 10 + n)], ROWS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        spark.readStream.schema(ROWS).parquet(f"file://{tmp_path}/in").writeStream.foreachBatch(c.sink("version")).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.text for r in c.read().collect()} == {"k0": "v0"} | {f"k{i}": "v1" for i in range(1, 11)}


def test_counters_are_taken_beside_the_write(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (100 * i), "en") for i in range(1, 8)], "doc_id long, text string, lang string")
    chunks = chunking.window_chunks(docs).withColumn("strategy", F.lit("window")).unionByName(chunking.sentence_chunks(docs).withColumn("strategy", F.lit("children")), allowMissingColumns=True)
    got = upserts.counted(chunks, {"window": F.col("strategy") == "window", "children": F.col("strategy") == "children"}, lambda d: d.write.parquet(f"file://{tmp_path}/out"))
    wrote = {r.strategy: r["count"] for r in spark.read.parquet(f"file://{tmp_path}/out").groupBy("strategy").count().collect()}
    assert got["window"] == wrote["window"] and got["children"] == wrote["children"] and got["rows"] == sum(wrote.values()) and got["rows_per_second"] > 0


def made_wave(x, rate, width, channels):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        whole = np.round(x * (2 ** (8 * width - 1) - 1)).astype(np.int64)
        f.writeframes(b"".join((int(v) + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) for v in whole.ravel()))
    return out.getvalue()


def plain(x, rate):
    """By the definition of the transform: a sum of waves, each kept if the lower rate can hold it."""
    n, m = len(x), int(len(x) * 16_000 / rate)
    f = np.fft.fft(x)
    t, out, least = np.arange(m) / m, np.zeros(m), min(n, m)
    for k in range(-(least // 2), (least - 1) // 2 + 1):
        out += np.real(f[k] * np.exp(2j * np.pi * k * t)) if not (least % 2 == 0 and k == -least // 2) else np.real((f[k] if m > n else f[k] + f[-k]) * np.exp(2j * np.pi * k * t))
    return out / n


def test_audio_files(spark, tmp_path):
    rng, want = np.random.default_rng(1), {}
    for rate, width, channels, n in ((44_100, 2, 2, 900), (8_000, 1, 1, 301), (16_000, 2, 1, 500), (48_000, 3, 2, 600), (22_050, 4, 1, 451)):
        x = np.clip(np.cumsum(rng.standard_normal((n, channels)) * 0.05, axis=0), -0.9, 0.9)
        name = f"{rate}-{width}.wav"
        (tmp_path / name).write_bytes(made_wave(x, rate, width, channels))
        back, own = audio_files.decoded((tmp_path / name).read_bytes())
        assert own == rate and abs(back - x).max() < 2.0 ** (2 - 8 * width)
        mono = back.mean(axis=1)
        want[name] = mono if rate == 16_000 else plain(mono, rate)
    (tmp_path / "broken.wav").write_bytes(b"RIFF no wave")
    got = {os.path.basename(r.path): r for r in audio_files.audio_files(spark, f"file://{tmp_path}/*.wav").collect()}
    assert got["broken.wav"].pcm is None and len(got) == 6
    for name, x in want.items():
        assert got[name].n_samples == len(x) and abs(np.frombuffer(got[name].pcm, "<i2") - np.clip(x, -1, 1) * 32_767).max() <= 1.01


def test_reports_that_are_no_json_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"meta": {"n": 1}}')
    (tmp_path / "b.json").write_text("{not json")
    assert [r.meta.n for r in store.reports(spark, f"file://{tmp_path}/*.json").collect()] == [1]
