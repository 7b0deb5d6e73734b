"""Speech segments by a state machine with hysteresis, over tables and streams of frames, and transcripts of messages.

A stream's frames are read in order, one by one, with three numbers carried from frame to frame: no stream is gathered in
a row. Tables are sorted within partitions; in a streaming query the same state is kept per stream between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

SILENT, SPEAKING, TRAILING = 0, 1, 2


def smoothed(frames: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """frames (stream_id, seq, p) with p averaged over the last frames."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(1 - config.smooth_frames, 0)
    return frames.withColumn("p", F.avg("p").over(w))


@dataclass
class Ear:
    """What is carried from frame to frame: the state, the milliseconds of quiet, and the last probabilities."""

    state: int = SILENT
    quiet: int = 0
    last: list[float] = field(default_factory=list)

    def hear(self, p: float, config: Config) -> str | None:
        """The event of a frame: start or end of speech, or none."""
        if self.state == SILENT:
            if p >= config.speech_on:
                self.state, self.quiet = SPEAKING, 0
                return "start"
        elif p >= config.speech_on:
            self.state, self.quiet = SPEAKING, 0
        elif self.state == TRAILING:
            self.quiet += config.frame_ms
            if self.quiet >= config.silence_ms:
                self.state, self.quiet = SILENT, 0
                return "end"
        elif p < config.speech_off:
            self.state, self.quiet = TRAILING, config.frame_ms
        return None

    def smooth(self, p: float, config: Config) -> float:
        self.last = [*self.last, p][-config.smooth_frames :]
        return sum(self.last) / len(self.last)


def segments(frames: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """frames (stream_id, seq, p smoothed) to events: stream_id, seq, event (start or end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ear = None, Ear()
        for batch in batches:
            heard = []
            for row in zip(*(batch[c].to_pylist() for c in ("stream_id", "seq", "p")), strict=True):
                if row[0] != now:
                    now, ear = row[0], Ear()
                if event := ear.hear(row[2], config):
                    heard.append((row[0], row[1], event))
            columns = [pa.array([x[i] for x in heard], t) for i, t in enumerate((batch.schema.field("stream_id").type, pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["stream_id", "seq", "event"])

    rows = frames.where("p is not null").select("stream_id", F.col("seq").cast("bigint").alias("seq"), F.col("p").cast("double").alias("p"))
    kind = dict(frames.dtypes)["stream_id"]
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, f"stream_id {kind}, seq bigint, event string")


def live_segments(frames: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A stream of frames (stream_id, seq, p as measured) to a stream of events, with each stream's state kept by its key.

    Frames of one batch are put in order; they are expected in order from batch to batch.
    """
    kind = dict(frames.dtypes)["stream_id"]

    def run(key, parts, state):
        ear = Ear(*state.get) if state.exists else Ear()
        ear.last = list(ear.last)
        got = pd.concat(list(parts)).sort_values("seq")
        heard = [(s, e) for s, p in zip(got["seq"], got["p"], strict=True) if (e := ear.hear(ear.smooth(p, config), config))]
        state.update((ear.state, ear.quiet, ear.last))
        yield pd.DataFrame({"stream_id": [key[0]] * len(heard), "seq": [s for s, _ in heard], "event": [e for _, e in heard]})

    return frames.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, seq bigint, event string", "state int, quiet int, last array<double>", "append", "NoTimeout")


#: What is read of a message of the speech service.
MESSAGE = "event string, transcript string, is_final boolean, type string, data struct<transcript:string>"


def messages(raw: DataFrame) -> DataFrame:
    """raw (session_id, seq, body: JSON) to messages (session_id, seq, is_final, text); bad and empty ones are skipped."""
    m = raw.select("session_id", "seq", F.from_json("body", MESSAGE).alias("m")).where("m is not null").select("session_id", "seq", "m.*")
    text, final = F.coalesce("transcript", F.lit("")), F.coalesce("is_final", F.lit(False)) | F.coalesce(F.col("event") == "transcript.final", F.lit(False))
    partial = F.coalesce(F.col("event") == "transcript.partial", F.lit(False)) | ((text != "") & ~final)
    told = F.when(partial, text).when(final | (F.col("type") == "data"), F.coalesce(F.when(text != "", text), F.col("data.transcript"), F.lit("")))
    return m.select("session_id", "seq", (~partial).alias("is_final"), told.alias("text"), partial.alias("partial")).where("text is not null and (partial or text <> '')").drop("partial")


def transcripts(messages: DataFrame) -> DataFrame:
    """Messages (session_id, seq, is_final, text), a table or a stream, to each session's last partial and final text.

    One aggregation by session that keeps one message of each kind.
    """
    last = lambda kind: F.max(F.when(kind, F.struct("seq", "text")))["text"]
    return messages.groupBy("session_id").agg(last(~F.col("is_final")).alias("partial"), last(F.col("is_final")).alias("final"))
