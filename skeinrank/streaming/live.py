"""Live sessions and byte frames: state by key, with timers and expiry, and their twins over tables.

State is kept by `transformWithState`, which needs the RocksDB state store (`STATE_STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, set to the state store that timers and expiry need."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    return spark


#: Messages: open starts a session anew, partial and final carry text, end says that no more speech comes.
KINDS = ("open", "partial", "final", "end")
SESSION = "partial string, since long"
ENDED = "session_id string, text string, is_final boolean, timed_out boolean, at timestamp"


class Transcriber(StatefulProcessor):
    """Gives a session's final text when it comes, or, `wait` after its end (or `idle` after its last message), its last partial one.

    Either way the session then leaves the state; opening it anew forgets what there was.
    """

    def __init__(self, wait: timedelta, idle: timedelta):
        self.wait, self.idle = int(wait.total_seconds() * 1000), int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)

    def _clear(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.session.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            at = int(r.at.timestamp() * 1000)
            if r.kind == "final" and r.text:
                self._clear()
                yield Row(session_id=key[0], text=r.text, is_final=True, timed_out=False, at=r.at)
                continue
            if r.kind == "open":
                self._clear()
            partial = (self.session.get()[0] if self.session.exists() else "") if r.kind != "open" else ""
            self.session.update((r.text or "" if r.kind == "partial" else partial, at))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at + (self.wait if r.kind == "end" else self.idle))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.session.exists():
            partial = self.session.get()[0]
            at = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc)
            self._clear()
            yield Row(session_id=key[0], text=partial, is_final=False, timed_out=True, at=at)

    def close(self) -> None:
        pass


def live_sessions(messages: DataFrame, wait: timedelta = timedelta(seconds=10), idle: timedelta = timedelta(minutes=30), late: str = "5 seconds") -> DataFrame:
    """A stream of messages (session_id, seq, at, kind, text) to one of the sessions' texts (see ENDED).

    Times are those of the messages, by a watermark: messages later than that are dropped, and a session's time limit has passed when
    the watermark has passed it.
    """
    timed = messages.select(F.col("session_id").cast("string").alias("session_id"), "seq", F.col("at").cast("timestamp").alias("at"), "kind", "text").withWatermark("at", late)
    return timed.groupBy("session_id").transformWithState(Transcriber(wait, idle), ENDED, "Append", "EventTime")


def sessions(messages: DataFrame, wait: timedelta = timedelta(seconds=10), idle: timedelta = timedelta(minutes=30)) -> DataFrame:
    """The same over a table: every session ends, by its final text or by its time limit.

    A part of a session ends with a final text, at an opening, or where the next message comes after the limit.
    """
    m = messages.select(F.col("session_id").cast("string").alias("session_id"), "seq", F.col("at").cast("timestamp").alias("at"), "kind", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("session_id").orderBy("at", "seq")
    span = lambda d: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(d.total_seconds()))
    limit = F.when(F.col("kind") == "end", span(wait)).otherwise(span(idle))
    done = (F.col("kind") == "final") & (F.col("text") != "")
    m = m.withColumns({"due": F.col("at") + limit, "done": done})
    before = lambda c: F.lag(c).over(order)
    # A session's times may be passed silently before the next message: that one starts a new part.
    starts = before(F.col("at")).isNull() | before(F.col("done")) | (F.col("kind") == "open") | (before(F.col("due")) < F.col("at"))
    m = m.withColumn("part", F.sum(starts.cast("int")).over(order))
    last = F.max_by(F.struct("kind", "text", "at", "due", "done"), F.struct("at", "seq")).alias("last")
    partial = F.max_by(F.when(F.col("kind") == "partial", F.col("text")), F.when(F.col("kind") == "partial", F.struct("at", "seq"))).alias("partial")
    parts = m.groupBy("session_id", "part").agg(last, partial)
    # What an opening cuts off is forgotten.
    opened = m.where("kind = 'open'").select("session_id", (F.col("part") - 1).alias("part"), F.col("at").alias("opened"))
    out = parts.join(opened, ["session_id", "part"], "left").where(F.col("last.done") | F.col("opened").isNull() | (F.col("last.due") < F.col("opened")))
    final = F.col("last.done")
    return out.select("session_id", F.when(final, F.col("last.text")).otherwise(F.coalesce("partial", F.lit(""))).alias("text"), final.alias("is_final"), (~final).alias("timed_out"), F.when(final, F.col("last.at")).otherwise(F.col("last.due")).alias("at"))


FRAME = "stream_id string, frame long, seq long, pcm binary"


def _cut(rest: bytes, chunk: bytes, size: int) -> tuple[list[bytes], bytes]:
    whole = rest + chunk
    n = len(whole) // size
    return [whole[i * size : (i + 1) * size] for i in range(n)], whole[n * size :]


class Framer(StatefulProcessor):
    """Cuts a stream's bytes into frames; what is left over is kept for the next chunk, and forgotten after `idle`, if that is given."""

    def __init__(self, size: int, idle: timedelta | None):
        self.size, self.idle = size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "rest binary, frame long", int(self.idle.total_seconds() * 1000) if self.idle else None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        rest, frame = self.rest.get() if self.rest.exists() else (b"", 0)
        for r in sorted(rows, key=lambda r: r.seq):
            made, rest = _cut(bytes(rest), bytes(r.pcm or b""), self.size)
            for pcm in made:
                yield Row(stream_id=key[0], frame=frame, seq=r.seq, pcm=pcm)
                frame += 1
        self.rest.update((bytes(rest), frame))

    def close(self) -> None:
        pass


def live_frames(chunks: DataFrame, size: int = 960, idle: timedelta | None = timedelta(hours=1)) -> DataFrame:
    """A stream of chunks (stream_id, seq, pcm: bytes of any number) to one of frames (see FRAME) of `size` bytes.

    Chunks of one batch are put in order; from batch to batch they are expected in order. With `idle`, batches go on without new rows, so that
    state can expire: for a run that is to end by itself, give None.
    """
    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "pcm")
    return rows.groupBy("stream_id").transformWithState(Framer(size, idle), FRAME, "Append", "ProcessingTime" if idle else "None")


def byte_frames(chunks: DataFrame, size: int = 960) -> DataFrame:
    """The same over a table: each stream's chunks are read in order, with the bytes left over and a count carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, frame = None, b"", 0
        for batch in batches:
            out: dict[str, list] = {"stream_id": [], "frame": [], "seq": [], "pcm": []}
            for stream, seq, pcm in zip(*(batch[c].to_pylist() for c in ("stream_id", "seq", "pcm")), strict=True):
                if stream != now:
                    now, rest, frame = stream, b"", 0
                made, rest = _cut(rest, pcm or b"", size)
                for i, one in enumerate(made):
                    for c, v in zip(out, (stream, frame + i, seq, one), strict=True):
                        out[c].append(v)
                frame += len(made)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "pcm").where("stream_id is not null")
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, FRAME)


def log_sink(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of latency records as JSON lines under path; started again, it goes on where it was."""
    return records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the query's watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
