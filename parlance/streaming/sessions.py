"""Events as streams: sources and sinks, counters, transcripts of sessions, and edges of speech.

Every function takes a streaming DataFrame (most take a batch one as well).
State has bounds and timeouts; checkpoints give each event once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.functions.text import strip
from parlance.operators.analytics import day_key

# --- fixed values: results depend on them ---------------------------------------
BATCH_FILES, MAX_LINES, IDLE = 16, 2000, "120 seconds"
# -------------------------------------------------------------------------------


def event_source(spark: SparkSession, path: str, schema: str, files: int = BATCH_FILES) -> DataFrame:
    """Events from a folder of JSON files, some files a batch; lines that don't fit come with a null event and their text."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return lines.select(F.from_json("value", schema).alias("event"), "value")


def decodable(source: DataFrame) -> DataFrame:
    """The events of a source that could be read."""
    return source.where("event is not null").select("event.*")


def quarantined(source: DataFrame) -> DataFrame:
    """Lines of a source that couldn't be read, to be kept apart instead of being lost."""
    return source.where("event is null and trim(value) <> ''").select("value")


def event_sink(events: DataFrame, path: str, checkpoint: str, **partitions: str) -> StreamingQuery:
    """Append events to a folder of Parquet files, each exactly once, with what has come so far; returns the query."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions.values())
    return writer.trigger(availableNow=True).start()


def daily_stream(events: DataFrame, counters: dict[str, Column] | None = None, late: str = "1 hour") -> DataFrame:
    """Counters per tenant and day of the events' own time (tenant_id, ts), late ones taken for a while.

    counters are aggregates by name, such as those of operators.records for a
    kind of event; without any, events are counted.
    """
    sums = counters or {"events": F.count("*")}
    made = events.withWatermark("ts", late).groupBy("tenant_id", F.window("ts", "1 day")).agg(*(v.alias(k) for k, v in sums.items()))
    return made.select("tenant_id", day_key(F.col("window.start")).alias("day"), *sums)


def distinct_stream(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Events without those whose key has come before, within the time that late ones are taken."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def labelled_stream(utterances: DataFrame, labels: DataFrame, late: str = "1 hour") -> DataFrame:
    """Utterances with the speaker label of their session and start, whichever comes first; without one after that time they go unlabelled.

    utterances: session_id, start_ms, ts, text. labels: session_id, start_ms, ts, speaker_id.
    """
    u = utterances.withWatermark("ts", late).alias("u")
    v = labels.select("session_id", "start_ms", F.col("ts").alias("label_ts"), "speaker_id").withWatermark("label_ts", late).alias("v")
    near = F.expr("u.session_id = v.session_id AND u.start_ms = v.start_ms AND v.label_ts BETWEEN u.ts - INTERVAL {0} AND u.ts + INTERVAL {0}".format(late))
    return u.join(v, near, "leftOuter").select("u.*", "v.speaker_id")


def barge_ins(frames: DataFrame) -> DataFrame:
    """The moments at which a session's customer begins to speak (session_id, ts): one event for each rising edge.

    frames has session_id, ts and speaking; a batch's frames are taken in order of time.
    """

    def edges(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        speaking = state.get[0] if state.exists else False
        rows = pd.concat(parts).sort_values("ts", kind="stable")
        before = rows["speaking"].shift(1, fill_value=speaking)
        state.update((bool(rows["speaking"].iloc[-1]),))
        state.setTimeoutDuration(4 * 3600 * 1000)
        yield rows.loc[rows["speaking"] & ~before.astype(bool), ["session_id", "ts"]]

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    return frames.groupBy("session_id").applyInPandasWithState(edges, f"session_id {kinds['session_id']}, ts {kinds['ts']}", "speaking boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def transcripts(events: DataFrame, late: str = "10 seconds", idle_ms: int = 120_000, most: int = MAX_LINES) -> DataFrame:
    """A row for each session that closes or has been idle: session_id, lines, whether lines were cut, why it ended, transcript.

    events has session_id, ts, kind (turn or closed), speaker, text and
    is_final. Final turns are kept, the first `most` of a session, and joined in
    order of time as "speaker: text". What comes after the end opens the
    session anew.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines, cut = state.get if state.exists else ([], False)
        lines, closed, last = [tuple(x) for x in lines], False, 0
        if not state.hasTimedOut:
            for part in parts:
                micros = part["ts"].astype("datetime64[us]").astype("int64")
                closed |= bool((part["kind"] == "closed").any())
                last = max(last, int(micros.max()) // 1000)
                turns = (part["kind"] == "turn") & part["is_final"].fillna(False).astype(bool) & (part["text"].fillna("").str.strip() != "")
                lines += [(int(t), f"{s}: {x.strip()}") for t, s, x in zip(micros[turns], part.loc[turns, "speaker"], part.loc[turns, "text"])]
        cut, lines = cut or len(lines) > most, sorted(lines, key=lambda x: x[0])[:most]
        if closed or state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "lines": [len(lines)], "truncated": [cut], "reason": ["closed" if closed else "idle"], "transcript": ["\n".join(x for _, x in lines)]})
            return
        state.update((lines, cut))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)

    kind = events.schema["session_id"].dataType.simpleString()
    return events.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(
        fold, f"session_id {kind}, lines int, truncated boolean, reason string, transcript string", "lines array<struct<at:bigint,line:string>>, cut boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def summary_states(transcripts_: DataFrame, summarised: DataFrame) -> DataFrame:
    """State of each ended session: ready without a summary if it said nothing, ready or failed by its summary, else waiting.

    summarised has session_id, summary (null: failed). A summary that says nothing has failed.
    """
    rows = transcripts_.join(summarised.select("session_id", "summary", F.lit(True).alias("done")), "session_id", "left")
    said = strip(F.coalesce("summary", F.lit(""))) != ""
    return rows.select("session_id", F.when(F.col("lines") == 0, "ready").when(F.col("done").isNull(), "waiting").when(said, "ready").otherwise("failed").alias("status"), "summary")
