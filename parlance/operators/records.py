"""Counters by kind of event, event projections, and joins of events with their settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import strip
from parlance.operators.analytics import day_key, exact_sum, ratio

#: Counters of a day, in order; what an event doesn't have counts nothing.
COUNTERS = (
    "sessions", "sessions_meeting", "sessions_aicc", "utterances", "audio_ms", "confidence_sum", "confidence_n", "pii_masked", "rule_hits", "bot_turns", "handoffs",
    "summaries_ready", "summaries_failed", "summary_latency_sum", "summary_latency_n", "summary_waited_sum", "summary_gave_up",
)


def final_utterances(events: DataFrame) -> DataFrame:
    """Final events whose clean_text says something."""
    return events.where(F.col("is_final") & (strip(F.coalesce("clean_text", F.lit(""))) != ""))


def _daily(events: DataFrame, **counters: Column) -> DataFrame:
    return events.groupBy("tenant_id", day_key(F.col("ts")).alias("day")).agg(*(c.alias(name) for name, c in counters.items()))


def utterance_counters(events: DataFrame) -> DataFrame:
    """Utterances, masked ones, and rule hits: events has is_final, clean_text, pii_masked and matched_rules (array)."""
    return _daily(final_utterances(events), utterances=F.count("*"), pii_masked=F.count_if("pii_masked"), rule_hits=F.sum(F.coalesce(F.array_size("matched_rules"), F.lit(0))))


def recognition_counters(events: DataFrame) -> DataFrame:
    """Confidence and audio of final recognitions: events has is_final, confidence and duration_ms."""
    return _daily(events.where("is_final"), confidence_sum=exact_sum(F.col("confidence")), confidence_n=F.count("*"), audio_ms=F.sum("duration_ms"))


def bot_counters(events: DataFrame) -> DataFrame:
    """Turns of the bot, and those that handed off."""
    return _daily(events, bot_turns=F.count("*"), handoffs=F.count_if("handed_off"))


def summary_counters(events: DataFrame) -> DataFrame:
    """Summaries by status; waiting counts always, latency only of ready ones that have any: events has status, waited_ms, latency_ms and gave_up."""
    ready = F.col("status") == "ready"
    timed = ready & (F.col("latency_ms") > 0)
    return _daily(
        events, summaries_ready=F.count_if(ready), summaries_failed=F.count_if(~ready), summary_waited_sum=F.sum("waited_ms"), summary_latency_sum=F.coalesce(F.sum(F.when(timed, F.col("latency_ms"))), F.lit(0)),
        summary_latency_n=F.count_if(timed), summary_gave_up=F.count_if("gave_up"),
    )


def session_counters(events: DataFrame) -> DataFrame:
    """Closed sessions, all and by profile."""
    meeting = F.col("profile") == "meeting"
    return _daily(events, sessions=F.count("*"), sessions_meeting=F.count_if(meeting), sessions_aicc=F.count_if(~meeting))


def merged_counters(*parts: DataFrame) -> DataFrame:
    """Days of all parts in one table of all counters, absent ones 0; equal days are added."""
    whole = None
    for part in parts:
        filled = part.select("tenant_id", "day", *((F.col(c) if c in part.columns else F.lit(0)).cast("double").alias(c) for c in COUNTERS))
        whole = filled if whole is None else whole.unionByName(filled)
    return whole.groupBy("tenant_id", "day").agg(*(F.sum(c).alias(c) for c in COUNTERS))


def with_ratios(daily: DataFrame) -> DataFrame:
    """Mean confidence, mean summary latency, handoff rate and summary success beside the counters."""
    c = F.col
    return daily.select(
        "*", ratio(c("confidence_sum"), c("confidence_n")).alias("mean_confidence"), ratio(c("summary_latency_sum"), c("summary_latency_n")).alias("mean_summary_latency_ms"),
        ratio(c("handoffs"), c("bot_turns")).alias("handoff_rate"), ratio(c("summaries_ready"), c("summaries_ready") + c("summaries_failed")).alias("summary_success"),
    )


def handoff_utterances(turns: DataFrame) -> DataFrame:
    """What the customer said last before each handoff (session_id, node_id, ts, text): turns has ts, role, text, node_id and handed_off."""
    before = Window.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    said = F.last(F.when(F.col("role") == "customer", strip(F.col("text"))), ignorenulls=True).over(before)
    return turns.withColumn("said", said).where("handed_off and said <> ''").select("session_id", "node_id", "ts", F.col("said").alias("text"))


def with_sequence(rows: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Rows numbered from 1 within their keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def with_settings(events: DataFrame, settings: DataFrame, default: Column, name: str = "settings") -> DataFrame:
    """Events with their tenant's newest published settings (tenant_id, version, published, value), else the default.

    Versions that aren't published, or have no value, don't count.
    """
    newest = settings.where("published and value is not null").groupBy("tenant_id").agg(F.max_by("value", "version").alias(name))
    return events.join(newest, "tenant_id", "left").withColumn(name, F.coalesce(name, default))


def enabled(rows: DataFrame, text: str) -> DataFrame:
    """Enabled rows whose text isn't blank."""
    return rows.where(F.col("enabled") & (strip(F.coalesce(F.col(text), F.lit(""))) != ""))


def labelled(utterances: DataFrame, labels: DataFrame) -> DataFrame:
    """Utterances with the speaker of the label at their session and start, in whatever order the two came; without one they keep their own."""
    newest = labels.groupBy("session_id", "start_ms").agg(F.max_by("speaker_id", "ts").alias("label"))
    return utterances.join(newest, ["session_id", "start_ms"], "left").withColumn("speaker_id", F.coalesce("label", "speaker_id")).drop("label")


def speaker_names(speakers: DataFrame, names: DataFrame) -> DataFrame:
    """Speakers (session_id, speaker_id) with their display names, empty where there is none."""
    return speakers.join(names.select("session_id", "speaker_id", "name"), ["session_id", "speaker_id"], "left").withColumn("name", F.coalesce("name", F.lit("")))


def replaced_names(names: DataFrame, fresh: DataFrame) -> DataFrame:
    """Names after sessions have sent theirs anew: a session's names are replaced as a whole."""
    return names.join(fresh.select("session_id").distinct(), "session_id", "left_anti").unionByName(fresh)


def with_summary_status(calls: DataFrame, done: DataFrame) -> DataFrame:
    """Calls with the status of their last summary; summaries of unknown calls make no call."""
    last = done.groupBy("session_id").agg(F.max_by("status", "ts").alias("done"))
    return calls.join(last, "session_id", "left").withColumn("summary_status", F.coalesce("done", "summary_status")).drop("done")


def edited(summaries: DataFrame, edits: DataFrame) -> DataFrame:
    """Summaries with the text of edits (session_id, text) of theirs, marked as edited; tenants stay."""
    rows = summaries.join(edits.select("session_id", F.col("text").alias("_new")), "session_id", "left")
    return rows.withColumn("text", F.coalesce("_new", "text")).withColumn("edited", F.col("_new").isNotNull() | F.coalesce("edited", F.lit(False))).drop("_new")


def published(drafts: DataFrame, history: DataFrame, keep: int = 50) -> DataFrame:
    """History (id, version, value, published_at) after drafts (id, value, published_at) are published: versions count on, the newest `keep` of an id stay."""
    last = history.groupBy("id").agg(F.max("version").alias("last"))
    fresh = drafts.join(last, "id", "left").select("id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), "value", "published_at")
    rows = history.select("id", "version", "value", "published_at").unionByName(fresh)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version")))
    return rows.withColumn("_k", rank).where(F.col("_k") <= keep).drop("_k")


def session_id(started: Column, salt: Column) -> Column:
    """sess_YYYYMMDD_ and eight hexadecimal digits of a hash."""
    return F.concat(F.lit("sess_"), F.date_format(started, "yyyyMMdd"), F.lit("_"), F.substring(F.sha2(salt.cast("string"), 256), 1, 8))


def session_ms(opened: Column, closed: Column) -> Column:
    """Whole milliseconds between two moments."""
    return F.floor((F.unix_micros(closed.cast("timestamp")) - F.unix_micros(opened.cast("timestamp"))) / 1000).cast("long")


def recent_days(last: Column, n: int) -> Column:
    """The n days up to one, oldest first, at least one."""
    return F.transform(F.sequence(F.date_sub(last, max(1, n) - 1), last), lambda d: F.date_format(d, "yyyy-MM-dd"))


def licence_state(today: Column, expires: Column, grace_days: int = 30) -> Column:
    """Struct of days left, and whether a licence is valid, in its grace (its last day included) or expired."""
    left = F.date_diff(expires, today)
    return F.struct(left.alias("days_left"), F.when(left >= 0, "valid").when(left >= -grace_days, "grace").otherwise("expired").alias("state"))


def audio_chunks(frames: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Frames (session_id, ts, audio in base64) as numbered samples; broken, too long and odd ones are left out."""
    pcm = F.try_to_binary("audio", F.lit("base64"))
    rows = frames.withColumn("pcm", pcm).where((F.octet_length("pcm") <= most) & (F.octet_length("pcm") % 2 == 0))
    return with_sequence(rows.drop("audio"), ["session_id"], ["ts"])
