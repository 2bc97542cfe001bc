"""Daily counters, rankings, call histories and usage over conversation events.

Every operator takes and returns DataFrames; groups are combined before they
are shuffled, and ordered work is done by windows per session.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import normalized_utterance

MAX_TURNS = 500


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def exact_sum(value: Column) -> Column:
    """A sum that doesn't depend on the rows' order (six decimals)."""
    return F.sum(value.cast("decimal(18,6)")).cast("double")


def daily_counters(events: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """Counters per (tenant_id, day of ts): named aggregate columns over the events."""
    return events.groupBy("tenant_id", day_key(F.col("ts")).alias("day")).agg(*(c.alias(name) for name, c in counters.items()))


def zero_filled(daily: DataFrame, first: str, last: str, tenants: DataFrame | None = None) -> DataFrame:
    """One row for each tenant and calendar day from first to last, absent counters 0."""
    counters = [c for c in daily.columns if c not in ("tenant_id", "day")]
    days = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 day"))).alias("date")
    calendar = (daily if tenants is None else tenants).select("tenant_id").distinct().select("tenant_id", days).select("tenant_id", F.date_format("date", "yyyy-MM-dd").alias("day"))
    return calendar.join(daily, ["tenant_id", "day"], "left").select("tenant_id", "day", *(F.coalesce(c, F.lit(0)).alias(c) for c in counters))


def ratio(above: Column, below: Column) -> Column:
    return F.when(below > 0, above / below).otherwise(0.0)


def overview(daily: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Sums of all counters per tenant, and ratios of sums (never means of daily means)."""
    counters = [c for c in daily.columns if c not in ("tenant_id", "day")]
    sums = daily.groupBy("tenant_id").agg(F.count("*").alias("days"), *(F.sum(c).alias(c) for c in counters))
    return sums.select("*", *(ratio(F.col(a), F.col(b)).alias(name) for name, (a, b) in ratios.items()))


def rankings(events: DataFrame, k: int = 20) -> DataFrame:
    """Per tenant the k most frequent keys with their last non-empty label; ties by key."""
    labelled = F.col("label") != ""
    last = F.max_by(F.when(labelled, F.col("label")), F.when(labelled, F.struct("ts", "label"))).alias("label")
    counted = events.groupBy("tenant_id", "key").agg(F.count("*").alias("n"), last)
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("n"), "key"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def fallbacks(turns: DataFrame, k: int = 50) -> DataFrame:
    """Utterances that led nowhere, counted by normalised text: first wording, last time and session."""
    order = F.struct("ts", "session_id", "text")
    counted = turns.groupBy(normalized_utterance(F.col("text")).alias("norm")).agg(
        F.count("*").alias("n"), F.min_by("text", order).alias("text"), F.max("ts").alias("last_seen"), F.max_by("session_id", order).alias("session_id")
    )
    return counted.where("norm <> ''").orderBy(F.desc("n"), "norm").limit(k)


def call_records(turns: DataFrame, most: int = MAX_TURNS) -> DataFrame:
    """One row a session: its turns in order (the first `most`, flagged when cut) and its counts.

    turns has session_id, seq, role and text. Rows past the cap are numbered
    away before anything is collected, so a session's array is bounded.
    """
    numbered = turns.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "role", "text")))
    kept = F.when(F.col("n") <= most, F.struct("n", "seq", "role", "text"))
    made = numbered.groupBy("session_id").agg(
        F.count("*").alias("utterances"), F.count_if(F.col("role").isin("user", "customer")).alias("customer_turns"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.array_sort(F.collect_list(kept)).alias("turns"),
    )
    return made.withColumn("truncated", F.col("utterances") > most)


def search_calls(calls: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """Calls whose id or any turn has the query, case ignored; a blank query takes all; newest first."""
    wanted = query.strip().lower()
    if wanted:
        calls = calls.where(F.lower(F.col("session_id").cast("string")).contains(wanted) | F.exists("turns", lambda t: F.lower(t["text"]).contains(wanted)))
    return calls.orderBy(F.desc("last_seq"), "session_id").limit(k) if k else calls


def with_last_customer_turn(turns: DataFrame) -> DataFrame:
    """Each turn with the latest customer text before it in its session (an as-of join by a window)."""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("last_customer", F.last(F.when(F.col("role").isin("user", "customer"), F.col("text")), ignorenulls=True).over(before))


def with_context(turns: DataFrame, n: int = 3) -> DataFrame:
    """Each turn with the last n turns of its session, itself included."""
    window = Window.partitionBy("session_id").orderBy("seq").rowsBetween(1 - n, 0)
    return turns.withColumn("context", F.collect_list(F.struct("role", "text")).over(window))


def talk_time(segments: DataFrame) -> DataFrame:
    """Per session and speaker: segments and milliseconds, the longest first."""
    made = segments.groupBy("session_id", "speaker").agg(F.count("*").alias("segments"), F.sum("duration_ms").alias("ms"))
    return made.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ms"), "speaker")))


def usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens per month and tenant, with each month's total (tenant null); unnamed tenants as _unknown."""
    tenant, month = F.when(F.coalesce("tenant_id", F.lit("")) == "", "_unknown").otherwise(F.col("tenant_id")), F.date_format("ts", "yyyy-MM")
    named = calls.select(month.alias("month"), tenant.alias("tenant_id"), "prompt", "completion")
    sums = (F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    return named.groupingSets([("month", "tenant_id"), ("month",)], "month", "tenant_id").agg(*sums)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Per tenant: judged hits, accepted ones and their share (four decimals)."""
    made = feedback.groupBy("tenant_id").agg(F.count("*").alias("total"), F.count_if("accepted").alias("accepted"))
    return made.withColumn("rate", F.round(ratio(F.col("accepted"), F.col("total")), 4))


def admission_replay(sessions: DataFrame, limit: int, hours: int = 12) -> DataFrame:
    """At each opening the number of sessions still active, and whether the limit refuses it.

    sessions has tenant_id, session_id, opened and closed (null: until it
    expires). Only admitted sessions count, until they close or are `hours`
    old, so every decision needs those before it: a tenant's openings are one
    sorted stream of one task, which holds no more than `limit` ends.
    """
    schema = sessions.schema
    end = F.least(F.coalesce("closed", F.col("opened") + F.expr(f"interval {hours} hours")), F.col("opened") + F.expr(f"interval {hours} hours"))
    rows = sessions.select("tenant_id", "session_id", F.col("opened").alias("opened_at"), F.unix_micros(F.col("opened").cast("timestamp")).alias("at"), F.unix_micros(end.cast("timestamp")).alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ends = object(), []
        for b in batches:
            active, over = [], []
            for tenant, at, end in zip(*(b.column(c).to_pylist() for c in ("tenant_id", "at", "end"))):
                own, ends = tenant, ends if tenant == own else []
                while ends and ends[0] <= at:
                    heapq.heappop(ends)
                active.append(len(ends))
                over.append(len(ends) >= limit)
                if not over[-1]:
                    heapq.heappush(ends, end)
            yield pa.record_batch([b.column("tenant_id"), b.column("session_id"), b.column("opened_at"), pa.array(active, pa.int64()), pa.array(over, pa.bool_())], names=["tenant_id", "session_id", "opened_at", "active", "over"])

    kinds = ", ".join(f"{name} {schema[column].dataType.simpleString()}" for name, column in (("tenant_id", "tenant_id"), ("session_id", "session_id"), ("opened_at", "opened")))
    return rows.repartition("tenant_id").sortWithinPartitions("tenant_id", "at", "session_id").mapInArrow(run, f"{kinds}, active long, over boolean")


def active_sessions(sessions: DataFrame, now, hours: int = 12) -> DataFrame:
    """Sessions per tenant that are neither closed nor `hours` old at a moment."""
    live = (F.col("opened") <= now) & (F.col("opened") > now - F.expr(f"interval {hours} hours")) & (F.col("closed").isNull() | (F.col("closed") > now))
    return sessions.groupBy("tenant_id").agg(F.count_if(live).alias("active"))


def sessions_by_gap(events: DataFrame, seconds: int) -> DataFrame:
    """Runs of a user's events with no pause over `seconds` between them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    numbered = events.withColumn("opens", F.coalesce((gap > seconds * 1_000_000).cast("int"), F.lit(1))).withColumn("session_no", F.sum("opens").over(order))
    return numbered.groupBy("user_id", "session_no").agg(F.count("*").alias("events"), F.min("ts").alias("opened"), F.max("ts").alias("closed"))


def latest_wins(rows: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """Of the rows of a key, the first in the order `newest`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def retained(rows: DataFrame, keys: list[str], newest: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key in the order `newest`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
