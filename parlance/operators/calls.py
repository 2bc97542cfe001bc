"""Whole calls from their events: counts, rules in the order in which they were first hit, hand-off, and the turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import role_label, strip
from parlance.operators.analytics import MAX_TURNS

#: Columns of a call's events: kind is utterance, bot or closed; what a kind lacks is null.
EVENTS = "session_id string, tenant_id string, seq long, kind string, channel string, speaker_id string, text string, is_final boolean, pii_masked boolean, rule_ids array<string>, handed_off boolean"
CALL = "session_id string, tenant_id string, utterances long, masked long, rule_hits array<string>, bot_turns long, handed_off boolean, truncated boolean, closed_seq long, turns array<struct<speaker:string,text:string>>"


def counted_utterance():
    """Final utterances that say something."""
    return (F.col("kind") == "utterance") & F.coalesce(F.col("is_final"), F.lit(False)) & (strip(F.coalesce("text", F.lit(""))) != "")


def closed_calls(events: DataFrame, most: int = MAX_TURNS) -> DataFrame:
    """A row of CALL for each session that has closed, of what came before its first closing.

    events has the columns of EVENTS, seq distinct in a session. All
    utterances count; of the turns the first `most` stay, flagged when cut. A
    rule counts once, where it was first hit. Sessions that never close give
    no row. Nothing larger than a call's `most` turns is collected.
    """
    end = events.where("kind = 'closed'").groupBy("session_id").agg(F.min("seq").alias("closed_seq"))
    rows = events.join(end, "session_id").where(F.col("seq") < F.col("closed_seq"))
    said = rows.where(counted_utterance()).withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))
    turn = F.when(F.col("place") <= most, F.struct("place", role_label(F.col("speaker_id"), F.col("channel")).alias("speaker"), strip("text").alias("text")))
    spoken = said.groupBy("session_id").agg(
        F.count("*").alias("utterances"), F.count_if("pii_masked").alias("masked"), F.array_sort(F.collect_list(turn)).alias("turns"),
    )
    first = said.select("session_id", "seq", F.posexplode("rule_ids").alias("at", "rule_id")).groupBy("session_id", "rule_id").agg(F.min(F.struct("seq", "at")).alias("first"))
    rules = first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "rule_id"))), lambda x: x["rule_id"]).alias("rule_hits"))
    bots = rows.where("kind = 'bot'").groupBy("session_id").agg(F.count("*").alias("bot_turns"), F.max(F.coalesce("handed_off", F.lit(False))).alias("handed_off"))
    tenants = events.groupBy("session_id").agg(F.min_by("tenant_id", "seq").alias("tenant_id"))
    whole = end.join(tenants, "session_id").join(spoken, "session_id", "left").join(rules, "session_id", "left").join(bots, "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    turns = F.coalesce(F.transform("turns", lambda t: F.struct(t["speaker"], t["text"])), F.expr("cast(array() as array<struct<speaker:string,text:string>>)"))
    return whole.select(
        "session_id", "tenant_id", zero("utterances"), zero("masked"), F.coalesce("rule_hits", F.expr("cast(array() as array<string>)")).alias("rule_hits"), zero("bot_turns"), F.coalesce("handed_off", F.lit(False)).alias("handed_off"),
        (F.coalesce("utterances", F.lit(0)) > most).alias("truncated"), "closed_seq", turns.alias("turns"),
    )
