"""What authors change and try: rules, lexicons, scenarios and answers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import BOILERPLATE, grounding_verdict, masked, masked_kinds, matched_rules, strip
from parlance.operators.dialogue import promotion_fault
from parlance.operators.evaluation import repeated

FORMAT = "scenario/1"


def filtered(events: DataFrame, rules: Column) -> DataFrame:
    """Utterances as the filter passes them on: clean_text, kinds of masked data, pii_masked, and the rules that the raw text has.

    rules is an array of (rule_id, severity, message, pattern), of a tenant or tried out; personal data is masked always.
    """
    kinds = masked_kinds(F.col("text"))
    return events.select("*", masked(F.col("text")).alias("clean_text"), kinds.alias("kinds"), (F.size(kinds) > 0).alias("pii_masked"), matched_rules(F.col("text"), rules).alias("matched_rules"))


def patterns_checked(rules: DataFrame, most: int = 500) -> DataFrame:
    """(rule_id, problem) of patterns that can't be used: blank, too long, broken, or matching the empty text.

    Patterns are compiled by Python in Arrow batches, since one that Java can't
    compile would end the query.
    """

    def fault(pattern: str | None) -> str | None:
        if not (pattern or "").strip():
            return "blank"
        if len(pattern) > most:
            return "too long"
        try:
            return "matches everything" if re.search(pattern, "") else None
        except re.error:
            return "broken"

    def run(batches):
        for b in batches:
            bad = [(i, f) for i, p in zip(b.column("rule_id").to_pylist(), b.column("pattern").to_pylist()) if (f := fault(p))]
            yield pa.record_batch([pa.array([i for i, _ in bad], b.column("rule_id").type), pa.array([f for _, f in bad], pa.string())], names=["rule_id", "problem"])

    return rules.select("rule_id", "pattern").mapInArrow(run, f"rule_id {rules.schema['rule_id'].dataType.simpleString()}, problem string")


def rule_faults(rules: DataFrame) -> DataFrame:
    """(rule_id, problem) of a draft (rule_id, pattern): ids used twice, and patterns that can't be used."""
    twice = repeated(rules, "rule_id").select("rule_id", F.lit("repeated id").alias("problem"))
    return twice.unionByName(patterns_checked(rules))


def exported_rules(rules: DataFrame) -> DataFrame:
    """Per tenant its enabled rules in their order (place), as one array: what a filter loads."""
    fields = F.struct("rule_id", "severity", "message", "pattern")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", fields.alias("rule")))), lambda x: x["rule"])
    return rules.where("enabled").groupBy("tenant_id").agg(ordered.alias("rules"))


def boilerplate(extra: list[str] = ()) -> list[str]:
    """Fixed texts that recognisers invent in silence, with further ones in the same bare form."""
    bare = lambda t: "".join(c for c in t.lower() if c.isalnum())
    return sorted({*BOILERPLATE, *(b for b in map(bare, extra) if b)})


def updated_lexicons(current: DataFrame, fresh: DataFrame, most: int = 500) -> DataFrame:
    """Lexicons (tenant_id, version, entries) after fresh ones: another version replaces, the same one changes nothing; the first `most` enabled entries count."""
    kept = F.slice(F.filter("entries", lambda e: e["enabled"] & (strip(e["surface"]) != "")), 1, most)
    newer = fresh.select("tenant_id", "version", kept.alias("entries")).join(current.select("tenant_id", F.col("version").alias("_had")), "tenant_id", "left").where("_had is null or _had <> version").drop("_had")
    return current.join(newer.select("tenant_id"), "tenant_id", "left_anti").unionByName(newer)


def exported_scenarios(scenarios: DataFrame) -> DataFrame:
    """(scenario, json) bundles of scenario rows, with the name of their format."""
    fields = [c for c in scenarios.columns if c not in ("scenario", "published")]
    return scenarios.select("scenario", F.to_json(F.struct(F.lit(FORMAT).alias("format"), "scenario", *fields)).alias("json"))


def imported_scenarios(bundles: DataFrame, schema: str, tenant_id: str) -> DataFrame:
    """Scenarios of bundles (json), for a tenant and as drafts; another format is an error."""
    rows = bundles.select(F.from_json("json", f"format string, scenario string, {schema}").alias("s"))
    checked = F.when(F.col("s.format") == FORMAT, F.col("s.scenario")).otherwise(F.raise_error(F.concat(F.lit("not a bundle of "), F.lit(FORMAT))))
    names = [f.name for f in rows.schema["s"].dataType.fields if f.name not in ("format", "scenario", "tenant_id", "stage")]
    return rows.select(checked.alias("scenario"), F.lit(tenant_id).alias("tenant_id"), F.lit("draft").alias("stage"), F.lit(False).alias("published"), *(F.col(f"s.{n}") for n in names))


def promoted(revisions: DataFrame, wanted: DataFrame, problems: DataFrame) -> DataFrame:
    """Revisions (scenario, stage, ...) after wishes (scenario, wanted), with `refused`: why a wish was not granted.

    A scenario goes one stage at a time; it is built only without problems.
    """
    bad = problems.select("scenario", F.lit(True).alias("_bad")).distinct()
    rows = revisions.join(wanted, "scenario", "left").join(bad, "scenario", "left")
    fault = F.coalesce(promotion_fault(F.col("stage"), F.col("wanted")), F.when((F.col("wanted") == "built") & F.col("_bad"), "has problems"))
    rows = rows.withColumn("refused", F.when(F.col("wanted").isNotNull(), fault))
    return rows.withColumn("stage", F.when(F.col("wanted").isNotNull() & F.col("refused").isNull(), F.col("wanted")).otherwise(F.col("stage"))).drop("wanted", "_bad")


def restored(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Versions (scenario, version) of a history as drafts again."""
    return history.join(wanted, ["scenario", "version"], "left_semi").withColumn("stage", F.lit("draft"))


def composed_answers(asked: DataFrame) -> DataFrame:
    """Answers (query_id, raw, evidence) as they may be shown: the text and its citations, or no text and the reason."""
    reason = F.when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "no evidence").when(F.col("raw").isNull(), "no generator").otherwise(grounding_verdict(F.col("raw"), F.col("evidence")))
    rows = asked.withColumn("reason", reason)
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("raw", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))))
    return rows.select("query_id", F.when(F.col("reason").isNull(), strip(F.col("raw"))).otherwise("").alias("answer"), F.when(F.col("reason").isNull(), cited).otherwise(F.expr("cast(array() as array<int>)")).alias("citations"), "reason")


def rejected_queries(feedback: DataFrame, newest: int = 5000, k: int = 10) -> DataFrame:
    """Per tenant the k queries rejected most among its newest judgements (tenant_id, ts, query, accepted); ties to the newest."""
    recent = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("ts"), "query"))
    counted = feedback.withColumn("_k", recent).where(F.col("_k") <= newest).where("not accepted").groupBy("tenant_id", "query").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("n"), F.desc("last"), "query"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).drop("last")


def live_dialogues(states: DataFrame, now: Column, hours: int = 4) -> DataFrame:
    """Dialogue states (session_id, updated_at, finished) that have not ended and are not too old."""
    return states.where(~F.col("finished") & (F.col("updated_at") > now - F.expr(f"interval {hours} hours")))


def diarised(segments: DataFrame) -> DataFrame:
    """Final segments of meetings: only these are told apart by speaker."""
    return segments.where((F.col("profile") == "meeting") & F.col("is_final"))
