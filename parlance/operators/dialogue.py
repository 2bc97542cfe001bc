"""Dialogues by scenario: checking scenarios, changing them, and playing utterances through them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.governance import closure
from parlance.operators.ordered import Fold

# --- fixed values: results depend on them ---------------------------------------
MAX_CHAIN = 12
STAGES = ("draft", "built", "staging", "live")
NO_ANSWER = "\0무응답\0"
GIVE_UP = "죄송합니다. 상담원에게 연결해 드리겠습니다."
# -------------------------------------------------------------------------------

#: Columns of a scenario's nodes.
NODE = "scenario string, node_id string, kind string, prompt string, reprompt string, next_node string, slot string, max_retries int, intents array<struct<name:string,patterns:array<string>,next_node:string>>"


def steps(nodes: DataFrame) -> DataFrame:
    """(scenario, node_id, target, label) of all ways out of the nodes."""
    after = nodes.select("scenario", "node_id", F.col("next_node").alias("target"), F.lit("next").alias("label"))
    by_intent = nodes.select("scenario", "node_id", F.explode("intents").alias("i")).select("scenario", "node_id", F.col("i.next_node").alias("target"), F.concat(F.lit("intent:"), "i.name").alias("label"))
    return after.unionByName(by_intent).where("target <> ''")


def scenario_problems(scenarios: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scenario, node_id, problem): scenarios has scenario, entry_node and fallback_node (empty: none).

    Patterns are compiled by Python in Arrow batches, since one that Java can't
    compile would end the query.
    """
    key = lambda scenario, node: F.concat_ws("/", scenario, node)
    ids = nodes.select("scenario", F.col("node_id").alias("target")).distinct()
    named = scenarios.select("scenario", F.explode(F.array(F.struct(F.lit("no entry node").alias("problem"), F.col("entry_node").alias("target")), F.struct(F.lit("no fallback node").alias("problem"), F.col("fallback_node").alias("target")))).alias("x")).select("scenario", "x.*").where("target <> ''")
    missing = named.join(ids, ["scenario", "target"], "left_anti").select("scenario", F.col("target").alias("node_id"), "problem")
    dangling = steps(nodes).join(ids, ["scenario", "target"], "left_anti").select("scenario", "node_id", F.concat(F.lit("no target of "), "label").alias("problem"))
    asks = nodes.where("kind = 'ask'").select("scenario", "node_id", F.explode(F.array_compact(F.array(F.when(F.coalesce(F.size("intents"), F.lit(0)) < 1, "ask without intents"), F.when(F.coalesce("reprompt", F.lit("")) == "", "ask without reprompt")))).alias("problem"))
    patterns = nodes.select("scenario", "node_id", F.explode("intents").alias("i")).select("scenario", "node_id", "i.name", F.explode("i.patterns").alias("pattern"))

    def compiled(batches):
        import pyarrow as pa

        for b in batches:
            bad = []
            for row in b.to_pylist():
                try:
                    re.compile(row["pattern"] or "")
                except re.error:
                    bad.append({"scenario": row["scenario"], "node_id": row["node_id"], "problem": f"pattern of {row['name']}"})
            yield pa.RecordBatch.from_pylist(bad, pa.schema([("scenario", pa.string()), ("node_id", pa.string()), ("problem", pa.string())]))

    broken = patterns.mapInArrow(compiled, "scenario string, node_id string, problem string")
    ways = steps(nodes).select(key("scenario", "node_id").alias("src"), key("scenario", "target").alias("dst"))
    reached = closure(ways, scenarios.select(key("scenario", "entry_node").alias("node")))
    people = nodes.where("kind = 'handoff'").select("scenario", "node_id", key("scenario", "node_id").alias("node"))
    by_fallback = scenarios.join(people.select("scenario", F.col("node_id").alias("fallback_node")), ["scenario", "fallback_node"], "left_semi").select("scenario")
    served = people.join(reached.select("node"), "node", "left_semi").select("scenario").unionByName(by_fallback).distinct()
    alone = scenarios.join(served, "scenario", "left_anti").select("scenario", F.lit("").alias("node_id"), F.lit("no way to a person").alias("problem"))
    return missing.unionByName(dangling).unionByName(asks).unionByName(broken).unionByName(alone)


def promotion_fault(current: Column, wanted: Column) -> Column:
    """Why a scenario can't go from one stage to another, or null: it goes one step at a time."""
    at = lambda c: F.array_position(F.array(*map(F.lit, STAGES)), c)
    return F.when(current == wanted, "already there").when((at(wanted) == 0) | (at(wanted) != at(current) + 1), "not the next stage")


def after_edit(revisions: DataFrame) -> DataFrame:
    """Edited revisions are drafts again, without recorded problems."""
    return revisions.withColumn("stage", F.lit("draft")).withColumn("problems", F.expr("cast(array() as array<string>)"))


def cloned(nodes: DataFrame, scenario: str, node_ids: list[str], suffix: str) -> DataFrame:
    """The nodes with copies of some of a scenario's, under ids with a suffix; ways among the copied ones lead to the copies.

    No suffix, no such node, and ids that exist already are errors.
    """
    if not suffix:
        raise ValueError("copies need a suffix")
    inside = nodes.where((F.col("scenario") == scenario) & F.col("node_id").isin(*node_ids))
    names = [r["node_id"] for r in inside.select("node_id").collect()]  # no more than the ids that were asked for
    if not names:
        raise ValueError("no such node")
    taken = nodes.where((F.col("scenario") == scenario) & F.col("node_id").isin(*(n + suffix for n in names)))
    if not taken.isEmpty():
        raise ValueError("ids of copies exist already")
    moved = lambda c: F.when(c.isin(*names), F.concat(c, F.lit(suffix))).otherwise(c)
    intents = F.transform("intents", lambda i: i.withField("next_node", moved(i["next_node"])))
    copies = inside.withColumn("node_id", moved(F.col("node_id"))).withColumn("next_node", moved(F.col("next_node"))).withColumn("intents", intents)
    return nodes.unionByName(copies)


class _Scenario:
    """One scenario's nodes, and the moves through them."""

    def __init__(self, nodes: list[dict], entry: str, fallback: str):
        self.nodes, self.entry, self.fallback = {n["node_id"]: n for n in nodes}, entry, fallback

    def intent(self, node: dict, text: str) -> dict | None:
        return next((i for i in node["intents"] or () if any(re.search(p, text, re.IGNORECASE) for p in i["patterns"] or ())), None)

    def give_up(self, s: dict) -> list[tuple[str, str]]:
        s["retries"] = 0
        if self.fallback in self.nodes:
            return self.go(s, self.fallback, s["falls"] + 1)
        s["finished"] = s["handed_off"] = True
        return [("__fallback__", GIVE_UP)]

    def go(self, s: dict, at: str, falls: int = 0) -> list[tuple[str, str]]:
        said, s["falls"] = [], falls
        for _ in range(MAX_CHAIN):
            if not at:
                s["finished"] = True
                return said
            node = self.nodes.get(at)
            if node is None:
                break
            s["node"] = at
            if node["kind"] == "branch":
                found = self.intent(node, " ".join(s["slots"].values()))
                at = (found["next_node"] if found else "") or node["next_node"]
                continue
            said.append((at, node["prompt"]))
            if node["kind"] == "say":
                at = node["next_node"]
                continue
            s["retries"] = 0
            s["handed_off"] = node["kind"] == "handoff"
            s["finished"] = node["kind"] != "ask"
            return said
        if falls > 1:  # the fallback itself leads nowhere
            s["finished"] = s["handed_off"] = True
            return [("__fallback__", GIVE_UP)]
        return self.give_up(s)

    def reply(self, s: dict, text: str, chosen: str | None) -> list[tuple[str, str]]:
        node = self.nodes.get(s["node"])
        if s["finished"]:
            return []
        if node is None:
            return self.give_up(s)
        if node["kind"] != "ask":
            return self.go(s, node["next_node"])
        found = self.intent(node, text) or next((i for i in node["intents"] or () if chosen and i["name"] == chosen), None)
        if found is not None:
            s["retries"] = 0
            if node["slot"]:
                s["slots"][node["slot"]] = text.strip()
            return self.go(s, found["next_node"] or node["next_node"])
        s["retries"] += 1
        if s["retries"] > (node["max_retries"] or 0):
            return self.give_up(s)
        return [(s["node"], node["reprompt"] or node["prompt"])]


def played(utterances: DataFrame, nodes: list[dict], entry: str, fallback: str = "") -> DataFrame:
    """Sessions played through a scenario: per utterance the bot's answers and the state after it.

    utterances has session_id, seq, text (null: no answer came) and intent (a
    classifier's choice, null: none), which counts only where no pattern fits
    and the node has it. The row with seq -1 is the opening. nodes are the
    scenario's, as dicts of the columns of NODE: settings, bounded by its author.
    """
    said = utterances.select("session_id", F.col("seq").cast("int").alias("seq"), "text", "intent")
    return dialogue(nodes, entry, fallback, utterances.schema["session_id"].dataType.simpleString()).over(said)


def dialogue(nodes: list[dict], entry: str, fallback: str, kind: str) -> Fold:
    """The moves of sessions through a scenario; kind is the type of session_id."""
    scenario = _Scenario(nodes, entry, fallback)

    def row(s: dict, session, seq: int, said: list[tuple[str, str]]) -> dict:
        return {"session_id": session, "seq": seq, "said": [{"node_id": n, "text": t} for n, t in said], "node_id": s["node"], "slots": dict(s["slots"]), "retries": s["retries"], "handed_off": s["handed_off"], "finished": s["finished"]}

    def start() -> dict:
        return {"node": entry, "slots": {}, "retries": 0, "handed_off": False, "finished": False, "open": False, "falls": 0}

    def step(s: dict, r: dict) -> list[dict]:
        out = []
        if not s["open"]:
            s["open"] = True
            out.append(row(s, r["session_id"], -1, scenario.go(s, entry)))
            out[-1] |= {"node_id": s["node"], "handed_off": s["handed_off"], "finished": s["finished"]}
        said = scenario.reply(s, NO_ANSWER if r["text"] is None else r["text"], r["intent"])
        return [*out, row(s, r["session_id"], r["seq"], said)]

    schema = f"session_id {kind}, seq int, said array<struct<node_id:string,text:string>>, node_id string, slots map<string,string>, retries int, handed_off boolean, finished boolean"
    return Fold("session_id", ("seq",), schema, start, step)
