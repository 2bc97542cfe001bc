"""Suites over golden cases, and what authors change."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import evaluation as E
from parlance.operators import studio as S


def _got(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_suites(spark):
    tts = spark.createDataFrame([("1", "3개", "세 개"), ("2", "3분", "세 분")], "case_id string, text string, expect string")
    assert _got(E.reading_suite(tts), "case_id", "passed") == [("1", True), ("2", False)]
    pii = spark.createDataFrame([("1", "a@b.co", ["email"], ["b.co"], None), ("2", "nothing", None, None, None), ("3", "a@b.co", ["card"], None, True), ("4", "nothing", [], ["thing"], None)], "case_id string, text string, expect_types array<string>, must_not_contain array<string>, known_limitation boolean")
    assert _got(E.masking_suite(pii), "case_id", "passed", "known_limitation") == [("1", True, False), ("2", True, False), ("3", False, True), ("4", False, False)]
    grounded = spark.createDataFrame([("1", "3원 [1]", ["3원"], True), ("2", "4원 [1]", ["3원"], True), ("3", "4원 [1]", ["3원"], False)], "case_id string, answer string, evidence array<string>, accept boolean")
    assert _got(E.grounding_suite(grounded), "case_id", "passed") == [("1", True), ("2", False), ("3", True)]
    intents = [("fee", "about fees", ["fee"], ["수수료 알려줘"]), ("agent", "", ["person"], ["사람이랑 통화할래요"])]
    cases = spark.createDataFrame([("1", "my FEE", "fee", intents), ("2", "수수료 알려줘 빨리", "fee", intents), ("3", "안녕", "", intents), ("4", "a person", "fee", intents), ("5", "hm", "fee", intents)], "case_id string, utterance string, expect string, intents array<struct<name:string,description:string,patterns:array<string>,examples:array<string>>>")
    checks = E.intent_suite(cases)
    assert _got(checks, "case_id", "passed", "misroute") == [("1", True, False), ("2", True, False), ("3", True, False), ("4", False, True), ("5", False, False)]
    assert [r["passed"] for r in E.intent_suite(cases, by_examples=False).orderBy("case_id").collect()] == [True, False, True, False, False]
    totals = E.check_metrics(checks, ["suite"]).first()
    assert (totals["total"], totals["passed"], totals["accuracy"], totals["misroutes"]) == (5, 3, 0.6, 1)


def test_retrieval_suite(spark):
    corpus = spark.createDataFrame([("A-1", "A-1 card fee", "the fee of a new card is three coins"), ("A-2", "A-2 opening hours", "we open at nine and close at six"), ("A-3", "A-3 loans", "loans need an income of some kind")], "doc_id string, title string, text string")
    cases = spark.createDataFrame([("1", "when do you open", ["A-2"]), ("2", "card fee", ["A-1", "A-3"]), ("3", "zebra", ["A-9"])], "case_id string, query string, expected array<string>")
    ranks, metrics = E.retrieval_suite(cases, corpus)
    assert {r["case_id"]: r["rank"] for r in ranks.collect()}["1"] == 1 and {r["case_id"]: r["rank"] for r in ranks.collect()}["3"] is None
    got = metrics.first()
    assert (got["cases"], got["hits"]) == (3, 2) and _got(E.not_first(ranks), "case_id") == [("3",)]


def test_changes(spark):
    rules = spark.createDataFrame([("t", 2, "b", "warn", "m", "x+", True), ("t", 1, "a", "block", "m", "y", True), ("t", 3, "a", "note", "m", "z*", False)], "tenant_id string, place int, rule_id string, severity string, message string, pattern string, enabled boolean")
    assert _got(S.rule_faults(rules), "rule_id", "problem") == [("a", "matches everything"), ("a", "repeated id")]
    assert [r["rule_id"] for r in S.exported_rules(rules).first()["rules"]] == ["a", "b"]
    said = spark.createDataFrame([("call me at a@b.co, y",)], "text string").crossJoin(S.exported_rules(rules))
    out = S.filtered(said, F.col("rules")).first()
    assert (out["clean_text"], out["kinds"], out["pii_masked"], [r["rule_id"] for r in out["matched_rules"]]) == ("call me at [EMAIL_MASKED], y", ["email"], True, ["a"])
    assert "hello" in S.boilerplate(["Hel-lo!"]) and "bye" in S.boilerplate()
    entry = "tenant_id string, version int, entries array<struct<surface:string,enabled:boolean>>"
    now, fresh = spark.createDataFrame([("a", 1, [("x", True)]), ("b", 1, [("x", True)])], entry), spark.createDataFrame([("a", 2, [("y", True), ("z", False), (" ", True)]), ("b", 1, [("other", True)]), ("c", 1, [("n", True)])], entry)
    assert {r["tenant_id"]: [e["surface"] for e in r["entries"]] for r in S.updated_lexicons(now, fresh).collect()} == {"a": ["y"], "b": ["x"], "c": ["n"]}
    scenario = spark.createDataFrame([("s", "t", "live", True, "hello")], "scenario string, tenant_id string, stage string, published boolean, entry_node string")
    bundle = S.exported_scenarios(scenario)
    back = S.imported_scenarios(bundle, "tenant_id string, stage string, entry_node string", "u").first()
    assert (back["scenario"], back["tenant_id"], back["stage"], back["published"], back["entry_node"]) == ("s", "u", "draft", False, "hello")
    with pytest.raises(Exception, match="not a bundle"):
        S.imported_scenarios(spark.createDataFrame([("{}",)], "json string"), "entry_node string", "u").collect()
    revisions = spark.createDataFrame([("a", "draft"), ("b", "draft"), ("c", "staging"), ("d", "live"), ("e", "draft")], "scenario string, stage string")
    wishes = spark.createDataFrame([("a", "built"), ("b", "built"), ("c", "live"), ("d", "draft")], "scenario string, wanted string")
    faults = spark.createDataFrame([("b", "n", "p")], "scenario string, node_id string, problem string")
    assert _got(S.promoted(revisions, wishes, faults), "scenario", "stage", "refused") == [("a", "built", None), ("b", "draft", "has problems"), ("c", "live", None), ("d", "live", "not the next stage"), ("e", "draft", None)]
    asked = spark.createDataFrame([("1", " 3원 [1] ", ["3원"]), ("2", "9원 [1]", ["3원"]), ("3", None, ["x"]), ("4", "x", [])], "query_id string, raw string, evidence array<string>")
    assert _got(S.composed_answers(asked), "query_id", "answer", "citations", "reason") == [("1", "3원 [1]", [1], None), ("2", "", [], "invented number"), ("3", "", [], "no generator"), ("4", "", [], "no evidence")]
    judged = spark.createDataFrame([("t", k, q, ok) for k, (q, ok) in enumerate([("a", False), ("b", False), ("a", True), ("b", False), ("c", False), ("d", False)])], "tenant_id string, ts int, query string, accepted boolean")
    assert _got(S.rejected_queries(judged, 5, 2), "query", "n", "rank") == [("b", 2, 1), ("d", 1, 2)]
