"""Lexicons and readings of many tenants against the single-tenant functions and against one pattern for each tenant."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.speech import spoken
from parlance.operators import lexicons as L

LEXICON = "tenant_id string, version int, entries array<struct<surface:string,variants:array<string>,enabled:boolean>>"
READINGS = "tenant_id string, version int, entries array<struct<surface:string,reading:string>>"
WAYS = [{}, {"broadcast_chars": 0, "part_rows": 7}]


def _plain(text, entries, most=500):
    """One alternation, longest form first."""
    known = {}
    for e in [e for e in entries if e["enabled"] is not False and e["surface"].strip()][:most]:
        for form in (e["surface"].strip(), *(e["variants"] or ())):
            bare = "".join(form.split())
            if len(bare) >= 2:
                known.setdefault(bare, e["surface"].strip())
    if not known or text is None:
        return text
    pattern = "|".join(r"\s*".join(map(re.escape, form)) for form in sorted(known, key=len, reverse=True))
    return re.sub(pattern, lambda m: known["".join(m[0].split())], text)


@pytest.mark.parametrize("limits", WAYS)
def test_many_tenants_in_one_plan(spark, limits):
    rng = random.Random(4)
    word = lambda n=6: "".join(rng.choice("abcd .가나\t") for _ in range(rng.randint(1, n)))
    entry = lambda: {"surface": word(), "variants": rng.choice([None, [word(4) for _ in range(rng.randint(0, 5))]]), "enabled": rng.choice([True, True, True, False, None])}
    lexicons = [(f"t{k}", v, [entry() for _ in range(rng.randint(0, 12))]) for k in range(12) for v in (1, 2)]
    events = [(k, rng.choice([*(f"t{j}" for j in range(13)), "t1", "t1", None]), rng.choice([None, "", word(60), word(60), word(60)]), k) for k in range(400)]
    made = spark.createDataFrame(events, "event_id long, tenant_id string, text string, _n int").repartition(3)
    got = L.corrected_by_tenant(made, spark.createDataFrame(lexicons, LEXICON), **limits)
    assert got.columns == made.columns
    newest = {t: e for t, v, e in lexicons if v == 2}
    want = sorted((k, repr(tenant), repr(_plain(text, newest[tenant]) if tenant in newest else text)) for k, tenant, text, _ in events)
    assert sorted((r["event_id"], repr(r["tenant_id"]), repr(r["text"])) for r in got.collect()) == want


@pytest.mark.parametrize("limits", WAYS)
def test_one_tenant_equals_the_column_function(spark, limits):
    entries = [("무배당 행복플러스보험", ["무배담 행복플러스"]), ("행복플러스", ["행복 플러쓰"]), ("the price", ["thepryce"])]
    rows = spark.createDataFrame([(k, "a", t) for k, t in enumerate(["무 배담행복 플러스 와 행복플러쓰", "t h epryce of 행복플러스", "none", ""])], "k int, tenant_id string, text string")
    table = spark.createDataFrame([("a", 1, [(s, v, True) for s, v in entries])], LEXICON)
    got = {r["k"]: r["text"] for r in L.corrected_by_tenant(rows, table, **limits).collect()}
    assert got == {r["k"]: r["t"] for r in rows.select("k", T.corrected(F.col("text"), [(s, tuple(v)) for s, v in entries]).alias("t")).collect()}


def test_only_the_first_entries_count(spark):
    table = spark.createDataFrame([("a", 1, [("", ["zz"], True), ("one", ["xx"], True), ("two", ["yy"], True), ("off", ["xx", "ww"], False)])], LEXICON)
    rows = spark.createDataFrame([("a", "xx yy zz ww")], "tenant_id string, text string")
    assert L.corrected_by_tenant(rows, table, most=1).first()["text"] == "one yy zz ww"
    assert L.corrected_by_tenant(rows, table).first()["text"] == "one two zz ww"
    assert L.corrected_by_tenant(rows, table.limit(0)).first()["text"] == "xx yy zz ww"


@pytest.mark.parametrize("limits", WAYS)
def test_readings_by_tenant(spark, limits):
    known = {"행복플러스": "해피", "무배당행복플러스": "무배당 행복", "A": "에이스"}
    rows = spark.createDataFrame([("a", "무배당 행복 플러스와 행복플러스 3개 A"), ("b", "행복플러스 3개")], "tenant_id string, text string")
    table = spark.createDataFrame([("a", 3, list(known.items())), ("a", 2, [("행복플러스", "x")])], READINGS)
    got = {r["tenant_id"]: r["text"] for r in L.spoken_by_tenant(rows, table, **limits).collect()}
    want = {r["tenant_id"]: r["t"] for r in rows.select("tenant_id", F.when(F.col("tenant_id") == "a", spoken(F.col("text"), known)).otherwise(spoken(F.col("text"))).alias("t")).collect()}
    assert got == want


def test_streams_take_the_table_of_forms(spark, tmp_path):
    spark.createDataFrame([("a", "thepryce"), ("b", "thepryce")], "tenant_id string, text string").write.json(f"file://{tmp_path}/in")
    table = spark.createDataFrame([("a", 1, [("the price", ["thepryce"], True)])], LEXICON)
    stream = spark.readStream.schema("tenant_id string, text string").json(f"file://{tmp_path}/in")
    made = L.corrected_by_tenant(stream, table)
    made.writeStream.format("memory").queryName("corrected_stream").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("corrected_stream").collect()} == {("a", "the price"), ("b", "thepryce")}


def test_prompts_take_what_fits(spark):
    table = spark.createDataFrame([("a", 1, [("x" * 90, [], True), (" y ", [], True), ("z" * 120, [], True), ("w", [], True)]), ("b", 1, [])], LEXICON)
    assert {r["tenant_id"]: r["prompt"] for r in L.prompts(table).collect()} == {"a": "x" * 90 + ", y", "b": ""}
    from parlance.functions.text import recognition_prompt

    assert recognition_prompt(["x" * 90, " y ", "z" * 120, "w"]) == "x" * 90 + ", y"
