"""Personal data in forms that the base rules miss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm.pii import fit_pii, redact

FOUND = {
    "mail joe [at] x [dot] com now": "mail [EMAIL] now",
    "ask joe @ x.com please": "ask [EMAIL] please",
    "a@b.co [dot] uk end": "[EMAIL] end",
    "phone 1 743 555 3824 ok": "phone [PHONE] ok",
    "call 743-555-3824": "call [PHONE]",
    "(+1) 743 555 3824 x": "[PHONE] x",
    "ip 10 . 0 . 0 . 1 x": "ip [IP] x",
    "10[.]20[.]30[.]40": "[IP]",
    "card 4111.1111.1111.1111 z": "card [CARD] z",
}
LEFT = ["4111.1111.1111.1112 bad", "999[.]20[.]30[.]40", "hash ab743555382499fe x", "x @ 7.25 each", "in 2024 and 1999, 2001-02-03 we", "order 7435553824 no"]


@pytest.fixture(scope="module")
def model(spark, small):
    return fit_pii(spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet"))


def test_other_forms_are_found(spark, model):
    texts = [*FOUND, *LEFT, "joe@x.com. Then we"]
    rows = redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, "doc_id").collect()
    got = {texts[r["doc_id"]]: r["text"] for r in rows}
    assert got == {**FOUND, **{t: t for t in LEFT}, "joe@x.com. Then we": "[EMAIL]. Then we"}


def test_no_examples_no_model(spark):
    assert fit_pii(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("only words").alias("text"))) is None


def test_texts_with_very_many_matches(spark):
    """Thousands of spans over many pages: the same as by one pass of each pattern, in time that stays near the number of matches."""
    import random
    import time

    from test_operators import base_spans

    from parlance.llm.pii import KINDS, find_pii

    rng = random.Random(1)
    parts = ["10.0.0.1 ", "é a@b.cc, ", "card 4111 1111 1111 1111; ", "+1 (555) 123-4567 ", "word ", "한글 " * 30, "256.1.1.1 ", "x" * 5000, "+1 10.0.0.2 33 4567 "]
    mixed = "".join(rng.choice(parts) for _ in range(1500))
    texts = {1: mixed, 2: "10.0.0.1 " * 3000, 3: "y" * 4095 + "a@b.cc", 4: "z" * 4096 + "10.0.0.1", 5: "10.0.0.1"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in find_pii(rows, None, "doc_id").collect():
        assert [tuple(s) for s in r["base"]] == base_spans(texts[r["doc_id"]])
    for r in redact(rows, None, "doc_id").collect():
        text, out, at = texts[r["doc_id"]], [], 0
        for start, kind, end in base_spans(text):
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = max(at, end)
        assert r["text"] == "".join(out) + text[at:]
    began = time.perf_counter()
    assert find_pii(spark.createDataFrame([(1, "10.0.0.1 " * 20_000)], "doc_id long, text string"), None).select(F.size("base")).first()[0] == 20_000
    assert time.perf_counter() - began < 15  # a fold that copies took 26 s


def test_trees_see_every_feature_row(spark):
    """What only rare feature rows tell apart, behind thousands of more frequent ones, is learned; dealing the rows otherwise changes nothing."""
    from parlance.llm.pii import FEATURES, KINDS, _scores, fit_counted

    i = F.col("id")
    rare = i >= 6000
    told = {"kind_no": F.lit(KINDS.index("phone")), "plus": F.when(rare, 0).otherwise(i % 2), "cue": F.when(rare, i % 2).otherwise(0), "length": (i / 2).cast("int") % 200, "before": (i / 400).cast("int")}
    counted = spark.range(9000).select(*(told.get(f, F.lit(0)).cast("int").alias(f) for f in FEATURES), (i % 2).cast("int").alias("y"), F.when(i % 10 < 2, 1).otherwise(0).alias("aside"), F.when(rare, 1).otherwise(9).cast("long").alias("count"))
    model = fit_counted(counted)
    assert model == fit_counted(counted.repartition(7, "length"))
    x = np.zeros((2, len(FEATURES)), int)
    x[:, 0], x[:, FEATURES.index("before")], x[:, FEATURES.index("length")], x[1, FEATURES.index("cue")] = KINDS.index("phone"), 16, 50, 1
    without, with_cue = _scores(model[KINDS.index("phone")][0], x)
    assert with_cue > 1 > -1 > without


def test_trees_are_fitted_in_sql_alone(spark):
    """No plan of a fit runs Python, and a row's score in SQL is the one of arrays, for trees of all depths."""
    from parlance.llm.pii import FEATURES, KINDS, _scored, _scores, fit_counted

    i, phone = F.col("id"), KINDS.index("phone")
    told = {"kind_no": F.lit(phone), "cue": i % 2, "length": i % 7 - 2}
    counted = spark.range(200).select("id", *(told.get(f, F.lit(0)).cast("int").alias(f) for f in FEATURES), ((i % 2 == 1) & (i % 7 > 1)).cast("int").alias("y"), (i % 10 < 2).cast("int").alias("aside"), F.lit(3).cast("long").alias("count"))
    plans = spark._jsparkSession.sharedState().statusStore()
    before = plans.executionsCount()
    model = fit_counted(counted)
    made = [plans.executionsList().apply(k).physicalPlanDescription() for k in range(before, plans.executionsCount())]
    assert len(made) > 12 and not [p for p in made if "Arrow" in p or "Pandas" in p or "Python" in p]
    cue, length = FEATURES.index("cue"), FEATURES.index("length")
    for trees in (model[phone][0], (0.5, []), (-1e-9, [0.25, (cue, 0, -1.5, (length, 2, 1e-7, 3.0)), (length, -1, (cue, 0, 1.0, 2.0), 4.0)])):
        rows = counted.select(*FEATURES, _scored({phone: trees}).alias("s")).collect()
        assert [r["s"] for r in rows] == _scores(trees, np.array([r[:-1] for r in rows])).tolist()
    assert counted.select(_scored({0: (0.0, [])}).alias("s")).where("s is not null").count() == 0
