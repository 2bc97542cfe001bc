"""Every verdict on every document."""

from parlance.plans.queries import QUERIES


def test_every_verdict_is_reached(spark, small):
    rows = QUERIES["hallucination_judge_all"](spark, small)
    assert rows.count() == 5 * spark.read.parquet(f"{small}/documents.parquet").count()
    assert {r["reason"] for r in rows.select("reason").distinct().collect()} >= {None, "no speech", "low probability", "repeated word", "boilerplate"}
