"""Exact percentiles of groups of any size, and the studio's report."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import evaluation as E


@pytest.mark.parametrize("few", [3, 10_000])
def test_selection_in_hot_and_odd_groups(spark, few):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in np.round(rng.exponential(10, 4000), 2)] + [("same", 7.5)] * 900 + [("two", x) for x in [1.0] * 500 + [2.0] * 500]
    rows += [("wide", x) for x in (-1e300, 1e300, 0.0, 1e-300, 5.0)] + [("null", None)] * 3 + [(None, 1.0), (None, 2.0), (None, None), ("one", 4.0)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for share in (0.01, 0.5, 0.95, 1.0):
        got = {r["g"]: r["percentile"] for r in E.nearest_rank(table, ["g"], "v", share, few).collect()}
        for g in {g for g, _ in rows}:
            values = sorted(v for h, v in rows if h == g and v is not None)
            want = values[math.ceil(len(values) * share) - 1] if values else None
            assert got[g] == (want if want is None else pytest.approx(round(want, 3))), (g, share)
        assert len(got) == len({g for g, _ in rows})


def test_integers_and_several_keys(spark):
    rows = [(k % 3, k % 2, (k * 7919) % 1000) for k in range(3000)]
    got = {(r["a"], r["b"]): r["percentile"] for r in E.nearest_rank(spark.createDataFrame(rows, "a int, b int, v long"), ["a", "b"], "v", 0.9, 50).collect()}
    for key in got:
        values = sorted(v for a, b, v in rows if (a, b) == key)
        assert got[key] == values[math.ceil(len(values) * 0.9) - 1]


def test_check_metrics_of_a_hot_suite(spark):
    rows = [("s", k % 10 != 0, k % 50 == 0, False, float(k % 997)) for k in range(2000)]
    table = spark.createDataFrame(rows, "suite string, passed boolean, known_limitation boolean, misroute boolean, latency_ms double")
    assert E.check_metrics(table, ["suite"], 20).first().asDict() == E.check_metrics(table, ["suite"]).first().asDict()


@pytest.mark.parametrize("n", [1, 5, 20, 21, 40])
def test_studio_report(spark, n):
    runs = [(f"c{k}", ["d1", "d2"], ["x", "x", "d2", "d1"] if k % 3 else ["x", "y"], (k * 37) % 101) for k in range(n)]
    table = spark.createDataFrame(runs, "case_id string, expected array<string>, returned array<string>, latency_ms long")
    assert {(r["case_id"], r["rank"], r["hit"]) for r in E.studio_results(table).collect()} == {(c, 3 if "d2" in got else None, "d2" in got) for c, _, got, _ in runs}  # repeated ids keep their places
    got, ordered, hits = E.studio_report(table, few=4).first(), sorted(r[3] for r in runs), sum("d2" in r[2] for r in runs)
    assert (got["total"], got["hits"], got["recall_at_k"]) == (n, hits, round(hits / n, 4))
    assert got["mean_latency_ms"] == pytest.approx(round(sum(ordered) / n, 2), abs=0.011) and got["p95_latency_ms"] == ordered[max(0, min(n - 1, int(n * 0.95) - 1))]
    assert E.studio_report(table.limit(0)).count() == 0
    by = E.studio_report(table.withColumn("kb", F.lit("k")), ["kb"]).first()
    assert by["kb"] == "k" and by["total"] == n
