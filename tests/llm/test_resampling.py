"""Importance resampling against brute force and its SQL, over the small tables and over odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm.resampling import KEY, bucket_counts, cutoff, op11_importance_resampling, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score long, rank string, row long, weight long"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    def feats(t):
        w = WORDS.findall(lower(t))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(place(f) for _, x in docs for f in feats(x)[1]), Counter(place(f) for x in target for f in feats(x)[1])
    total, wanted = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    rows = []
    for at, (doc_id, x) in enumerate(docs):
        n, f = feats(x)
        gains = [math.floor(1000 * math.log((t[place(g)] + 1.0) * total / ((s[place(g)] + 1.0) * wanted))) for g in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n, at])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(repr(tuple(r[:5])) for r in rows)


def rows_of(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    return sorted(repr(tuple(r)) for r in df.collect())


def test_query_by_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert rows_of(op11_importance_resampling(spark, small)) == brute(docs, target)


def test_query_equals_its_sql(spark, small):
    import duckdb

    from parlance.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(ORACLE_SQL["op11_importance_resampling"]).fetchall()
    assert rows_of(op11_importance_resampling(spark, small)) == sorted(map(repr, want))


@pytest.mark.parametrize("finish", [1, 40])
def test_odd_rows_ties_and_repeats(spark, finish):
    text = " ".join(f"w{k}" for k in range(25))
    docs = [(1, None), (2, ""), (3, "..., --"), (None, text), (None, text.upper()), (4, "é日本 " * 30), (5, "a-b c_d 1.5 " * 4000)]
    docs += [(7, text)] * 40 + [(k, f"{text} x{k % 3}") for k in range(100, 260)]  # repeats of one id tie in all but their own number
    made = spark.createDataFrame([(d, t, 1, "r", 2, 3) for d, t in docs], SCHEMA)
    target = spark.createDataFrame([("w1 w2 w3 x1 c d",), (None,), ("",)], "text string")
    for limits in ({}, {"percent": 50, "longest": 2, "buckets": 97}, {"percent": 100}, {"least_words": 1, "percent": 1}):
        got = rows_of(resample(made.repartition(4, "doc_id"), target, finish=finish, **limits))
        assert got == brute(docs, ["w1 w2 w3 x1 c d"], **{"percent": 10, "least": limits.pop("least_words", 20), **limits})
    assert rows_of(resample(made.limit(0), target)) == []
    assert rows_of(resample(made, target.limit(0), finish=finish)) == brute(docs, [])


@pytest.mark.parametrize("spread", [3, 10**12])
def test_cutoff_is_the_exact_key(spark, spread):
    rng = np.random.default_rng(spread)
    keys = [(int(a), int(z), int(i), k) for k, (a, z, i) in enumerate(zip(rng.integers(-spread, spread, 3000), rng.integers(0, 2, 3000), rng.integers(0, 5, 3000)))]
    table = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in KEY)).repartition(7)
    for k in (1, 2, 300, 1500, 2999, 3000):
        assert cutoff(table, 3000, k, finish=2) == sorted(keys)[k - 1]


def test_counts_of_many_tasks(spark):
    docs = spark.createDataFrame([(f"a{k % 11} b",) for k in range(200)], "text string").repartition(6).withColumn("bucket", F.lit(1))
    assert bucket_counts(docs, 50).sum() == 400
