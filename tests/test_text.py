from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import governance as G
from parlance.operators import retrieval as R


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_masks_by_kind(spark):
    assert _one(spark, T.masked(F.col("t")), t="010-1234-5678로 연락") == "[PHONE_MASKED]로 연락"
    assert _one(spark, T.masked_kinds(F.col("t")), t="1234-5678-9012-3456, a.b@c.co") == ["card", "email"]
    assert _one(spark, T.masked(F.col("t")), t="26-06-15 12,000원") == "26-06-15 12,000원"
    assert _one(spark, T.masked(F.col("t")), t=None) is None


def test_tokens(spark):
    assert _one(spark, T.tokens(F.col("t")), t="재발급 수수료 A 카드") == ["재발급", "재발", "발급", "수수료", "수수", "수료", "카드"]
    assert _one(spark, T.tokens(F.col("t")), t=None) == []


def test_grounding(spark):
    verdict = T.grounding_verdict(F.col("a"), F.col("e"))
    evidence = ["연회비는 3,000원입니다", "다른 근거"]
    assert _one(spark, verdict, a="연회비는 3000원입니다 [1]", e=evidence) is None
    assert _one(spark, verdict, a="연회비는 5000원입니다 [1]", e=evidence) == "invented number"
    assert _one(spark, verdict, a="연회비는 3000원입니다 [3]", e=evidence) == "unknown citation"
    assert _one(spark, verdict, a="연회비는 3000원입니다", e=evidence) == "no citation"
    assert _one(spark, verdict, a="무조건 면제됩니다 [2]", e=evidence) == "over-promise"
    assert _one(spark, verdict, a="가" * 138 + " [1]", e=evidence) is None and _one(spark, verdict, a="가" * 141 + " [1]", e=evidence) == "too long"


def test_hallucination(spark):
    verdict = T.hallucination_verdict(F.col("t"), F.col("n"), F.col("p"))
    assert _one(spark, verdict, t="감사합니다.", n=0.3, p=-0.1) == "boilerplate"
    assert _one(spark, verdict, t="감사합니다.", n=0.1, p=-0.1) is None
    assert _one(spark, verdict, t="네 네 네 네", n=0.1, p=-0.1) == "repeated word"
    assert _one(spark, verdict, t="...", n=0.1, p=-0.1) is None and _one(spark, verdict, t=" \n", n=0.1, p=-0.1) == "empty"


def test_json_in_fences(spark):
    assert _one(spark, T.json_object(F.col("t"), "a int")["a"], t='Sure: {"a": 3} done') == 3
    assert _one(spark, T.json_object(F.col("t"), "a int")["a"], t="nothing") is None


def test_expansion_in_order(spark):
    lexicon = [("비용", ("수수료",)), ("공짜", ("면제",))]
    assert _one(spark, R.expanded(F.col("t"), lexicon), t="공짜 비용") == "공짜 비용 수수료 면제"


def test_chunks_by_rule():
    text = "\n\n".join(["제1조 목적", "가" * 1500, "나. " * 50, "제2조 정의"])
    assert R.split_text("") == [] and R.split_text(" \n\n ") == []
    assert R.split_text(text)[-1].endswith("제2조 정의")  # under 40 characters, so it joins the piece before
    heads = ["1. 첫째 " + "가" * 50, "2. 둘째 " + "나" * 50, "가. 셋째 " + "다" * 50, "-. 넷째 " + "라" * 50, "제 3 조 " + "마" * 50]
    assert R.split_text("\n\n".join(heads)) == heads
    long = "가" * 600
    assert R.split_text(f"{long}\n\n{'나' * 650}") == [long, "가" * 49 + "\n" + "나" * 650]  # the overlap is cut to the room
    assert R.split_text(f"{long}\n\n{'나' * 500}") == [long, "가" * 120 + "\n" + "나" * 500]
    sentences = [f"{c}{c * 97}." for c in "abcdefghij"]
    assert R.split_text(" ".join(sentences)) == [" ".join(sentences[:7]), (" ".join(sentences[:7]))[-120:] + "\n" + " ".join(sentences[7:])]


def test_chunk_rows(spark):
    rows = R.chunked(spark.createDataFrame([("d", "x" * 1500), ("e", None)], "doc_id string, text string")).collect()
    assert [(r["chunk_id"], len(r["text"])) for r in rows] == [("d:0", 700), ("d:1", 700), ("d:2", 221)]


def test_search_by_brute_force(spark, small):
    import hashlib
    import math
    import re

    import numpy as np

    from parlance.plans.queries import QUERIES

    read = lambda t: spark.read.parquet(f"{small}/{t}.parquet").collect()
    docs, asked = {r["doc_id"]: r["text"] or "" for r in read("documents")}, {r["item_id"]: r["text"] for r in read("benchmark")}
    cut = lambda t: [w for w in re.findall("[0-9A-Za-z가-힣]+", t.lower()) if len(w) >= 2]

    def vector(terms):
        v = np.zeros(512)
        for w in terms:
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "big") % 512] += 1 if h[4] & 1 else -1
        return v / (np.linalg.norm(v) or 1)

    terms = {d: cut(t) for d, t in docs.items()}
    vectors, full = {d: vector(t) for d, t in terms.items()}, [t for t in terms.values() if t]
    mean, df = sum(map(len, full)) / len(full), {}
    for t in full:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    want = []
    for q, text in asked.items():
        mine, v = set(cut(text)), vector(cut(text))
        dense = sorted(((-round(float(v @ x), 6), d) for d, x in vectors.items()))[:10]
        score = {}
        for d, t in terms.items():
            s = sum(math.log(1 + (len(full) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in mine & set(t))
            if mine & set(t):
                score[d] = round(s, 6)
        sparse = sorted((-s, d) for d, s in score.items())[:10]
        rrf = {}
        for ranked in (dense, sparse):
            for k, (_, d) in enumerate(ranked):
                rrf[d] = rrf.get(d, 0) + 1 / (61 + k)
        order = sorted(rrf, key=lambda d: (-round(len(mine & set(terms[d])) / len(mine), 6), -round(rrf[d], 9), d))[:3]
        want += [(q, k + 1, d) for k, d in enumerate(order)]
    got = [(r["query_id"], r["rank"], r["chunk_id"]) for r in QUERIES["hybrid_search"](spark, small).collect()]
    assert sorted(got) == sorted(want)
    rows = {r["chunk_id"]: r["vector"] for r in QUERIES["hashing_embed"](spark, small).collect()}
    assert rows.keys() == vectors.keys() and all(np.allclose(rows[d], x) for d, x in vectors.items())


def test_chain_faults(spark):
    rows = spark.createDataFrame([("s", k, f"b{k}") for k in range(1, 6)], "chain string, seq_no long, body string")
    chain = G.chained(rows)
    assert G.chain_faults(chain).count() == 0
    assert [tuple(r) for r in G.chain_faults(chain.where("seq_no <> 3")).collect()] == [("s", 4, "gap")]
    assert [tuple(r) for r in G.chain_faults(chain.where("seq_no <> 1")).collect()] == [("s", 2, "gap")]
    assert {tuple(r) for r in G.chain_faults(chain.unionByName(chain.where("seq_no = 5"))).collect()} == {("s", 5, "gap")}
    bad = chain.withColumn("body", F.when(F.col("seq_no") == 2, "x").otherwise(F.col("body")))
    assert [tuple(r) for r in G.chain_faults(bad).collect()] == [("s", 2, "digest")]
    head = {r["seq_no"]: r["entry_hash"] for r in chain.collect()}
    assert G.chain_status(bad).first() == ("s", 5, False, 2, "digest", head[1]) and G.chain_status(chain).first() == ("s", 5, True, None, None, head[5])
    later = chain.withColumn("prev_hash", F.when(F.col("seq_no") == 4, G.GENESIS).otherwise(F.col("prev_hash")))
    assert [tuple(r) for r in G.chain_faults(later).collect()] == [("s", 4, "predecessor")]


def test_gate(spark):
    schema = "suite string, metric string, value double"
    now = spark.createDataFrame([("a", "accuracy", 0.9), ("a", "total", 10.0), ("a", "mean_latency_ms", 9.0), ("a", "mrr", 0.1), ("c", "total", 1.0)], schema)
    was = spark.createDataFrame([("a", "accuracy", 0.95), ("a", "total", 10.0), ("a", "mean_latency_ms", 1.0), ("a", "ndcg_at_k", 1.0), ("b", "total", 1.0)], schema)
    assert {tuple(r) for r in G.gate(now, was).collect()} == {("a", "accuracy", "block: lower quality"), ("a", "mean_latency_ms", "warn: slower"), ("b", "__suite__", "block: removed"), ("c", "__suite__", "note: added")}


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "x"), ("e", "f"), ("f", "e"), ("y", "a")], "src string, dst string")
    assert {tuple(r) for r in G.cycles(edges).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("e", "e", 2), ("f", "e", 2), ("x", "x", 1)}
    assert G.cycles(edges.where("src = 'd'")).count() == 0


def test_refused_sessions_do_not_count(spark):
    from parlance.operators import analytics as A

    rows = [("t", k, f"2024-01-01 0{k}:00:00", c) for k, c in ((0, None), (1, "2024-01-01 05:30:00"), (2, None), (3, None), (6, None))] + [("t", 9, "2024-01-01 12:30:00", None)]
    got = A.admission_replay(spark.createDataFrame(rows, "tenant_id string, session_id long, opened string, closed string").select("tenant_id", "session_id", F.col("opened").cast("timestamp"), F.col("closed").cast("timestamp")), 2).collect()
    assert [(r["session_id"], r["active"], r["over"]) for r in sorted(got, key=lambda r: r["opened_at"])] == [(0, 0, False), (1, 1, False), (2, 2, True), (3, 2, True), (6, 1, False), (9, 1, False)]


def test_intents_abstain(spark):
    intents = spark.createDataFrame([("n", "agent", ["사람이랑 통화할래요"]), ("n", "fee", ["수수료 알려줘"])], "node_id string, name string, examples array<string>")
    said = spark.createDataFrame([("1", "n", "수수료 알려줘 빨리"), ("2", "n", "안녕")], "utterance_id string, node_id string, text string")
    assert {r["utterance_id"]: r["intent"] for r in R.intent_scores(said, intents).collect()} == {"1": "fee", "2": None}
