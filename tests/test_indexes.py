"""Stored indexes: changes by segments give what a rebuild gives, and searches find what full ones find."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.operators import retrieval as R
from parlance.operators.sparse_index import SparseIndex, _shard_scores
from parlance.operators.vector_index import VectorIndex, calibrated_probes, fit_centroids, recall
from parlance.sources.segments import SegmentLog


def _texts(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return [(f"c{k}", " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, int(rng.integers(0, 60))), words))) for k in range(n)]


def _table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"block_terms": 60, "shard_postings": 700}])
def test_search_is_the_full_search(spark, tmp_path, limits):
    chunks = _table(spark, _texts(1, 400))
    queries = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(_texts(2, 25))] + [(90, "w1"), (91, ""), (92, None), (93, "unknown words"), (94, "w1 w2 w3 w1")], "query_id long, text string")
    index = SparseIndex(spark, f"file://{tmp_path}/i")
    index.add(chunks)
    assert _rows(index.search(queries, 7, **limits)) == _rows(R.bm25(queries, R.indexed(chunks), 7))
    one = queries.where("query_id = 94")
    assert _rows(index.search(one, 3, **limits)) == _rows(R.bm25(one, R.indexed(chunks), 3))


def test_shards_keep_the_best():
    """Rare and common terms, with floors above and below what the common ones may add."""
    rng = np.random.default_rng(8)
    for n, k in ((5, 10), (400, 3), (400, 50)):
        for _ in range(30):
            spans, code, part, most, full = [], [], [], {}, np.zeros(n)
            for size in rng.choice([1, 3, max(1, n // 20), n // 2, n], 6):
                mine, w = np.sort(rng.choice(n, min(n, int(size)), replace=False)), float(rng.choice([0.1, 1.0, 20.0]))
                p, at = rng.uniform(0.1, 2.5, len(mine)), sum(map(len, code))
                spans.append((at, at + len(mine), w))
                most[at] = float(p.max())
                code.append(mine)
                part.append(p)
                full[mine] += w * p
            keep, score = _shard_scores(spans, np.concatenate(code), np.concatenate(part), most, n, k)
            want = np.argsort(-full, kind="stable")[: min(k, int((full > 0).sum()))]
            assert set(want) <= set(keep.tolist()) and np.allclose(score, full[keep])


def test_changes_give_what_a_rebuild_gives(spark, tmp_path):
    first, second = _texts(3, 120), _texts(4, 120)
    queries = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(_texts(5, 12))], "query_id long, text string")
    index = SparseIndex(spark, f"file://{tmp_path}/i")
    index.add(_table(spark, first[:100]), work="load")
    assert index.add(_table(spark, first[:100]), work="load") is None and len(index.log.commits()) == 1  # done before: nothing happens
    index.add(_table(spark, second[50:110]))
    index.remove(spark.createDataFrame([("c3",), ("c60",), ("c999",)], "chunk_id string"))
    index.add(_table(spark, [first[60], ("c200", "w1 w2 fresh words")]))
    left = dict(first[:50]) | dict(second[50:110]) | {"c60": first[60][1], "c200": "w1 w2 fresh words"}
    del left["c3"]
    whole = _table(spark, list(left.items()))
    want = _rows(R.bm25(queries, R.indexed(whole)))
    assert _rows(index.search(queries)) == want
    index.compact()
    assert len(index.log.commits()) == 1 and _rows(index.search(queries)) == want and index.chunks().count() == len(left)
    assert index.add(_table(spark, first[:1]), work="load") is None  # names of work outlive a compaction
    assert sorted(p.name for p in (tmp_path / "i").iterdir() if p.name[0] == "0") == [index.log.commits()[0]["folder"]]


def test_heal_counts_and_mends(spark, tmp_path):
    rows = _texts(6, 40)
    index = SparseIndex(spark, f"file://{tmp_path}/i")
    assert index.heal(_table(spark, rows[:30])) == {"missing": 30, "changed": 0, "gone": 0}
    now = [*rows[5:30], *rows[30:33], ("c4", "another text")]
    assert index.heal(_table(spark, now)) == {"missing": 3, "changed": 1, "gone": 4}
    assert index.heal(_table(spark, now)) == {"missing": 0, "changed": 0, "gone": 0}
    assert {r["chunk_id"] for r in index.chunks().collect()} == {c for c, _ in now}


def test_reranking_reads_postings(spark, tmp_path):
    chunks = spark.createDataFrame([(k, t, title) for (k, t), (_, title) in zip(_texts(7, 80), _texts(8, 80))], "chunk_id string, text string, title string")
    queries = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(_texts(9, 10))], "query_id long, text string")
    index, old = SparseIndex(spark, f"file://{tmp_path}/i"), R.indexed(chunks)
    index.add(chunks)
    candidates = R.fused(R.bm25(queries, old), R.ranked(queries.crossJoin(chunks.select("chunk_id")).select("query_id", "chunk_id", F.lit(1.0).alias("score")), "score", 5)).unionByName(spark.createDataFrame([(0, "nowhere", 0.0, 0.0, 1.0)], "query_id long, chunk_id string, dense_score double, sparse_score double, rrf double"))
    assert _rows(index.reranked(candidates, queries)) == _rows(R.reranked(candidates, queries, old))
    assert _rows(index.search(queries)) == _rows(R.bm25(queries, old))


def test_a_tokenizer_is_part_of_its_index(spark, tmp_path):
    from parlance.operators.engines import engine, register

    index = SparseIndex(spark, f"file://{tmp_path}/i", "space")
    index.add(_table(spark, [("a", "a b-c D"), ("b", "b c d")]))
    index.compact()
    queries = spark.createDataFrame([(1, "B-C"), (2, "d")], "query_id long, text string")
    assert {(r["query_id"], r["chunk_id"]) for r in SparseIndex(spark, f"file://{tmp_path}/i", "space").search(queries).collect()} == {(1, "a"), (2, "a"), (2, "b")}
    with pytest.raises(ValueError, match="made with space"):
        SparseIndex(spark, f"file://{tmp_path}/i")
    with pytest.raises(ValueError, match="no tokenizer other: there are space, syllable"):
        engine("tokenizer", "other")
    with pytest.raises(ValueError, match="there already"):
        register("tokenizer", "space", len)
    register("tokenizer", "halves", lambda t: F.split(t, "b"))
    assert spark.range(1).select(engine("tokenizer", "halves")(F.lit("abc")).alias("x")).first()["x"] == ["a", "c"]
    candidates = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.3)], "query_id long, chunk_id string, rrf double")
    assert [r["chunk_id"] for r in engine("reranker", "none")(candidates, queries, None, 1).collect()] == ["b"]


def test_an_empty_index_finds_nothing(spark, tmp_path):
    queries = spark.createDataFrame([(1, "w1")], "query_id long, text string")
    index = SparseIndex(spark, f"file://{tmp_path}/i")
    assert index.search(queries).count() == 0 and index.compact() is None
    index.add(_table(spark, [("a", ""), ("b", None)]))
    assert index.search(queries).count() == 0 and index.chunks().count() == 2


def test_unfinished_segments_are_not_seen(spark, tmp_path):
    log = SegmentLog(spark, f"file://{tmp_path}/log")
    log.append({"t": spark.range(3)})
    spark.range(5).write.parquet(f"file://{tmp_path}/log/000000000002-{'0' * 32}/t")  # files of a job that died
    assert log.table("t").count() == 3
    (tmp_path / "log/commits/000000000002").write_text(json.dumps({"number": 2})[:5])  # a commit that is being written
    assert log.table("t").count() == 3
    with pytest.raises(Exception, match="exist"):  # the number is another writer's
        log._next = lambda: 2
        log.append({"t": spark.range(1)})


def _clustered(seed, n, dims=16, clusters=25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.25, (n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vector_index_over_changes(spark, tmp_path):
    x = _clustered(1, 1500)
    rows = [(f"v{k}", f"d{k % 50}", v.tolist()) for k, v in enumerate(x)]
    frame = lambda r: spark.createDataFrame(r, "chunk_id string, doc_id string, vector array<double>").repartition(3)
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.fit(frame(rows))
    index.add(frame(rows[:1000]))
    index.add(frame(rows[900:] + [("v7", "d7", x[8].tolist())]))
    index.remove_documents(spark.createDataFrame([("d3",)], "doc_id string"))
    live = {k: v for k, d, v in rows if d != "d3"} | {"v7": x[8].tolist()}
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 1500, 30)], "query_id long, vector array<double>")
    want = R.dense(asked, spark.createDataFrame(list(live.items()), "chunk_id string, vector array<double>"))
    assert _rows(index.exact(asked)) == _rows(want)
    found = recall(index.search(asked), want).first()
    assert found["queries"] == 50 and found["results"] == 500 and found["recall"] >= 0.9
    centroids, probes = index._centroids()
    assert probes < len(centroids) / 2  # clustered rows need few lists
    assert index.ids().count() == len(live) == index.vectors().count()
    index.compact()
    assert _rows(index.exact(asked)) == _rows(want) and len(index.log.commits()) == 1 and index.ids().count() == len(live)


def test_vector_index_of_few_or_equal_rows(spark, tmp_path):
    schema = "chunk_id long, vector array<double>"
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    none = VectorIndex(spark, f"file://{tmp_path}/none")
    none.fit(spark.createDataFrame([], schema))
    assert none.search(asked).count() == 0
    same = VectorIndex(spark, f"file://{tmp_path}/same")
    rows = spark.createDataFrame([(k, [0.6, 0.8]) for k in range(300)], schema)
    same.fit(rows)
    same.add(rows)
    assert [r["chunk_id"] for r in same.search(asked, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_calibration_counts_lists():
    x = _clustered(2, 2000)
    centroids = fit_centroids(x, 40)
    few, all_ = calibrated_probes(x, centroids, 10, 0.9), calibrated_probes(x, centroids, 10, 1.0)
    assert 1 <= few <= all_ <= 40 and few < 15


def test_a_query_goes_once_to_lists_that_share_a_shard():
    """An exact search may visit most lists; its queries are sent by shards, which grow as the rows, and not by lists."""
    from parlance.operators.vector_index import _routed

    rng = np.random.default_rng(2)
    centroids = rng.normal(size=(60, 8))
    asks = pa.record_batch([pa.array(range(50)), pa.array(rng.normal(size=(50, 8)).tolist()), pa.array([None] * 50, pa.float64())], names=["query_id", "vector", "floor"])
    sent = [r for b in _routed(centroids, 3, np.full(60, 9.0), [(i, i // 20) for i in range(60)])(iter([asks])) for r in b.to_pylist()]
    assert sorted((r["query_id"], r["list"]) for r in sent) == [(q, s) for q in range(50) for s in range(3)]
    near = np.argsort(-(np.array(asks.column("vector").to_pylist()) @ centroids.T), axis=1)[:, :3]
    apart = [r for b in _routed(centroids, 3, None, [(i, i) for i in range(60)])(iter([asks])) for r in b.to_pylist()]
    assert sorted((r["query_id"], r["list"]) for r in apart) == sorted((q, int(i)) for q, own in enumerate(near) for i in own)
