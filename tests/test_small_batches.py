"""Texts and terms go to Python a few at a time."""

import pyarrow as pa

from parlance.operators import retrieval as R


def test_batches_are_cut_and_whole():
    b = pa.record_batch([pa.array(range(1000))], names=["k"])
    cut = list(R.few_at_once(iter([b, b.slice(0, 0), b.slice(0, 5)])))
    assert max(map(len, cut)) == R.AT_ONCE and [x for c in cut for x in c.column("k").to_pylist()] == [*range(1000), *range(5)]


def test_sessions_send_few_texts_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    docs = spark.range(2000, numPartitions=1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    chunks = R.chunked(docs)
    assert int(spark.conf.get(key)) <= R.ROWS and chunks.count() == 2000
    spark.conf.set(key, "100")
    R.chunked(docs)
    assert spark.conf.get(key) == "100"
    spark.conf.unset(key)


def test_postings_are_counted_as_arrays():
    """Terms of text and title, with null and empty ones, as by counting one row after another."""
    import random
    from collections import Counter

    from parlance.operators.sparse_index import _counted, _postings

    rng = random.Random(3)
    rows = [(i, i * 7, *(rng.choice([None, [], [rng.choice("abcdé") for _ in range(rng.randrange(1, 9))]]) for _ in range(2))) for i in range(300)]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
    b = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["chunk_id", "digest", "terms", "title_terms"])
    want = []
    for i, digest, text, title in rows:
        whole, n = Counter(text or ()) + Counter(title or ()), len(text or ()) + len(title or ())
        want += [("", i, 0, 0, n, digest), *((t, i, k, Counter(text or ())[t], n, None) for t, k in whole.items())]
    got = [tuple(r.values()) for out in _postings(pa.int64())(iter([b, b.slice(0, 0)])) for r in out.to_pylist()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [x.tolist() for x in _counted(pa.array([["a", "b", "a"], None, ["b"]]), pa.array(["b", "a"]))] == [[0, 0, 2], [0, 1, 0], [1, 2, 1]]


def test_vectors_hash_a_batch_word_once(spark):
    """Vectors with repeated, null and no terms, as by hashing one word after another."""
    import hashlib

    import numpy as np

    rows = {1: ["a", "b", "a", "word"], 2: None, 3: [], 4: ["b"] * 5}
    for r in R.hashed_vectors(spark.createDataFrame(list(rows.items()), "chunk_id long, terms array<string>")).collect():
        want = np.zeros(R.DIMENSIONS)
        for word in rows[r["chunk_id"]] or ():
            h = hashlib.blake2b(word.encode(), digest_size=8).digest()
            want[int.from_bytes(h[:4], "big") % R.DIMENSIONS] += 1.0 if h[4] & 1 else -1.0
        assert r["vector"] == (want / (np.linalg.norm(want) or 1)).tolist()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
