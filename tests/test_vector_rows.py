"""What the vector index stores and sends is bounded by rows, however many rows and shards there are."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.operators import retrieval as R
from parlance.operators.vector_index import CELLS, VectorIndex, _routed


def test_queries_leave_a_few_at_once():
    """An exact search may send each query to each shard; their copies were one batch, which grew as the rows."""
    rng = np.random.default_rng(4)
    centroids, n = rng.normal(size=(200, 64)), 300
    asks = pa.record_batch([pa.array(range(n)), pa.array(rng.normal(size=(n, 64)).tolist()), pa.array([None] * n, pa.float64())], names=["query_id", "vector", "floor"])
    sent = list(_routed(centroids, 3, np.full(200, 9.0), [(i, i) for i in range(200)])(iter([asks])))
    assert sum(map(len, sent)) == n * 200 and max(b.nbytes for b in sent) <= 1.1 * 8 * CELLS


def test_a_stored_row_is_one_vector(spark, tmp_path):
    """Readers and writers of Parquet hold thousands of rows, so rows must not be blocks of MB."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id long, vector array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.fit(rows, lists=3)
    index.add(rows)
    index.add(rows.where("chunk_id < 40").withColumn("vector", F.transform("vector", lambda v: v * 2)))
    index.remove(spark.createDataFrame([(7,), (2999,)], "chunk_id long"))
    assert index.log.table("blocks").agg(F.max(F.length("data"))).first()[0] == 8 * 8
    live = rows.where("chunk_id not in (7, 2999)").withColumn("vector", F.when(F.col("chunk_id") < 40, F.transform("vector", lambda v: v * 2)).otherwise(F.col("vector")))
    asked = rows.where("chunk_id % 300 = 0").withColumnRenamed("chunk_id", "query_id")
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    assert key(index.exact(asked)) == key(R.dense(asked, live))
    assert index.vectors().count() == 2998
