"""Queries that change indexes and search them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import retrieval as R
from parlance.operators import vector_index as V
from parlance.operators.sparse_index import SparseIndex
from parlance.plans.indexes import vector_index
from parlance.plans.queries import _BM25, _TERMS, ORACLE_SQL, _asked, _chunks, _read, query
from parlance.storage import fresh_path


def _changed(spark: SparkSession, sf_dir: str, where: str) -> SparseIndex:
    """An index that was built, then had texts replaced, documents removed, and one of them added again."""
    docs = _chunks(spark, sf_dir)
    index = SparseIndex(spark, fresh_path(spark, where))
    index.add(docs.where("chunk_id % 5 <> 4"))
    index.add(docs.where("chunk_id % 5 = 4"))
    index.add(docs.where("chunk_id % 7 = 3").withColumn("text", F.concat(F.lit("the price "), F.coalesce("text", F.lit("")))))
    index.remove(docs.where("chunk_id % 3 = 1").select("chunk_id"))
    index.add(docs.where("chunk_id % 6 = 1"))
    return index


#: What _changed leaves: a document's last text, or none.
_LEFT = """SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN text WHEN doc_id % 7 = 3 THEN 'the price ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 6 = 1"""
_CHANGED = _BM25.replace("FROM documents", f"FROM ({_LEFT})")


@query(f"WITH {_CHANGED} SELECT query_id, chunk_id, rank, score FROM sparse")
def bm25_after_changes(spark, sf_dir):
    """Chunks added, replaced, removed and added again, over five segments; scores are those of an index of what is left."""
    return _changed(spark, sf_dir, "changed").search(_asked(spark, sf_dir)).select("query_id", "chunk_id", "rank", "score")


@query(f"WITH {_CHANGED} SELECT query_id, chunk_id, rank, score FROM sparse")
def bm25_after_compaction(spark, sf_dir):
    """The same changes, then one segment of all live rows."""
    index = _changed(spark, sf_dir, "compacted")
    index.compact()
    return index.search(_asked(spark, sf_dir)).select("query_id", "chunk_id", "rank", "score")


@query(f"""SELECT doc_id AS chunk_id, CAST(len({_TERMS}) AS INTEGER) AS length FROM documents""")
def index_heals(spark, sf_dir):
    """An index with stale, changed and missing chunks is brought in step with the table: every chunk once, with its length."""
    docs = _chunks(spark, sf_dir)
    index = SparseIndex(spark, fresh_path(spark, "healed"))
    index.add(docs.where("chunk_id % 4 <> 0").withColumn("text", F.when(F.col("chunk_id") % 9 == 1, F.lit("old words here")).otherwise(F.col("text"))))
    index.add(docs.where("chunk_id % 10 = 0").withColumn("chunk_id", -F.col("chunk_id") - 1))
    index.heal(docs)
    return index.chunks().select("chunk_id", "length")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _asking(vectors: DataFrame) -> DataFrame:
    return vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


@query(ORACLE_SQL["dense_topk"])
def vector_index_exact(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all, by the lists that may matter."""
    rows = _vectors(spark, sf_dir)
    return vector_index(spark, sf_dir, rows).exact(_asking(rows)).select("query_id", "chunk_id", "score", "rank")


@query()
def vector_index_search(spark, sf_dir):
    """The same queries in their nearest lists only."""
    rows = _vectors(spark, sf_dir)
    return vector_index(spark, sf_dir, rows).search(_asking(rows))


@query()
def vector_index_recall(spark, sf_dir):
    """How many of the exact results the nearest lists hold."""
    rows = _vectors(spark, sf_dir)
    return V.recall(vector_index(spark, sf_dir, rows).search(_asking(rows)), R.dense(_asking(rows), rows))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 2 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE embedding::DOUBLE[] END AS e, label FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_inner_product(a.embedding::DOUBLE[], b.e), 6) AS score FROM embeddings a, v b WHERE a.vec_id % 20 = 0 AND b.label <> (SELECT min(label) FROM embeddings) AND b.vec_id % 13 <> 5)
    SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def vector_index_changed(spark, sf_dir):
    """Vectors added in two steps, some replaced, some removed by id, and one label's removed as a document."""
    rows = _vectors(spark, sf_dir)
    index = V.VectorIndex(spark, fresh_path(spark, "vectors"))
    index.fit(rows)
    index.add(rows.where("chunk_id % 2 = 0"))
    index.add(rows.where("chunk_id % 2 = 1"))
    index.add(rows.where("chunk_id % 7 = 2").withColumn("vector", F.transform("vector", lambda x: -x)))
    index.remove(rows.where("chunk_id % 13 = 5"))
    index.remove_documents(rows.agg(F.min("doc_id").alias("doc_id")))
    return index.exact(_asking(rows)).select("query_id", "chunk_id", "score", "rank")
