"""Hybrid search over stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.operators.retrieval import CANDIDATES, TOP, expanded, fused, hashed_vectors
from parlance.operators.sparse_index import SparseIndex
from parlance.operators.vector_index import VectorIndex
from parlance.storage import stored


def search(queries: DataFrame, sparse: SparseIndex, vectors: VectorIndex, k: int = TOP, candidates: int = CANDIDATES, min_score: float = 0.0, lexicon: list[tuple[str, tuple[str, ...]]] | None = None, exact: bool = True) -> DataFrame:
    """Hashed vectors and BM25 to `candidates` each, fused, reranked, the k best kept; no text of a chunk is read.

    Where a lexicon is given, queries are expanded first and asked so of all
    parts. Vectors are searched exactly, or else in their nearest lists.
    """
    if lexicon:
        queries = stored(queries.select("query_id", expanded(F.col("text"), lexicon).alias("text")), "expanded")
    asked = hashed_vectors(queries.select("query_id", tokens(F.col("text")).alias("terms")))
    near = vectors.exact(asked, candidates) if exact else vectors.search(asked, candidates)
    return sparse.reranked(fused(near, sparse.search(queries, candidates)), queries, k, min_score)
