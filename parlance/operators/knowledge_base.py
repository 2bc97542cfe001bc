"""A knowledge base in a folder: documents and their states, chunks, and the indexes that searches read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.operators.retrieval import CANDIDATES, TOP, chunked, hashed_vectors
from parlance.operators.sparse_index import SparseIndex
from parlance.operators.stored_search import search
from parlance.operators.vector_index import VectorIndex
from parlance.sources.files import parsed
from parlance.sources.segments import SegmentLog
from parlance.storage import drop_stored, stored


class KnowledgeBase:
    """Documents from files to searchable chunks.

    Each document has a state: ready with its number of chunks, or failed with
    the reason, how often it was tried, and the digest of the content that was
    tried last. A document whose content is ready already isn't read again; one
    that fails keeps the chunks that it had. Every part is a SegmentLog, and
    states are written last: a run that dies is done again from the files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.documents, self.parts = SegmentLog(spark, f"{path}/documents"), SegmentLog(spark, f"{path}/chunks")
        self.sparse, self.vectors = SparseIndex(spark, f"{path}/sparse"), VectorIndex(spark, f"{path}/vectors")

    def states(self) -> DataFrame | None:
        """(doc_id, title, kind, digest, state, chunk_count, warning, error, attempts) of each document."""
        return self.documents.live("states", "doc_id")

    def chunks(self) -> DataFrame | None:
        """(chunk_id, doc_id, ordinal, text, title) of the live chunks."""
        return self.parts.live("chunks", "chunk_id")

    def ingest(self, files: DataFrame) -> dict[str, int]:
        """Read files (doc_id, title, path, content), one a document; how many became ready, failed, or were unchanged."""
        named = files.select("doc_id", "title", "path", "content", F.sha2("content", 256).alias("digest"))
        total, known = named.count(), self.states()
        if known is not None:
            done = known.where("state = 'ready'").select("doc_id", "digest")
            named = named.join(done, ["doc_id", "digest"], "left_anti")
            tried = known.select("doc_id", F.col("attempts").alias("before"))
        read = parsed(named).join(named.select("doc_id", "title", "path", "digest"), "path")
        read = stored(read.join(tried, "doc_id", "left") if known is not None else read.withColumn("before", F.lit(None).cast("int")), "read")
        pieces = chunked(read.where("error is null").select("doc_id", "text")).join(read.select("doc_id", "title"), "doc_id")
        pieces = stored(pieces.select("chunk_id", "doc_id", "ordinal", "text", "title"), "pieces")
        counts = pieces.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
        error = F.coalesce("error", F.when(F.col("chunk_count").isNull(), F.lit("no chunks")))
        states = read.join(counts, "doc_id", "left").select(
            "doc_id", "title", "kind", "digest", F.when(error.isNull(), "ready").otherwise("failed").alias("state"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "warning", error.alias("error"),
            (F.coalesce("before", F.lit(0)) + 1).alias("attempts"),
        )
        states = stored(states, "states")
        self._replace(pieces, states.where("state = 'ready'"))
        self.documents.append({"states": states}, states.select(F.col("doc_id").alias("key")))
        found = {"ready": 0, "failed": 0} | {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        drop_stored(read, pieces, states)
        return {**found, "unchanged": total - sum(found.values())}

    def _replace(self, pieces: DataFrame, ready: DataFrame) -> None:
        """Put the chunks of documents in the place of those that these had before."""
        before, fresh = self.chunks(), pieces.select("chunk_id")
        old = None if before is None else stored(before.join(ready.select("doc_id"), "doc_id", "left_semi").select("chunk_id").join(fresh, "chunk_id", "left_anti"), "old")
        if not pieces.isEmpty():
            vectors = stored(hashed_vectors(pieces.select("chunk_id", tokens(F.col("text")).alias("terms"))).join(pieces.select("chunk_id", "doc_id"), "chunk_id"), "hashed")
            self.sparse.add(pieces, also_removed=old)
            if self.vectors.log.table("centroids") is None:
                self.vectors.fit(vectors)
            self.vectors.add(vectors)
            drop_stored(vectors)
        if old is not None and not old.isEmpty():
            self.vectors.remove(old)
            if pieces.isEmpty():
                self.sparse.remove(old)
        keys = fresh if old is None else fresh.unionByName(old)
        self.parts.append({"chunks": pieces}, keys.select(F.col("chunk_id").alias("key")))
        if old is not None:
            drop_stored(old)

    def delete(self, documents: DataFrame) -> int:
        """Take documents (doc_id) and all that came of them out; how many chunks went."""
        if self.chunks() is None:
            return 0
        keys = documents.select("doc_id").distinct()
        old = stored(self.chunks().join(keys, "doc_id", "left_semi").select("chunk_id"), "old")
        n = old.count()
        if n:
            self.sparse.remove(old)
            self.vectors.remove(old)
            self.parts.append({}, old.select(F.col("chunk_id").alias("key")))
        self.documents.append({}, keys.select(F.col("doc_id").alias("key")))
        drop_stored(old)
        return n

    def search(self, queries: DataFrame, k: int = TOP, candidates: int = CANDIDATES, min_score: float = 0.0, lexicon: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
        """Hybrid search of queries (query_id, text): the k best chunks with their documents and titles."""
        found = search(queries, self.sparse, self.vectors, k, candidates, min_score, lexicon)
        return found.join(self.chunks().select("chunk_id", "doc_id", "title", "ordinal"), "chunk_id")
