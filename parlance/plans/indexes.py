"""Indexes of a folder's tables in shared storage: built when they aren't there, brought in step when the files have changed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.operators.retrieval import hashed_vectors
from parlance.operators.sparse_index import SparseIndex, spread
from parlance.operators.vector_index import VectorIndex
from parlance.storage import drop_stored, shared_dir, stored


#: Raised when what indexes hold changes, so that older ones aren't read.
LAYOUT = 2


def _stamp(rows: DataFrame) -> str:
    """Names, sizes and times of the files that rows are read from: the same as long as none has changed."""
    spark, found = rows.sparkSession, []
    for name in sorted(rows.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()


def _place(spark: SparkSession, kind: str, sf_dir: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{LAYOUT}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def _in_step(index: SparseIndex | VectorIndex, stamp: str) -> bool:
    commits = index.log.commits()
    return bool(commits) and (commits[-1]["work"] or "").endswith(stamp)


def sparse_index(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> SparseIndex:
    """The sparse index of a folder's chunks."""
    index, stamp = SparseIndex(spark, _place(spark, "sparse", sf_dir)), _stamp(chunks)
    if not _in_step(index, stamp):
        index.heal(chunks, f"{len(index.log.history())}:{stamp}")
    return index


def _fitted(index: VectorIndex, vectors: DataFrame, stamp: str) -> VectorIndex:
    if not _in_step(index, stamp):
        index.fit(vectors)
        index.add(vectors, f"{len(index.log.history())}:{stamp}")
    return index


def vector_index(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> VectorIndex:
    """The index of a folder's stored vectors."""
    return _fitted(VectorIndex(spark, _place(spark, "vectors", sf_dir)), vectors, _stamp(vectors))


def text_vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> VectorIndex:
    """The index of the hashed vectors of a folder's chunks."""
    index, stamp = VectorIndex(spark, _place(spark, "text-vectors", sf_dir)), _stamp(chunks)
    if _in_step(index, stamp):
        return index
    made = stored(hashed_vectors(spread(chunks).select("chunk_id", tokens(F.col("text")).alias("terms"))), "hashed")
    _fitted(index, made, stamp)
    drop_stored(made)
    return index
