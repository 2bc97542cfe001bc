"""Exact top-k inner products by no-random-access aggregation (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm._shared import stored

#: Components that a block of candidates holds, and queries in a block.
CELLS, QUERIES = 1_000_000, 256
#: Shares of the lists after which bounds are compared; reading ends with the first that leaves few enough candidates.
DEPTHS = (1 / 4, 1 / 2)


class Lists:
    """A block's candidates as one list for each dimension, sorted by value.

    A query reads a list from its top where its weight is positive and from its
    bottom where it is negative, so contributions come in falling order. All
    queries of a block read in step, so what a step brings is laid out once:
    a column for each list and direction, first those read from the top.
    Nothing but the lists is kept: a score is known only from what was read.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, x = ids[by_id], vectors[by_id].T
        order = np.argsort(x, axis=1, kind="stable")
        self.row, self.value = order.astype(np.int32), np.take_along_axis(x, order, axis=1)
        self.largest = np.abs(self.value[:, [0, -1]].astype(object)).max(axis=1) if x.size else np.zeros(len(x), object)
        self._steps: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def read(self, start: int, end: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether read) of the entries start to end of each list and direction, by candidate; others are 0."""
        if (start, end, kind) not in self._steps:
            n, dims = len(self.ids), len(self.row)
            values, there = np.zeros((n, 2 * dims), kind), np.zeros((n, 2 * dims), bool)
            for first, cut in ((0, slice(n - end, n - start)), (dims, slice(start, end))):
                column = first + np.arange(dims)[:, None]
                values[self.row[:, cut], column] = self.value[:, cut]
                there[self.row[:, cut], column] = True
            self._steps[start, end, kind] = values, there
        return self._steps[start, end, kind]

    def at(self, place: int) -> np.ndarray:
        """The values at a place of each list, from either direction."""
        return np.concatenate([self.value[:, len(self.ids) - 1 - place], self.value[:, place]])


def search_block(lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(candidate ids, scores) of each query's k best in a block, ties to the smaller id.

    The lists are read in step. What was read of a candidate, and for its
    other dimensions the last entry read, or the list's end, give its upper and
    lower bound. Candidates whose upper bound is under the k-th best lower bound
    are out; so are all that no list has shown yet once the sum of the last
    entries is under it. When few are in doubt, the rest of the lists is read,
    which completes the scores of these alone.

    Sums are exact: in floats of 32 or 64 bits while they stay under 2^24 or
    2^53, else in 64-bit integers, else in integers of any size; a score that
    is no 64-bit integer is an error.
    """
    n = len(lists.ids)
    widest = np.abs(queries.astype(object)).max(axis=0) if len(queries) else np.zeros(len(lists.row), object)
    most = sum(int(a) * int(b) for a, b in zip(widest, lists.largest))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    q = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
    need = k + 1  # the query itself may be among them
    total, alive, unread, done = np.zeros((len(q), n), kind), np.ones((len(q), n), bool), np.ones((n, q.shape[1]), bool), 0
    for depth in DEPTHS if n > 4 * need else ():
        end = max(done + 1, int(depth * n))
        values, there = lists.read(done, end, kind)
        total += q @ values.T
        unread &= ~there
        done = end
        left = unread.astype(kind).T
        lower, upper = (total + (q * lists.at(place).astype(kind)) @ left for place in (n - 1, done - 1))
        floor = np.sort(lower, axis=1)[:, -need] if kind is object else np.partition(lower, -need, axis=1)[:, -need]
        alive &= upper >= floor[:, None]  # a candidate that no list has shown has the sum of the last entries
        if alive.sum() <= 4 * need * len(q):
            break
    rest, _ = lists.read(done, n, kind)
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(alive[i] & (lists.ids != query_ids[i]))
        score = total[i, at] + rest[at] @ q[i]
        if kind is object and any(abs(x) >= 1 << 63 for x in score):
            raise OverflowError(f"a score of vector {query_ids[i]} is no 64-bit integer")
        score = score.astype(np.int64)
        if len(score) > k:
            keep = score >= np.partition(score, -k)[-k]
            at, score = at[keep], score[keep]
        best = np.argsort(-score, kind="stable")[:k]  # rows stand by id
        out.append((lists.ids[at[best]], score[best]))
    return out


_BLOCK = "block long, ids binary, data binary"


def _packed(most_cells: int, most_rows: int):
    """Rows (vec_id, v) to rows of packed bytes, of at most so many rows and about so many components each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, vectors, cells, count, width = [], [], 0, TaskContext.get().partitionId() << 32, None
        for b in batches:
            for vec_id, v in zip(b.column("vec_id").to_pylist(), b.column("v")):
                v = v.values.to_numpy(zero_copy_only=False)
                if len(v) != (width := len(v) if width is None else width):
                    raise ValueError(f"vector {vec_id} has {len(v)} components, others have {width}")
                ids.append(vec_id)
                vectors.append(v)
                cells += len(v)
                if cells >= most_cells or len(ids) >= most_rows:
                    yield closed(count, ids, vectors)
                    ids, vectors, cells, count = [], [], 0, count + 1
        if ids:
            yield closed(count, ids, vectors)

    def closed(block, ids, vectors):
        return pa.record_batch([pa.array([block]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.stack(vectors).astype(np.int64).tobytes()])], names=["block", "ids", "data"])

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["data"], np.int64).reshape(len(ids), -1)


def _search(k: int):
    """Rows in the order of blocks, each block's candidates before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = None
        for b in batches:
            for row in b.to_pylist():
                ids, vectors = _unpacked(row)
                if not row["asks"]:
                    lists = Lists(ids, vectors)
                    continue
                if vectors.shape[1] != len(lists.row):
                    raise ValueError("queries and candidates differ in their number of components")
                found = search_block(lists, ids, vectors, k)
                query_ids = np.repeat(ids, [len(x) for x, _ in found])
                yield pa.record_batch([pa.array(query_ids), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, cells: int = CELLS, per_block: int = QUERIES) -> DataFrame:
    """The k candidates with the largest integer inner products for each query, but for itself.

    Both have vec_id and v (array<long>). Tasks pack the rows that they read
    into blocks of about `cells` components, so a block is bounded whatever
    ids repeat. Candidates are shuffled once; the queries, in blocks, go to
    every block of candidates, where the lists are sorted once. A block
    returns its k best a query, and these are merged by query.

    Ranks count from 1; ties go to the smaller vec_id. Equal vectors and
    repeated ids each count as candidates, except rows with the query's own
    id; of the rows of a query id the one with the least vector asks. Empty
    tables give no rows; with fewer than k others a query gets them all. Rows
    need non-null ids and vectors (see `quantized`); vectors that differ in
    their number of components are an error. Further columns don't matter.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = stored(vectors.select("vec_id", "v").mapInArrow(_packed(cells, 1 << 30), _BLOCK), "candidates")
    asked = stored(queries.mapInArrow(_packed(cells, per_block), _BLOCK), "queries")
    # one short row for each block: their dense numbers
    numbered = blocks.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("number"))
    n = blocks.count()
    candidates = blocks.join(numbered, "block").select("number", F.lit(False).alias("asks"), "ids", "data")
    each = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("number"), F.lit(True).alias("asks"), "ids", "data") if n else candidates.limit(0)
    met = candidates.unionByName(each).repartition(max(1, n), "number").sortWithinPartitions("number", "asks")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def quantized(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of each component as 64-bit integers.

    Rows with a null id, a null vector, or null or non-finite components go.
    A finite component whose multiple is no 64-bit integer is an error.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where("vec_id is not null and embedding is not null").where(~F.coalesce(bad, F.lit(False)))

    def whole(x):
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < float(1 << 63), y).otherwise(F.raise_error(F.lit("a component is no 64-bit integer")))

    return good.select("vec_id", F.transform("embedding", whole).alias("v"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))
