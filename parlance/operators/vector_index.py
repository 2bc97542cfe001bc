"""A stored vector index: vectors in the lists of their nearest centroids, searched in the lists nearest to a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators.retrieval import CANDIDATES, ranked
from parlance.sources.segments import SegmentLog
from parlance.storage import drop_stored, stored

#: Centroids are fitted on at most so many rows, those of least hash; there are at most so many lists.
SAMPLE, MOST_LISTS = 10_000, 4096
#: Rounds of the fit, sample rows that ask in its calibration, and the recall that these must reach.
ROUNDS, ASKING, RECALL = 8, 200, 0.95
#: Nearest lists that give the exact search its first floor.
FLOOR_LISTS = 8
#: Components of a block, of a shard, and of what a task sends at once, about; queries that meet a shard at once.
CELLS, PER_BLOCK = 1_000_000, 256
#: What meets in a shard, in this order.
GONE, OWN, ASKED = 0, 1, 2


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, by Euclidean distance (half its square without the row's own part)."""
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([(rows[s : s + 4096] @ centroids.T - half).argmax(axis=1) for s in range(0, len(rows), 4096)]) if len(rows) else np.empty(0, np.int64)


def fit_centroids(rows: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from rows spread over the sample; in the end only centroids that some row is nearest to count."""
    centroids = rows[np.linspace(0, len(rows) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        of = _nearest(rows, centroids)
        n = np.bincount(of, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, rows)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids[np.unique(_nearest(rows, centroids))]


def calibrated_probes(rows: np.ndarray, centroids: np.ndarray, k: int, recall: float = RECALL, asking: int = ASKING) -> int:
    """The fewest lists that queries must visit to find the share `recall` of their k best, measured within the sample."""
    of, asks = _nearest(rows, centroids), rows[np.linspace(0, len(rows) - 1, min(asking, len(rows))).astype(int)]
    scores = asks @ rows.T
    k = min(k, len(rows))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = np.argsort(-(asks @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
    visits = np.sort(np.take_along_axis(place, of[best], axis=1).ravel()) + 1
    return int(visits[min(len(visits) - 1, int(np.ceil(recall * len(visits))) - 1)])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row's components as one binary value."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _vectors(b.column("vector"))
                of = _nearest(x, centroids)
                yield pa.record_batch([b.column("chunk_id"), b.column("doc_id"), _bytes(x), pa.array(of.astype(np.int32)), pa.array(np.linalg.norm(x - centroids[of], axis=1))], names=["chunk_id", "doc_id", "data", "list", "far"])

    return run


def _routed(centroids: np.ndarray, probes: int, radius: np.ndarray | None, places: list[tuple[int, int]]):
    """Each query once for each shard of the lists that it visits; places are the pairs of list and shard.

    Those are the `probes` lists whose centroids have the largest inner products
    with it; with radii, all lists in which a row may reach the query's floor,
    as no row is farther from its centroid than the radius. A query may go to
    all shards, so vectors leave a few at once.
    """
    of, shard = np.array(sorted(places, key=lambda x: x[1]), np.int64).reshape(-1, 2).T
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b) if len(starts) else 0, 1024):
                part = b.slice(at, 1024)
                x = _vectors(part.column("vector"))
                near = x @ centroids.T
                if radius is None:
                    visits = np.zeros(near.shape, bool)
                    np.put_along_axis(visits, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                else:
                    floor = np.array([-np.inf if f is None else f for f in part.column("floor").to_pylist()])
                    visits = near + np.linalg.norm(x, axis=1, keepdims=True) * radius >= floor[:, None] - 1e-5
                row, at_shard = np.nonzero(np.logical_or.reduceat(visits[:, of], starts, axis=1))
                step = max(1, CELLS // max(1, x.shape[1]))
                for s in range(0, len(row), step):
                    own = row[s : s + step]
                    yield pa.record_batch([pa.array(shard[starts[at_shard[s : s + step]]].astype(np.int32)), part.column("query_id").take(pa.array(own)), _bytes(x[own])], names=["list", "query_id", "data"])

    return run


def _best(k: int):
    """Rows in order of shard and kind, what is gone before vectors before queries, to each query's k best live vectors of the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone, held, whole = None, set(), [], None
        for b in batches:
            shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])]) if len(b) else []
            for s, e in zip(cuts, [*cuts[1:], len(b)]):
                if shard[s] != now:
                    now, gone, held, whole = shard[s], set(), [], None
                part = b.slice(s, e - s)
                if kind[s] != ASKED:
                    ids = part.column("chunk_id")
                    keys = zip(part.column("segment").to_pylist(), ids.to_pylist()) if kind[s] == GONE or gone else ()
                    if kind[s] == GONE:
                        gone.update(keys)
                        continue
                    live = np.array([key not in gone for key in keys]) if gone else np.ones(len(ids), bool)
                    if live.any():
                        held.append((ids.filter(pa.array(live)), _values(part.column("data"))[live]))
                    continue
                if held:
                    whole, held = (pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])), []
                for at in range(0, len(part) if whole is not None else 0, PER_BLOCK):
                    asked = part.slice(at, PER_BLOCK)
                    score = _values(asked.column("data")) @ whole[1].T
                    least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else -np.inf
                    q, c = np.nonzero(score >= least - 2e-6)  # what rounds to the k-th score may still win by its id
                    yield pa.record_batch([asked.column("query_id").take(pa.array(q)), whole[0].take(pa.array(c)), pa.array(score[q, c])], names=["query_id", "chunk_id", "raw"])

    return run


class VectorIndex:
    """Vectors (chunk_id, doc_id, vector) in a folder, in lists by nearest centroid.

    `fit` takes centroids from a bounded sample of rows and measures on it how
    many lists a query must visit; every row that is added then goes to a
    list, and lists are parts of the stored files. A stored row is one vector,
    so no reader, writer or sort holds more than a few MB at once; its block
    of its list, by a hash of its id, says which rows meet queries together. Changes are segments (see
    SegmentLog): added rows replace those of the same chunk_id, removed ones are
    tombstones, which searches mask before they choose. `search` visits the
    nearest lists; `exact` all lists that may matter. Scores are inner
    products with six decimals, ties to the smaller chunk_id.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, SegmentLog(spark, path)

    def fit(self, vectors: DataFrame, k: int = CANDIDATES, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> None:
        """Lay down centroids and the number of lists to visit. Without rows there is one list, at the origin of any space."""
        n, key = vectors.count(), F.xxhash64("chunk_id")
        last = vectors.select(key.alias("key")).orderBy("key").limit(sample).agg(F.max("key")).first()[0]  # so only the sample's vectors are moved
        rows = vectors.where(key <= F.lit(last)).select("chunk_id", "vector").orderBy(key, "chunk_id").limit(sample).toArrow()
        x = _vectors(rows.column("vector").combine_chunks()) if len(rows) else np.zeros((1, 1))
        lists = lists or max(1, min(MOST_LISTS, round(n**0.5), len(x) // 8 or 1))
        centroids = fit_centroids(x, min(lists, len(x)))
        probes = calibrated_probes(x, centroids, k, recall)
        table = self.spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centroids)], "list int, centroid array<double>, probes int").coalesce(1)
        self.log.append({"centroids": table}, base=True)

    def _centroids(self) -> tuple[np.ndarray, int]:
        rows = self.log.table("centroids").orderBy("list").collect()  # at most MOST_LISTS
        return np.array([r["centroid"] for r in rows]), rows[0]["probes"]

    def _made(self, vectors: DataFrame) -> tuple[dict[str, DataFrame], list[DataFrame]]:
        """The tables of a segment, and the stored ones that they are read from."""
        centroids, _ = self._centroids()
        rows = vectors.select("chunk_id", (F.col("doc_id") if "doc_id" in vectors.columns else F.col("chunk_id")).alias("doc_id"), "vector")
        c, d = (rows.schema[f].dataType.simpleString() for f in ("chunk_id", "doc_id"))
        placed = stored(rows.mapInArrow(_assigned(centroids), f"chunk_id {c}, doc_id {d}, data binary, list int, far double"), "placed")
        lists = placed.groupBy("list").agg(F.ceil(F.count("*") / self._block_rows(centroids)).cast("long").alias("parts"), F.max("far").alias("radius"))  # at most MOST_LISTS rows
        dealt = placed.join(F.broadcast(lists.select("list", "parts")), "list").withColumn("block", F.pmod(F.xxhash64("chunk_id"), "parts"))
        blocks = dealt.select("list", "block", "chunk_id", "data").repartition("list", "block").sortWithinPartitions("list", "block")
        return {"blocks": blocks, "ids": dealt.select("list", "block", "chunk_id", "doc_id"), "lists": lists.select("list", "radius")}, [placed]

    @staticmethod
    def _block_rows(centroids: np.ndarray) -> int:
        """Rows of a block and of a shard, about."""
        return max(1, CELLS // centroids.shape[1])

    def add(self, vectors: DataFrame, work: str | None = None) -> int | None:
        """Add rows (chunk_id, doc_id if there is one, vector); those of the same chunk_id are replaced. Ids are distinct within one call."""
        tables, temporary = self._made(vectors)
        gone = tables["ids"].select(F.col("chunk_id").alias("key")) if self.log.table("blocks") is not None else None
        number = self.log.append(tables, gone, work, partitions={"blocks": "list"})
        drop_stored(*temporary)
        return number

    def remove(self, ids: DataFrame, work: str | None = None) -> int | None:
        """Take chunks (chunk_id) out."""
        return self.log.append({}, ids.select(F.col("chunk_id").alias("key")), work)

    def remove_documents(self, documents: DataFrame, work: str | None = None) -> int | None:
        """Take all chunks of documents (doc_id) out."""
        return self.remove(self.ids().join(documents.select("doc_id").distinct(), "doc_id", "left_semi"), work)

    def ids(self) -> DataFrame:
        """(chunk_id, doc_id, list) of the live rows."""
        return self.log.live("ids", "chunk_id")

    def compact(self) -> int | None:
        """One segment of centroids and all live rows in place of many."""
        live = stored(self.vectors(), "live")
        tables, temporary = self._made(live)
        centroids = stored(self.log.table("centroids").drop("segment").coalesce(1), "centroids")
        number = self.log.compact({**tables, "centroids": centroids}, partitions={"blocks": "list"})
        drop_stored(live, centroids, *temporary)
        return number

    def vectors(self) -> DataFrame:
        """(chunk_id, doc_id, vector) of the live rows."""
        c = self.ids().schema["chunk_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    values = _values(b.column("data"))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))
                    yield pa.record_batch([b.column("chunk_id"), flat, b.column("segment")], names=["chunk_id", "vector", "segment"])

        rows = self.log.table("blocks").select("chunk_id", "data", "segment").mapInArrow(run, f"chunk_id {c}, vector array<double>, segment long")
        return rows.join(self.ids().select("chunk_id", "doc_id"), "chunk_id").groupBy("chunk_id", "doc_id").agg(F.max_by("vector", "segment").alias("vector"))

    def search(self, queries: DataFrame, k: int = CANDIDATES, probes: int | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank of the k best rows in the lists nearest to each query (query_id, vector)."""
        return self._search(queries, k, probes)

    def _search(self, queries: DataFrame, k: int, probes: int | None = None, floors: DataFrame | None = None) -> DataFrame:
        centroids, fitted = self._centroids()
        blocks, radius = self.log.table("blocks"), None
        q = queries.schema["query_id"].dataType.simpleString()
        if blocks is None:
            return self.spark.createDataFrame([], f"query_id {q}, chunk_id string, score double, rank int")
        c = blocks.schema["chunk_id"].dataType.simpleString()
        asks = queries.select("query_id", "vector")
        if floors is not None:
            asks, radius = asks.join(floors, "query_id", "left"), np.zeros(len(centroids))
            for r in self.log.table("lists").groupBy("list").agg(F.max("radius").alias("radius")).collect():
                radius[r["list"]] = r["radius"]
        shards = self._shards(centroids, apart=floors is None)
        places = [(r["list"], r["shard"]) for r in shards.select("list", "shard").distinct().collect()]  # a short row a list and shard
        routed = asks.mapInArrow(_routed(centroids, min(len(centroids), probes or fitted), radius, places), f"list int, query_id {q}, data binary")
        asked = stored(routed.withColumnRenamed("list", "shard").repartition("shard"), "asked")
        reached = shards.join(asked.select("shard").distinct(), "shard", "left_semi")
        none = lambda kind: F.lit(None).cast(kind)
        met = blocks.join(F.broadcast(reached), ["segment", "list", "block"]).select("shard", F.lit(OWN).alias("kind"), "segment", "chunk_id", none(q).alias("query_id"), "data")
        met = met.unionByName(asked.select("shard", F.lit(ASKED).alias("kind"), none("long").alias("segment"), none(c).alias("chunk_id"), "query_id", "data"))
        gone = self.log.removals()
        if gone is not None:
            dead = self.log.table("ids").join(gone, (F.col("chunk_id") == F.col("key")) & (F.col("segment") < F.col("removed_at"))).join(F.broadcast(reached), ["segment", "list", "block"])
            met = met.unionByName(dead.select("shard", F.lit(GONE).alias("kind"), "segment", "chunk_id", none(q).alias("query_id"), none("binary").alias("data")))
        found = met.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_best(k), f"query_id {q}, chunk_id {c}, raw double")
        return ranked(found.select("query_id", "chunk_id", F.round("raw", 6).alias("score")), "score", k)

    def _shards(self, centroids: np.ndarray, apart: bool) -> DataFrame:
        """(segment, list, block, shard): blocks in shards of about CELLS components, of one list each if apart, else of neighbouring lists."""
        order = Window.partitionBy("list").orderBy("segment", "block") if apart else Window.orderBy("list", "segment", "block")  # one short row a block
        sized = self.log.table("ids").groupBy("segment", "list", "block").agg(F.count("*").alias("n"))
        part = F.floor((F.sum("n").over(order) - F.col("n")) / self._block_rows(centroids))
        return sized.select("segment", "list", "block", (part * len(centroids) + F.col("list") if apart else part).cast("int").alias("shard"))

    def exact(self, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
        """The k best of all rows.

        The k-th best score in a few nearest lists is a floor; then every list is
        visited in which a row within its radius may reach that floor. Since
        these may be most lists, neighbouring lists form shards, to which a
        query goes once.
        """
        floors = self._search(queries, k, min(FLOOR_LISTS, self._centroids()[1])).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        return self._search(queries, k, floors=floors)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Queries, results of the exact search, those that were found too, and their share."""
    hits = exact.join(found.select("query_id", "chunk_id", F.lit(True).alias("hit")), ["query_id", "chunk_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("results"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
