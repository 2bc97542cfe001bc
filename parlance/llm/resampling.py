"""Importance resampling toward a target distribution, the cutoff found by weighted medians of medians (operator 11)."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm._shared import drop_stored, stored

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: A-Z to a-z; digits, a-z and all bytes of other scripts stay; everything else parts words.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Distinct features that a task holds at once.
_HELD = 500_000
#: The last so many keys in doubt are sorted on the driver.
FINISH = 1000
#: Smaller is better: score falling, null ids last, id rising, then the row's own number.
KEY = ("fall", "no_id", "id", "row")


def features(text: bytes | None, longest: int = LONGEST) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to `longest` words of a whole text, repeats included."""
    words = (text or b"").translate(_FOLD).split()
    return len(words), words + [b" ".join(words[i : i + k]) for k in range(2, longest + 1) for i in range(len(words) - k + 1)]


def _tally(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), Counter()

        def empty() -> None:
            place = np.fromiter(map(zlib.crc32, seen), np.int64, len(seen)) % buckets
            np.add.at(total, place, np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        for b in batches:
            for text in b.column("text"):
                seen.update(features(text.as_py(), longest)[1])
                if len(seen) > _HELD:
                    empty()
        empty()
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by hashed bucket; tasks send sums, so the driver sees one number a bucket."""
    sums = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_tally(buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier the target makes each bucket, with one added to every count."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


class _Gains(dict):
    """Gain by feature, looked up in the array of buckets when first met."""

    def __init__(self, gains: np.ndarray):
        self.gains, self.buckets = gains.tolist(), len(gains)

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _HELD:
            self.clear()
        gain = self[feature] = self.gains[zlib.crc32(feature) % self.buckets]
        return gain


def luck(doc_id: int | None, seed: int) -> int:
    """The document's Gumbel draw in thousandths, a function of the seed and its id alone; a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_features long, weight long, score long, words long, row long"


def _scored(gains: np.ndarray, longest: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gain_of, row = _Gains(gains), TaskContext.get().partitionId() << 40
        names = [f.split()[0] for f in _SCORED.split(", ")]
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                words, found = features(text.as_py(), longest)
                weight = sum(map(gain_of.__getitem__, found)) // len(found) if found else 0
                out.append((doc_id, len(found), weight, weight + luck(doc_id, seed), words, row))
                row += 1
            yield pa.record_batch([pa.array(column, pa.int64()) for column in (zip(*out) if out else [()] * len(names))], names=names)

    return run


def _key() -> Column:
    return F.struct(*KEY)


def _lit(key: tuple) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(KEY, key)))


def _median(keys: np.ndarray) -> tuple[int, ...]:
    """The lower median of keys (a column each), found by the first part and settled by the others where that ties."""
    k = (keys.shape[1] - 1) // 2
    first = np.partition(keys[0], k)[k]
    ties = keys[:, keys[0] == first]
    return tuple(int(v) for v in ties[:, np.lexsort(ties[::-1])[k - int((keys[0] < first).sum())]])


_SIDE = "after boolean, n long, " + ", ".join(f"{c} long" for c in KEY)


def _sides(pivot: tuple | None):
    """A task's keys before and after the pivot: how many, and the median of each side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(c).to_numpy() for c in KEY]) for b in batches if len(b)]
        if not parts:
            return
        keys, rows = np.concatenate(parts, axis=1), []
        after, level = np.zeros(keys.shape[1], bool), np.full(keys.shape[1], pivot is not None)
        for column, p in zip(keys, pivot or ()):
            after |= level & (column > p)
            level &= column == p
        for side in (False, True):
            mine = keys[:, (after == side) & ~level]
            if mine.shape[1]:
                rows.append((side, mine.shape[1], *_median(mine)))
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["after", "n", *KEY])

    return run


def _weighted_median(medians: list[tuple[tuple, int]]) -> tuple:
    medians, half = sorted(medians), sum(n for _, n in medians) / 2
    for key, n in medians:
        half -= n
        if half <= 0:
            return key
    raise ValueError("no medians")


def cutoff(keys: DataFrame, n: int, k: int, finish: int = FINISH) -> tuple:
    """The k-th smallest of n distinct keys (columns KEY), 1 <= k <= n.

    Each round, every partition gives the medians of its keys before and after
    a pivot and their numbers. The side with the k-th key goes on; its medians,
    weighted by the sizes that they stand for, have their weighted median as
    the next pivot. At least half the partitions by weight have half their keys
    on either side of it, so a quarter of all keys goes each round. What is left
    is written anew when it has shrunk to a quarter, so all rounds together read
    a fixed multiple of the table. The driver sees two short rows a partition.
    """
    held, wrote, pivot = n, None, None
    while n > finish:
        sides = [tuple(r) for r in keys.mapInArrow(_sides(pivot), _SIDE).collect()]
        if pivot is not None:
            before = sum(r[1] for r in sides if not r[0])
            if k == before + 1:
                return pivot
            after = k > before
            sides = [r for r in sides if r[0] == after]
            keys = keys.where(_key() > _lit(pivot) if after else _key() < _lit(pivot))
            k, n = (k - before - 1, n - before - 1) if after else (k, before)
            if n <= finish:
                break
            if 4 * n < held:
                fresh = stored(keys, "keys")
                if wrote is not None:
                    drop_stored(wrote)
                keys, held, wrote = fresh, n, fresh
        pivot = _weighted_median([(r[2:], r[1]) for r in sides])
    found = sorted(tuple(r) for r in keys.select(*KEY).collect())[k - 1]
    if wrote is not None:
        drop_stored(wrote)
    return found


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a task's rows, which stand in order, from 1."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), pa.array(np.arange(at + 1, at + len(b) + 1))], names=[*b.schema.names, "part", "place"])
        at += len(b)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, finish: int = FINISH) -> DataFrame:
    """Draw documents without replacement by how likely they are under the target's features.

    docs has doc_id and text, target has text. Words are runs of letters a-z
    (A-Z lower-cased), digits and all characters beyond ASCII; features are
    runs of 1 to `longest` words, counted over all texts into `buckets` hashed
    buckets. A document's weight is the floored mean of its features' gains, its
    score the weight and a Gumbel draw by seed and id. Of the N documents with
    at least `least_words` words the percent * N / 100 (floored) with the
    highest scores are drawn, ties to the smaller doc_id. Returns for each row
    doc_id, n_features, weight, score, rank (from 1; null where not drawn).

    The gains are an array of `buckets` numbers, sent to all tasks, by which
    rows are scored where they are read. Only keys of 32 bytes take part in the
    selection; the winners alone are sorted, by range, and numbered by their
    place in their range.

    Null and empty texts have no features, weight 0, and aren't drawn. Null ids
    stand last among equal scores. Repeated rows each count and each may be
    drawn; of rows with equal score and id, those read first. An empty target
    gives gains from the documents alone; an empty table gives no rows. Further
    columns don't matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = stored(docs.mapInArrow(_scored(gains, longest, seed), _SCORED), "scored")
    n = scored.where(F.col("words") >= least_words).count()
    k, out = percent * n // 100, ("doc_id", "n_features", "weight", "score")
    if k == 0:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    keyed = scored.withColumns({"fall": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))})
    able = keyed.where(F.col("words") >= least_words).select(*KEY)
    cut = _lit(cutoff(able, n, k, finish))
    wins = (F.col("words") >= least_words) & (_key() <= cut)
    winners = keyed.where(wins).select(*out, *KEY).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    kind = ", ".join(f"{c} long" for c in (*out, *KEY))
    placed = stored(winners.mapInArrow(_placed, f"{kind}, part int, place long"), "winners")
    sizes, first, before = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()), [], 0
    for part, size in sizes:  # a row a range
        first.append((part, before))
        before += size
    firsts = F.broadcast(docs.sparkSession.createDataFrame(first, "part int, first long"))
    drawn = placed.join(firsts, "part").select(*out, (F.col("first") + F.col("place")).alias("rank"))
    return drawn.unionByName(keyed.where(~wins).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
