"""Best-fit packing of token pieces by exact complements of lengths (operator 2)."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm._shared import stored
from parlance.llm.tokens import Coder

CAPACITY, END_ID = 1024, 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = Coder.of(path), np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = coder.ids(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (doc_id, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e]))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many of them), from how many pieces have each length.

    The input has at most `capacity` rows whatever the corpus holds, so this
    runs on the driver. From the longest length down, a piece's gap is filled
    exactly by one length, else a pair, else a triple, as often as the
    availability counts allow; each such step uses up a length. What has no
    exact complement is placed best fit, longest first, whole groups of equal
    sequences at a time.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(*lengths: int) -> bool:
        need = Counter(lengths)
        times = min(have[x] // k for x, k in need.items())
        if times < 1:
            return False
        for x, k in need.items():
            have[x] -= k * times
        out.append((lengths, int(times)))
        return True

    if have[capacity]:
        consume(capacity)
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if have[a] and have[gap]:
            consume(a, gap)
        if have[a]:
            for b in range(min(gap - 1, a), (gap - 1) // 2, -1):
                if not have[a]:
                    break
                if have[b] and have[gap - b]:
                    consume(a, b, gap - b)
        if have[a]:
            there = have > 0
            pair_sums = np.convolve(there, there) > 0  # index of what two lengths can add up to
            for b in range(min(gap - 2, a), 0, -1):
                if not have[a]:
                    break
                if not have[b] or not pair_sums[gap - b]:
                    continue
                rest = gap - b
                for c in range(min(rest - 1, b), (rest - 1) // 2, -1):
                    if not have[a] or not have[b]:
                        break
                    if have[c] and have[rest - c]:
                        consume(a, b, c, rest - c)
    open_at: dict[int, list[list]] = defaultdict(list)  # free room: [lengths, count] groups
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            room = min((r for r, g in open_at.items() if r >= length and g), default=None)
            if room is None:
                each = capacity // length
                for k, times in ((each, left // each), (left % each, 1)):
                    if k and times:
                        open_at[capacity - k * length].append([(length,) * k, times])
                break
            group = open_at[room][-1]
            taken = min(left, group[1])
            group[1] -= taken
            if not group[1]:
                open_at[room].pop()
            open_at[room - length].append([(*group[0], length), taken])
            left -= taken
    out += [(tuple(lengths), n) for groups in open_at.values() for lengths, n in groups]
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of a run of pieces, its first sequence, its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used, sequence = Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            runs[x].append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(v, dtype=np.int64) for v in zip(*r)) for x, r in runs.items()}


def _placed(slots: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                first, base, at = slots[int(x)]
                of = length == x
                run_no = np.searchsorted(first, rank[of], side="right") - 1
                sequence[of] = base[run_no] + rank[of] - first[run_no]
                offset[of] = at[run_no]
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 100_000) -> DataFrame:
    """Give each piece its sequence and its place there.

    pieces must be a stored table: it is read twice. Pieces of one length are
    numbered in buckets of about rows_per_bucket rows, so that a length that
    most pieces share isn't numbered by one task; a bucket's first number comes
    from the counts per (length, bucket). Numbers are turned into places by a
    search in the plan, whose size depends on the capacity alone.
    """
    total = pieces.count()
    buckets = max(1, -(-total // rows_per_bucket))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").count()
    per_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")
    firsts = counts.select("length", "bucket", before.alias("first"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("rank", (number - 1).cast("long")).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first"))
    slots = _slots(plan_patterns(per_length, capacity), capacity)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(slots), f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Code, cut and pack whole documents into sequences of at most `capacity` ids.

    A null or empty text is the end id alone. Repeated rows are packed each;
    null ids stay null; an empty table gives no rows. Only documents longer
    than a sequence are cut; the first piece then takes the remainder.
    """
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECE)
    return pack_pieces(stored(pieces, "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
