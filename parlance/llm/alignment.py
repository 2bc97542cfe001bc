"""Tokens of two tokenizers aligned by divide and conquer at shared cuts (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm._shared import drop_stored, stored
from parlance.llm.tokens import Coder, _byte_of

#: Up to so many distinct id pairs (17 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: Characters of texts aligned at once: as many as a processor's cache holds.
_AT_ONCE = 200_000
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in a of the ends that b has too; a and b are rising ends of tokens over the same bytes.

    Divide and conquer: an interval's ends are tried from its middle outward,
    each by bisection in b; the first shared one cuts the interval, and both
    halves go on. Ends already tried belong to neither half, so each end is
    tried once; an interval without a shared end is a leaf. All intervals
    of a level take a step together, so a level costs a few array operations.
    """
    shared = np.zeros(len(a), bool)
    low, high = np.array([0]), np.array([len(a)])  # untried ends of each interval: low <= place < high
    if not len(a) or not len(b):
        return np.flatnonzero(shared)
    middle = (low + high) // 2
    left, right = middle.copy(), middle.copy()  # tried: left <= place < right
    while len(low):
        up = (right < high) & ((right - middle <= middle - left) | (left <= low))
        place = np.where(up, right, left - 1)
        at = np.minimum(np.searchsorted(b, a[place]), len(b) - 1)
        cut = b[at] == a[place]
        left, right = np.where(up, left, left - 1), np.where(up, right + 1, right)
        shared[place[cut]] = True
        # a shared end parts what is untried on its left from what is untried on its right
        new_low, new_high = np.concatenate([low[cut], right[cut]]), np.concatenate([left[cut], high[cut]])
        some = new_low < new_high
        new_low, new_high = new_low[some], new_high[some]
        new_middle = (new_low + new_high) // 2
        on = ~cut & ((left > low) | (right < high))
        low, high = np.concatenate([low[on], new_low]), np.concatenate([high[on], new_high])
        middle, left, right = (np.concatenate([x[on], new_middle]) for x in (middle, left, right))
    return np.flatnonzero(shared)


class Aligner:
    """Two tokenizers with the bytes of their tokens.

    The first is a byte-level BPE file of the tokenizers library and reads a
    space and the text; the second is a sentencepiece model, which adds the
    space itself. Strings of special tokens are plain text to both.
    """

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.coder, self.library, self.pieces = Coder.of(first), Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        table = _byte_of()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        n = self.pieces.get_piece_size()
        self.b_bytes = [bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: How an id is written in the middle and at the end of its side of a group.
        self.written = [f"{i}{mark}" for size, marks in ((len(self.a_bytes), ",|"), (n, ",;")) for mark in marks for i in range(size)]

    @classmethod
    def of(cls, first: str, second: str) -> Aligner:
        if (first, second) not in _ALIGNERS:
            _ALIGNERS[first, second] = cls(first, second)
        return _ALIGNERS[first, second]

    def _first(self, text: str) -> np.ndarray | None:
        if self.coder.fast is not None:
            try:
                return self.coder.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)  # cuts the text's bytes and keeps them all
            except ValueError:  # the pattern's stack is full
                pass
        found = self.library.encode(text, add_special_tokens=False).ids
        return np.array(found, np.int64) if b"".join(map(self.a_bytes.__getitem__, found)) == text.encode() else None

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids; None where the bytes of either differ from a space and the text."""
        if not text:
            return None
        found = self.pieces.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, found)) != f" {text}".encode():
            return None
        a = self._first(f" {text}")
        return None if a is None else (a, np.array(found, np.int64))

    def groups(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """(tokens of the first, of the second, groups, digest, linked pairs) of each text, aligned as one sequence."""
        coded = [self.ids(t) for t in texts]
        real = [c for c in coded if c is not None]
        if not real:
            return [(0, 0, 0, "", np.empty(0, np.int64))] * len(texts)
        a, b = (np.concatenate([c[k] for c in real]) for k in (0, 1))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        last_a = shared_cuts(a_end, b_end)
        last_b = np.searchsorted(b_end, a_end[last_a])
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a] = ends_b[last_b] = 1
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        # group by group: the first side's ids, then the second's
        mark, n, m = np.empty(len(a) + len(b), np.int64), len(self.a_bytes), len(self.b_bytes)
        mark[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = a + n * ends_a
        mark[np.arange(len(b)) + (last_a + 1)[group_b]] = 2 * n + b + m * ends_b
        pairs, out, at, cut, a_cut = a[last_a] << 32 | b[last_b], [], 0, 0, 0
        for c in coded:
            if c is None:
                out.append((0, 0, 0, "", pairs[:0]))
                continue
            a_cut, size = a_cut + len(c[0]), len(c[0]) + len(c[1])
            done = int(np.searchsorted(last_a, a_cut - 1)) + 1  # a text's end is shared
            written = "".join(map(self.written.__getitem__, mark[at : at + size].tolist()))
            out.append((len(c[0]), len(c[1]), done - cut, hashlib.sha256(written[:-1].encode()).hexdigest(), pairs[cut:done]))
            at, cut = at + size, done
        return out


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"


def _aligned(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(first, second)

        def done(ids: list, texts: list) -> pa.RecordBatch:
            found = aligner.groups(texts)
            counted = [np.unique(f[4], return_counts=True) for f in found]
            columns = [pa.array(ids, pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3)), pa.array([f[3] for f in found], pa.string())]
            columns += [pa.array([p.tobytes() for p, _ in counted], pa.binary()), pa.array([n.astype(np.int64).tobytes() for _, n in counted], pa.binary())]
            return pa.record_batch(columns, names=[c.split()[0] for c in _ALIGNED.split(", ")])

        for b in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= _AT_ONCE:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, links) of some million rows' pairs at a time."""

    def summed(pairs: list, times: list) -> pa.RecordBatch:
        pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, np.concatenate(times))
        return pa.record_batch([pa.array(pair), pa.array(n)], names=["pair", "n"])

    pairs, times, size = [], [], 0
    for b in batches:
        for p, t in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist()):
            pairs.append(np.frombuffer(p, np.int64))
            times.append(np.frombuffer(t, np.int64))
            size += len(pairs[-1])
            if size >= 1 << 20:
                yield summed(pairs, times)
                pairs, times, size = [], [], 0
    if pairs:
        yield summed(pairs, times)


def _summed(pair: np.ndarray, n: np.ndarray, best: np.ndarray):
    """Each row's links by the corpus's counts of its pairs, which stand sorted by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, total = [], []
            for p, t in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist()):
                at, times = np.searchsorted(pair, np.frombuffer(p, np.int64)), np.frombuffer(t, np.int64)
                good.append(int(times[best[at]].sum()))
                total.append(int((times * n[at]).sum()))
            kept = b.schema.names[:5]
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(good, pa.int64()), pa.array(total, pa.int64())], names=[*kept, "n_best", "count_sum"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pair, times) of each row's distinct pairs."""
    for b in batches:
        for row, p, t in zip(b.column("row").to_pylist(), b.column("pairs").to_pylist(), b.column("times").to_pylist()):
            if p:
                yield pa.record_batch([pa.array(np.full(len(p) // 8, row, np.int64)), pa.array(np.frombuffer(p, np.int64)), pa.array(np.frombuffer(t, np.int64))], names=["row", "pair", "times"])


def align_tokens(docs: DataFrame, first: str, second: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Groups of tokens of two tokenizers that cover the same bytes, and how usual their links are in the corpus.

    docs has doc_id and text; first names a byte-level BPE file, second a
    sentencepiece model. Offsets where tokens of both end cut a text into groups.
    The tokens that end a group are linked; a pair of ids counts as often as it
    is linked in all documents. Returns for each row doc_id, n_a, n_b, n_groups,
    n_links, n_best (links whose count is the highest of their second id, ties
    included), count_sum (the sum of the links' counts) and groups_sha256.

    Texts are coded once; their distinct pairs are kept beside them. Counts are
    summed in tasks before they are shuffled. Up to `broadcast_pairs` distinct
    pairs go to all tasks as sorted arrays, which rows are looked up in; beyond,
    the rows' pairs are joined with the counts.

    Null and empty texts, and those whose tokens' bytes differ from a space
    and the text, have no tokens: zeros and an empty digest. Repeated rows and
    null ids each give a row and count; an empty table gives none. Further
    columns don't matter.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(texts.mapInArrow(_aligned(first, second), _ALIGNED).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = rows.select("pairs", "times").mapInArrow(_tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("second", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    most = counts.groupBy("second").agg(F.max("n").alias("most"))
    ranked = counts.join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    out = ("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
    if counts.count() <= broadcast_pairs:
        table = ranked.orderBy("pair").toArrow()
        pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
        return rows.mapInArrow(_summed(pair, n, best), _ALIGNED.replace(", pairs binary, times binary", ", n_best long, count_sum long")).select(*out)
    links = rows.select("row", "pairs", "times").mapInArrow(_listed, "row long, pair long, times long").join(ranked, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    whole = rows.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return whole.select(*out)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
