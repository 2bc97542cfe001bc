"""Near-duplicates by SimHash, found through deletion variants of segments (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm._components import connected_components
from parlance.llm._shared import drop_stored, stored

WORDS, BITS, SEED = 4, 4, 42
#: Rows of a signature up to this number give pairs by shifts; up to the second they are compared where they meet; beyond, in blocks of so many.
SMALL, LARGE = 24, 16_384
#: Shingles whose bits are counted at once, cells of a comparison, and links held before they are joined.
_AT_ONCE, _CELLS, _LINKS = 50_000, 1_000_000, 500_000


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bits that over half of a whole text's shingles have in their XXH64; shingles count as often as they occur."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    end = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    start, last = np.r_[0, end[:-1] + 1].tolist(), end.tolist()[min(words, len(tokens)) - 1 :]
    n, ones = len(last), np.zeros(64, np.int64)
    hashed, own = xxhash.xxh64_intdigest, zip(start, last)
    for at in range(0, n, _AT_ONCE):
        h = np.fromiter((hashed(whole[s:e], seed) for _, (s, e) in zip(range(min(_AT_ONCE, n - at)), own)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _printed(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words, seed) for t in b.column("text")], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return run


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit when `bits` bits differ in all."""
    count = max(2, bits // 2 + 1)
    cuts = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def signatures(value: Column, bits: int) -> Column:
    """The keys of a fingerprint: of each segment the bits as they are, and without each one of them.

    Fingerprints whose segments are equal share the first; those that differ
    in one bit of it share the variant without that bit. A key names its
    segment and its missing bit above the segment's own bits.
    """
    keys, kind = [], 0
    for first, width in segments(bits):
        segment = F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1))
        for gone in (None, *range(width)):
            rest = segment if gone is None else segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << gone)))
            keys.append(rest + F.lit(kind << 40))
            kind += 1
    return F.array(*keys)


def _gone(bits: int) -> np.ndarray:
    """By kind of key the bit of the fingerprint that it leaves out, or -1."""
    return np.array([first + gone if gone >= 0 else -1 for first, width in segments(bits) for gone in range(-1, width)])


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) to as many as join the same rows: from each row to the least one that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[leaf], nodes[label[leaf]]


def _near(x: np.ndarray, y: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sides, or within one: compared in tiles, and joined tile by tile so that a dense group stays small."""
    step, left, right = int(_CELLS**0.5), [], []
    other = x if y is None else y
    for s in range(0, len(x), step):
        for t in range(s if y is None else 0, len(other), step):
            i, j = np.nonzero(np.bitwise_count(x[s : s + step, None] ^ other[None, t : t + step]) <= bits)
            if y is None and s == t:
                i, j = i[i < j], j[i < j]
            if len(i):
                a, b = _joined(x[s + i], other[t + j])
                left.append(a)
                right.append(b)
    return (np.concatenate(left), np.concatenate(right)) if left else (x[:0], x[:0])


def _within(key: int, group: np.ndarray, gone: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in the group of a key: all pairs, or where the key leaves out a bit those that differ in it (the others share the whole segment)."""
    bit = gone[key >> 40]
    if bit < 0:
        return _near(group, None, bits)
    has = (group >> np.uint64(bit)) & np.uint64(1) == 1
    return _near(group[has], group[~has], bits)


_MET = "a long, b long, key long"


def _meet(bits: int, small: int, large: int):
    """Rows (key, print) in order to links (key null), and the rows of keys with more than `large` prints (b null)."""
    gone = _gone(bits)

    def links(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = _joined(*(np.concatenate(side) for side in zip(*held)))
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value, held, size, spread = np.empty(0, np.int64), np.empty(0, np.uint64), [], 0, None
        for b in chain(batches, [None]):
            if b is not None:
                key = np.concatenate([key, b.column("key").to_numpy()])
                value = np.concatenate([value, b.column("print").to_numpy().view(np.uint64)])
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            huge = (sizes > large) | (key[starts] == spread if spread is not None else False)
            end = len(key) if b is None or huge[-1] else starts[-1]  # a group at the end may go on
            spread = int(key[-1]) if huge[-1] else None
            for s, n in zip(starts[huge], sizes[huge]):
                yield pa.record_batch([pa.array(value[s : s + n].view(np.int64)), pa.nulls(n, pa.int64()), pa.array(key[s : s + n])], names=["a", "b", "key"])
            whole = (starts < end) & ~huge
            few = np.repeat(whole & (sizes <= small), sizes)
            k, v = key[few], value[few]
            for shift in range(1, small):
                same = np.flatnonzero(k[:-shift] == k[shift:]) if shift < len(k) else ()
                if not len(same):
                    break
                same = same[np.bitwise_count(v[same] ^ v[same + shift]) <= bits]
                if len(same):
                    held.append((v[same], v[same + shift]))
                    size += len(same)
            for s, n in zip(starts[whole & (sizes > small)], sizes[whole & (sizes > small)]):
                found = _within(int(key[s]), value[s : s + n], gone, bits)
                if len(found[0]):
                    held.append(found)
                    size += len(found[0])
            if size >= _LINKS:
                yield links(held)
                held, size = [], 0
            key, value = key[end:], value[end:]
        if held:
            yield links(held)

    return run


def _blocks(bits: int):
    """Rows of large groups in the order of key and block (x, y) to links between part x and part y of the key's prints."""
    gone = _gone(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            k, x, y = now
            part, value = np.concatenate(parts), np.concatenate(values)
            bit = gone[k >> 40]
            one, two = value[part == x], value[part == y]
            if x == y:
                a, b = _within(k, value, gone, bits)
            elif bit < 0:
                a, b = _near(one, two, bits)
            else:
                has = lambda v: (v >> np.uint64(bit)) & np.uint64(1) == 1
                a, b = (np.concatenate(side) for side in zip(_near(one[has(one)], two[~has(two)], bits), _near(one[~has(one)], two[has(two)], bits)))
            if len(a):
                yield pa.record_batch([pa.array(side.view(np.int64)) for side in _joined(a, b)], names=["a", "b"])

        now, parts, values = None, [], []
        for b in batches:
            k, x, y = (b.column(c).to_numpy() for c in ("key", "x", "y"))
            cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(k) else []
            for s, e in zip(cuts, [*cuts[1:], len(k)]):
                if (block := (int(k[s]), int(x[s]), int(y[s]))) != now:
                    if now is not None:
                        yield from done()
                    now, parts, values = block, [], []
                parts.append(b.column("part").to_numpy()[s:e])
                values.append(b.column("print").to_numpy()[s:e].view(np.uint64))
        if now is not None:
            yield from done()

    return run


def near_links(prints: DataFrame, bits: int = BITS, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs that differ in at most `bits` bits do.

    prints has distinct fingerprints (print, a long). With `bits` bits cut into
    bits // 2 + 1 segments, one segment differs by at most one bit: either its
    exact key or the variant without that bit is shared. Prints that meet by key
    are verified where they meet; a key without a bit compares only prints that
    differ there, so a pair is compared once a segment. Groups are joined before
    they leave a task, so no group is listed in pairs. Keys with over `large`
    prints are dealt in parts, and each pair of parts is a block of its own.
    """
    keyed = prints.select(F.explode(signatures(F.col("print"), bits)).alias("key"), "print")
    met = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(bits, small, large), _MET), "met")
    links = met.where("key is null").select("a", "b")
    rows = met.where("key is not null").select("key", F.col("a").alias("print"))
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / large).cast("int").alias("parts"))
    placed = rows.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("print"), "parts").cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = other.select("key", "print", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    found = stored(links.unionByName(dealt.mapInArrow(_blocks(bits), "a long, b long")), "links")
    drop_stored(met)
    return found


def simhash_components(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Each document's fingerprint and the smallest doc_id that it reaches by links of at most `bits` bits.

    docs has doc_id and text. A-Z are lower-cased; a fingerprint's bit is 1 if
    over half of the text's `words`-word shingles, repeats included, have it in
    their XXH64; shorter texts are one shingle. Returns doc_id, fingerprint (16
    hex digits) and component_id. Documents with equal fingerprints are one row
    of the search, whatever their number; work on near copies with g different
    fingerprints in one key grows as g * g / 2, spread over tasks.

    Null and empty texts and texts without words have fingerprint zero and
    link like any others. Repeated rows are copies. Rows with a null id take
    part; a component of such rows alone has a null id. Further columns don't
    matter. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prints = stored(rows.mapInArrow(_printed(words, seed), "doc_id long, print long"), "prints")
    owners = stored(prints.groupBy("print").agg(F.min("doc_id").alias("owner")), "owners")
    links = near_links(owners.select("print"), bits, small, large)
    named = owners.join(connected_components(links).withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("owner").alias("component_id"))
    ids = named.join(least, "component").select("print", "component_id")
    drop_stored(links)
    return prints.join(ids, "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
