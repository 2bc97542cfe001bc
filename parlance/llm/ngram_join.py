"""N-gram Jaccard join by vertical partitioning of the global n-gram order (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm._components import connected_components
from parlance.llm._shared import drop_stored, mix64, stored

WORDS, PERCENT = 5, 80
#: N-grams met in more documents than this go last in the global order; at most so many.
FREQUENT, MOST_FREQUENT = 50, 200_000
#: Groups of an n-gram up to this size give their pairs; larger ones are compared by sketches where they meet.
SMALL_GROUP = 16
#: Rows of a large group, and nodes and n-grams of a family, that one block holds; what is larger is split into blocks.
GROUP_ROWS, FAMILY_NODES, FAMILY_GRAMS = 8192, 512, 1_000_000
#: Up to this many document ids are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Words hashed at once, and n-grams tallied at once: enough to pay for the calls, few enough for any task.
_AT_ONCE, _TALLIED = 100_000, 1_000_000
#: Cells of a matrix of n-grams that a fragment's overlaps are counted with.
_CELLS = 4_000_000


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + len(out)]
    return mix64(out)


def _hashed(texts: list[list[bytes]], words: int) -> Iterator[np.ndarray]:
    flat = np.empty(sum(map(len, texts)), object)
    flat[:] = list(chain.from_iterable(texts))
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
    whole, at = _rolled(h, words) if len(h) >= words else h[:0], 0
    for tokens in texts:
        n = len(tokens)
        own = whole[at : at + n - words + 1] if n >= words else _rolled(h[at : at + n], n) if n else h[:0]
        yield np.unique(own)
        at += n


def shingle_sets(texts: Iterable[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingles of each whole text as sorted 64-bit hashes, text by text.

    Sorting by hash is the global order: it is the same for all documents and
    needs no statistics, and equal ranges of it hold equal shares of n-grams.
    """
    held, size = [], 0
    for text in texts:
        held.append((text or b"").lower().split())
        size += len(held[-1])
        if size >= _AT_ONCE:
            yield from _hashed(held, words)
            held, size = [], 0
    yield from _hashed(held, words)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch.column("text"))


def _longest_prefix(n: int, percent: int) -> int:
    """With this many first n-grams of each set, linked sets share one of them."""
    return n - -(-percent * n // 100) + 1


def _tally(words: int, least: int):
    """(n-gram, count) of those met at least `least` times in some million of a task."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
        return pa.record_batch([pa.array(grams[n >= least].view(np.int64)), pa.array(n[n >= least].astype(np.int64))], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for s in shingle_sets(_texts(b), words):
                held.append(s)
                size += len(s)
                if size >= _TALLIED:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    return run


def frequent_grams(docs: DataFrame, words: int, over: int = FREQUENT, at_most: int = MOST_FREQUENT) -> np.ndarray:
    """N-grams to put last in the global order, sorted; at most `at_most`.

    Every document is counted, but n-grams met only once or twice in millions
    aren't sent. Any set gives the same links: this one only keeps passages
    that many documents share out of their prefixes. Large groups that it
    misses are split where they are compared.
    """
    counts = docs.select("text").mapInArrow(_tally(words, 3), "gram long, n long")
    top = counts.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > over).orderBy(F.desc("n"), "gram").limit(at_most)
    return np.sort(np.array([r["gram"] for r in top.select("gram").collect()], dtype=np.int64).view(np.uint64))


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parities of n-grams by hash, about one bit an n-gram: 128 bits, or the next power of two over the set's size."""
    bits = 1 << max(7, (len(s) - 1).bit_length())
    parity = np.bincount(((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def _digest(shingles: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


_PROFILE = "doc_id long, h long, node long, n int, prefix array<long>, common array<long>, sketch array<long>, half array<long>"


def _profile(words: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a copy met again in this task needn't send its prefix again
        for b in batches:
            nodes, sizes, lists = [], [], ([], [], [], [])
            for s in shingle_sets(_texts(b), words):
                node = _digest(s)
                nodes.append(node)
                sizes.append(len(s))
                if node is None or node in seen:
                    for column in lists:
                        column.append(None)
                    continue
                if len(seen) < 100_000:
                    seen.add(node)
                often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
                most, rare = _longest_prefix(len(s), percent), s[~often]
                sketch = _sketch(s)
                half = len(sketch) // 2
                for column, value in zip(lists, (rare[:most].view(np.int64), s[often][: max(0, most - len(rare))].view(np.int64), sketch, sketch[:half] ^ sketch[half:])):
                    column.append(value)
            longs = pa.list_(pa.int64())
            names = [f.split()[0] for f in _PROFILE.split(", ")]
            yield pa.record_batch([b.column("doc_id"), b.column("h"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(column, longs) for column in lists)], names=names)

    return run


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows as tuples, a few hundred at a time."""
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def _links(na, nb, overlap, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def _met(percent: int, small: int):
    """Rows (gram, n, node) in order to pairs of small groups (gram null), and the rows of larger groups (b null)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("gram", pa.int64())])

    def rows_of(node, n, gram) -> pa.RecordBatch:
        k = len(node)
        return pa.record_batch([pa.array(node), pa.nulls(k, pa.int64()), pa.array(n), pa.nulls(k, pa.int32()), pa.array(gram)], schema=schema)

    def pairs_in(gram, node, n) -> list[np.ndarray]:
        out = []
        for k in range(1, min(small, len(gram))):
            i = np.flatnonzero((gram[:-k] == gram[k:]) & (node[:-k] != node[k:]) & (100 * n[:-k].astype(np.int64) >= percent * n[k:].astype(np.int64)))
            if len(i):
                out.append(np.stack([node[i], node[i + k], n[i], n[i + k]]))
        return out

    def distinct(pairs: list[np.ndarray]) -> pa.RecordBatch:
        a, b, na, nb = np.concatenate(pairs, axis=1)
        swap = a > b
        a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
        order = np.lexsort((b, a))
        first = np.ones(len(a), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        keep = order[first]
        return pa.record_batch([pa.array(a[keep]), pa.array(b[keep]), pa.array(na[keep].astype(np.int32)), pa.array(nb[keep].astype(np.int32)), pa.nulls(len(keep), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, node, n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        large, held, size = None, [], 0  # large: the n-gram whose group is already known to be large
        for b in chain(batches, [None]):
            if b is not None:
                g, x, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "node", "n"))
                gram, node, n = np.concatenate([gram, g]), np.concatenate([node, x]), np.concatenate([n, k])
                again = np.zeros(len(gram), bool)  # copies stand side by side
                again[1:] = (gram[1:] == gram[:-1]) & (node[1:] == node[:-1])
                gram, node, n = gram[~again], node[~again], n[~again]
            if not len(gram):
                continue
            starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            sizes = np.diff(np.r_[starts, len(gram)])
            big = np.repeat((sizes > small) | (gram[starts] == large if large is not None else False), sizes)
            end = len(gram) if b is None or big[-1] else starts[-1]  # a group at the end may go on
            large = int(gram[-1]) if big[-1] else None
            done, big = slice(0, end), big[:end]
            if big.any():
                yield rows_of(node[done][big], n[done][big], gram[done][big])
            held += (found := pairs_in(gram[done][~big], node[done][~big], n[done][~big]))
            size += sum(x.shape[1] for x in found)
            if size >= 500_000:
                yield distinct(held)
                held, size = [], 0
            gram, node, n = gram[end:], node[end:], n[end:]
        if held:
            yield distinct(held)

    return run


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the edges (i, j): each row has the least row of its component."""
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _sketched(percent: int):
    """Rows of large groups, in order, to edges (a, b) from each node to the least one that it may be linked with.

    The group's sets are compared by size and sketch, block by block; nodes
    that may link directly or over others come out as one star.
    """

    def group(nodes: np.ndarray, n: np.ndarray, sketches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        label, width = np.arange(len(n)), np.array([len(s) for s in sketches])
        for w in np.unique(width):
            narrow = np.flatnonzero(width == w)
            a = np.stack([sketches[i] for i in narrow]).view(np.uint64)
            sides = [(narrow, a)]
            if len(wide := np.flatnonzero(width == 2 * w)):
                b = np.stack([sketches[i] for i in wide]).view(np.uint64)
                sides.append((wide, b[:, :w] ^ b[:, w:]))
            step = max(16, int((1_000_000 / w) ** 0.5))
            for own, b in sides:
                for s in range(0, len(narrow), step):
                    for t in range(s if own is narrow else 0, len(own), step):
                        x, y = narrow[s : s + step, None], own[None, t : t + step]
                        if 100 * n[x[-1, 0]] < percent * n[y[0, 0]]:  # rows stand by size
                            break
                        total = n[x] + n[y]
                        fits = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (label[x] != label[y])
                        if not fits.any():
                            continue
                        differ = np.bitwise_count(a[s : s + step, None, :] ^ b[None, t : t + step, :]).sum(2, dtype=np.int64)
                        i, j = np.nonzero(fits & (differ * (100 + percent) <= total * (100 - percent)))
                        label = _joined(label, x[i, 0], y[0, j])
        leaf = np.flatnonzero(label != np.arange(len(n)))
        return nodes[leaf], nodes[label[leaf]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groupby(_rows(batches, "gram", "x", "y", "node", "n", "sketch"), key=lambda r: r[:3]):
            nodes, n, sketches = zip(*((r[3], r[4], np.array(r[5], np.int64)) for r in found))
            a, b = group(np.array(nodes), np.array(n, np.int64), list(sketches))
            if len(a):
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _may_link(percent: int):
    """False only for pairs that can't link: by their sizes, or by their sketches.

    Each n-gram that only one of the sets has flips one bit of one sketch, so
    the sketches differ in at most as many bits as the sets do in n-grams. A
    sketch's width is the next power of two over one bit an n-gram; sets
    near enough in size differ by one power at most, and folding a sketch
    gives that of half the width.
    """
    a, b = ({k: F.col(f"{s}_{k}") for k in ("sketch", "half")} for s in "ab")
    # with overlap o: 100 o >= percent (na + nb - o), so the difference na + nb - 2 o is at most this
    most = (F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent)

    def bits(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)

    wide, narrow = F.size(a["sketch"]) > F.size(b["sketch"]), F.size(a["sketch"]) < F.size(b["sketch"])
    differing = F.when(wide, bits(a["half"], b["sketch"])).when(narrow, bits(a["sketch"], b["half"])).otherwise(bits(a["sketch"], b["sketch"]))
    return differing <= most + 1e-6


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of left link with which of right (or with which others of left): a matrix of booleans.

    The order is cut into fragments of hashes. Overlaps are counted in each
    fragment separately, by a product of its incidence matrices, and summed
    per pair. Counting ends early when the n-grams that are left can't change
    any pair's verdict.
    """
    sets = left + (right or [])
    na, n = len(left), np.array([len(s) for s in sets])
    fragments = 1 << max(1, int(np.ceil(np.log2(max(1, n.sum() * len(sets) / (2 * _CELLS))))))
    shift = np.uint64(65 - fragments.bit_length())
    cuts = np.stack([np.searchsorted(s >> shift, np.arange(fragments + 1)) for s in sets])
    rows, cols = slice(0, na), slice(na, None) if right is not None else slice(0, na)
    overlap = np.zeros((na, len(n[cols])))
    for f in range(fragments):
        parts = [s[c[f] : c[f + 1]] for s, c in zip(sets, cuts)]
        grams, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1
        owner = np.repeat(np.arange(len(sets)), [len(p) for p in parts])
        shared = times[at] > 1
        has = np.zeros((len(sets), int((times > 1).sum())), np.float32)
        has[owner[shared], place[at[shared]]] = 1
        overlap += has[rows] @ has[cols].T
        rest = n - cuts[:, f + 1]
        yes = _links(n[rows, None], n[None, cols], overlap, percent)
        doubt = _links(n[rows, None], n[None, cols], overlap + np.minimum(rest[rows, None], rest[None, cols]), percent) & ~yes
        if right is None:
            for verdict in (yes, doubt):
                np.fill_diagonal(verdict, False)
        if not doubt.any():
            break
    return yes


_FOUND = "node long, label long, links long, parts int"


def _verified(words: int, percent: int):
    """Blocks of families, in order, to each node's least linked node in the block and its linked documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches, "family", "x", "y", "part", "parts", "node", "copies", "text")
        for (_, x, y), found in groupby(rows, key=lambda r: r[:3]):
            found = list({r[5]: r for r in found}.values())  # an owner may stand on several equal rows
            found.sort(key=lambda r: (r[3] == y, r[5]))
            sets = list(shingle_sets((r[7] for r in found), words))
            nodes, copies = np.array([r[5] for r in found]), np.array([r[6] for r in found], np.int64)
            cut = sum(r[3] == x for r in found)
            if x == y:
                yes = linked_pairs(sets, None, percent)
                links = yes @ copies
                i, j = np.nonzero(np.triu(yes))
            else:
                if not 0 < cut < len(found):
                    continue
                yes = linked_pairs(sets[:cut], sets[cut:], percent)
                links = np.r_[yes @ copies[cut:], copies[:cut] @ yes]
                i, j = np.nonzero(yes)
                j = j + cut
            label = _joined(np.arange(len(nodes)), i, j)
            yield pa.record_batch([pa.array(nodes), pa.array(nodes[label]), pa.array(links.astype(np.int64)), pa.array([found[0][4]] * len(nodes), pa.int32())], names=["node", "label", "links", "parts"])

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows with part and parts, once for each pair of parts (x, y), x <= y, that has theirs."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return rows.select("*", other).select("*", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")).drop("other")


def _candidates(profile: DataFrame, nodes: DataFrame, percent: int, small: int, group_rows: int) -> DataFrame:
    """Edges (a, b) over nodes, among which every linked pair stands in one component."""
    along = Window.partitionBy("gram").orderBy("n", "node")
    rows = profile.select("node", "n", F.explode("prefix").alias("gram"))
    for name, move in (("before", F.lag), ("after", F.lead)):
        rows = rows.withColumn(f"{name}_node", move("node").over(along)).withColumn(f"{name}_n", move("n").over(along))
    fits = (F.col("before_node") != F.col("node")) & (100 * F.col("before_n") >= percent * F.col("n"))
    fits = F.coalesce(fits, F.lit(False)) | F.coalesce((F.col("after_node") != F.col("node")) & (100 * F.col("n") >= percent * F.col("after_n")), F.lit(False))
    meeting = rows.where(fits).select("gram", "node", "n").sortWithinPartitions("gram", "n", "node")
    met = stored(meeting.mapInArrow(_met(percent, small), "a long, b long, na int, nb int, gram long"), "met")

    sides = [nodes.select(F.col("node").alias(s), F.col("sketch").alias(f"{s}_sketch"), F.col("half").alias(f"{s}_half")) for s in "ab"]
    pairs = met.where("gram is null").select("a", "b", "na", "nb").distinct()
    near = pairs.join(sides[0], "a").join(sides[1], "b").where(_may_link(percent)).select("a", "b")

    common = profile.where("size(common) > 0").select(F.explode("common").alias("gram"), "node", "n")
    large = met.where("gram is not null").select("gram", F.col("a").alias("node"), F.col("na").alias("n")).unionByName(common).distinct()
    sizes = large.groupBy("gram").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts")).where("parts > 1")
    large = large.join(sizes, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = _blocks(large.join(nodes.select("node", "sketch"), "node")).repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y", "n", "node")
    stars = dealt.select("gram", "x", "y", "node", "n", "sketch").mapInArrow(_sketched(percent), "a long, b long")
    edges = stored(near.unionByName(stars).distinct(), "candidates")
    drop_stored(met)
    return edges


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, small: int = SMALL_GROUP, group_rows: int = GROUP_ROWS, family_nodes: int = FAMILY_NODES, family_grams: int = FAMILY_GRAMS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Documents linked by the Jaccard similarity of their n-gram sets: their components and their links.

    docs has doc_id and text. Two documents link when 100 * intersection >=
    percent * union of their sets of distinct `words`-grams. Returns one row a
    document: doc_id, n_shingles, component_id (the smallest doc_id reachable
    by links) and n_links (how many other documents it links with, copies
    included). n-grams and sets are compared by 64-bit hashes.

    1. Documents with equal sets become one node, whatever their number.
    2. The first part of a set's global order, its prefix, holds n - ceil(percent
       n / 100) + 1 n-grams; linked sets share one of them. Rows (n-gram, node)
       meet by n-gram; those whose neighbours in size are too small or too
       large go. Small groups give their pairs, once each a task, which
       sketches then sieve. Larger groups are compared by size and sketch in
       blocks where they stand, and give stars instead of pairs; a group over
       `group_rows` is split, and its pairs of parts go to different tasks.
    3. Nodes that may link, directly or over others, form a family. In a family
       all pairs are decided: overlaps are counted in each fragment of the
       order separately and summed per pair. Only links per node and stars
       leave a block. Families over `family_nodes` or `family_grams` are split
       as groups are, and their stars are joined by connected components.

    So every link between different texts is found and counted, and no group
    or family is listed in pairs or held whole. The work on a family of g
    near copies grows as g * g / 2 (that many links may exist), spread over
    tasks; rows and shuffled bytes grow as g * g / (2 * family_nodes).

    Null texts and texts without words have the empty set, size 0, no links,
    and their own id as component. Repeated rows are copies. Rows with a null
    id take part; a component of such rows alone has a null id. Further columns
    don't matter. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    frequent = frequent_grams(docs, words)
    profile = stored(docs.mapInArrow(_profile(words, percent, frequent), _PROFILE), "profile")
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("owner")
    nodes = profile.where("node is not null").groupBy("node").agg(owner, F.count("*").alias("copies"), F.max("n").alias("n"), *(F.first(c, ignorenulls=True).alias(c) for c in ("sketch", "half")))
    nodes = stored(nodes, "nodes")
    edges = _candidates(profile, nodes, percent, small, group_rows)
    members = stored(profile.select("doc_id", "node", "n"), "members")
    families = connected_components(edges)
    drop_stored(profile, edges)

    placed = families.withColumnRenamed("component", "family").join(nodes.select("node", "owner.doc_id", "owner.h", "copies", "n"), "node")
    parts = F.greatest(F.ceil(F.count("*") / family_nodes), F.ceil(F.sum("n") / family_grams)).cast("int")
    placed = stored(placed.join(placed.groupBy("family").agg(parts.alias("parts")), "family").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")), "families")
    side = F.broadcast(placed) if placed.count() <= broadcast_ids else placed
    texts = docs.alias("d").join(side.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.h").eqNullSafe(F.col("p.h"))).select("p.*", "d.text")
    dealt = _blocks(texts.select("family", "part", "parts", "node", "copies", "text")).repartition("family", "x", "y").sortWithinPartitions("family", "x", "y")
    found = stored(dealt.mapInArrow(_verified(words, percent), _FOUND), "found")

    spread = found.where("parts > 1 and node <> label")
    labels = found.where("parts = 1").select("node", F.col("label").alias("component"))
    if not spread.isEmpty():
        labels = labels.unionByName(connected_components(spread.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", F.col("owner.doc_id").alias("owner"), "copies").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("owner").alias("component_id"))
    ids = named.join(smallest, "component").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = members.withColumnRenamed("n", "n_shingles").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return whole.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
