"""A stored BM25 index: postings in segments, statistics added up when asked, and searches by shards of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.engines import engine
from parlance.operators.retrieval import B, CANDIDATES, K1, TOP, few_at_once, in_small_batches, ranked
from parlance.sources.segments import SegmentLog
from parlance.storage import drop_stored, stored

#: Rows (query, term) that go to all tasks at once, and postings of these that one task scores, about.
BLOCK_TERMS, SHARD_POSTINGS = 1_000_000, 250_000
#: A term in more than this share of a shard's chunks is only looked up for chunks that may win.
COMMON = 1 / 8
#: Scores have six decimals: what is nearer than this to a bound stays.
MARGIN = 1e-5
#: Parts over which a term's postings are dealt, so that no task gets all of a frequent term.
SALTS = 64
#: Under this many bytes for each core, chunks are dealt out before they are cut into terms.
SMALL_SHARE = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of few or small files dealt over all cores, since a file's row group is one task; large tables stay as they are."""
    spark, size = rows.sparkSession, 0
    for name in rows.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if size >= SMALL_SHARE * spark.sparkContext.defaultParallelism:
            return rows
    return rows.repartition(spark.sparkContext.defaultParallelism)


def digest_of(chunks: DataFrame) -> Column:
    """A hash of all that the index takes from a chunk."""
    return F.xxhash64(*(F.coalesce(c, F.lit("")) for c in (["title", "text"] if "title" in chunks.columns else ["text"])))


def _counted(terms: pa.ListArray, known: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code of the term in known, times) for each term of each row, in order; null rows have none."""
    ends = np.concatenate([[0], np.cumsum(terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    row = np.repeat(np.arange(len(terms)), np.diff(ends))
    code = pc.index_in(terms.flatten(), known).to_numpy(zero_copy_only=False).astype(np.int64)
    both, n = np.unique(row * max(1, len(known)) + code, return_counts=True)
    return both // max(1, len(known)), both % max(1, len(known)), n


def _postings(kind: pa.DataType):
    schema = pa.schema([("term", pa.string()), ("chunk_id", kind), ("tf", pa.int32()), ("text_tf", pa.int32()), ("length", pa.int32()), ("digest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_at_once(batches):
            text, title, ids = b.column("terms"), b.column("title_terms"), b.column("chunk_id").cast(kind)
            known = pc.unique(pa.concat_arrays([text.flatten(), title.flatten()]))
            size = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in (text, title)]
            length, width = size[0] + size[1], max(1, len(known))
            in_text, in_title = (_counted(c, known) for c in (text, title))
            keys = [row * width + code for row, code, _ in (in_text, in_title)]
            both = np.union1d(*keys)
            times = np.zeros((2, len(both)), np.int64)
            for own, key, (_, _, n) in zip(times, keys, (in_text, in_title)):
                own[np.searchsorted(both, key)] = n
            row, code = both // width, both % width
            none = np.zeros(len(b), np.int32)
            yield pa.record_batch([pa.array([""] * len(b), pa.string()), ids, none, none, pa.array(length.astype(np.int32)), b.column("digest")], schema=schema)
            yield pa.record_batch([known.take(pa.array(code)), ids.take(pa.array(row)), pa.array(times.sum(axis=0).astype(np.int32)), pa.array(times[0].astype(np.int32)), pa.array(length[row].astype(np.int32)), pa.nulls(len(row), pa.int64())], schema=schema)

    return run


def _shard_scores(spans: list[tuple[int, int, float]], code: np.ndarray, part: np.ndarray, most: dict[int, float], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunk codes, scores) that hold the k best of a shard's n chunks; spans are (start, end, weight) of a query's terms, whose codes rise."""
    rare = [x for x in spans if x[1] - x[0] <= COMMON * n]
    common = [x for x in spans if x[1] - x[0] > COMMON * n]

    def total(of: list) -> np.ndarray:
        return np.bincount(np.concatenate([code[s:e] for s, e, _ in of]), np.concatenate([w * part[s:e] for s, e, w in of]), n) if of else np.zeros(n)

    score = total(rare)
    rest = sum(w * most[s] for s, _, w in common)
    floor = np.partition(score, -k)[-k] if n > k else 0.0
    keep = np.flatnonzero(score + rest >= floor - MARGIN) if common and floor > rest else None
    if keep is None:
        score += total(common)
        keep = np.flatnonzero(score)
        score = score[keep]
    else:
        score = score[keep]
        for s, e, w in common:
            at = np.minimum(np.searchsorted(code[s:e], keep), e - s - 1)
            score += w * part[s + at] * (code[s + at] == keep)
    if len(score) > k:
        near = score >= np.partition(score, -k)[-k] - MARGIN  # what rounds to the k-th score may still win by its id
        keep, score = keep[near], score[near]
    return keep, score


def _scored(asked: dict, weights: dict[str, float], k: int, query_type: pa.DataType):
    """Rows (shard, term, chunk_id, part) in order to each query's best chunks of the shard."""

    def best(terms: list[pa.Array], chunks: list[pa.Array], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, ids = (pa.concat_arrays(x).dictionary_encode() for x in (terms, chunks))
        word, code, part = words.indices.to_numpy(), ids.indices.to_numpy(), np.concatenate(parts)
        order = np.lexsort((code, word))
        word, code, part = word[order], code[order], part[order]
        cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        places = dict(zip(words.dictionary.take(pa.array(word[cuts])).to_pylist(), zip(cuts.tolist(), [*cuts[1:].tolist(), len(word)])))
        most = dict(zip(cuts.tolist(), np.maximum.reduceat(part, cuts).tolist()))
        queries, found = [], []
        for query_id, own in asked.items():
            spans = [(*places[t], weights[t]) for t in own if t in places]
            if spans:
                found.append(_shard_scores(spans, code, part, most, len(ids.dictionary), k))
                queries += [query_id] * len(found[-1][0])
        if queries:
            yield pa.record_batch([pa.array(queries, query_type), ids.dictionary.take(pa.array(np.concatenate([c for c, _ in found]))), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "chunk_id", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for b in batches:
            shard = b.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(b) else []
            for s, e in zip(cuts, [*cuts[1:], len(b)]):
                if now is not None and shard[s] != now:
                    yield from best(*held)
                    held = ([], [], [])
                now = shard[s]
                for column, values in zip(held, (b.column("term").slice(s, e - s), b.column("chunk_id").slice(s, e - s), b.column("part").slice(s, e - s).to_numpy())):
                    column.append(values)
        if now is not None:
            yield from best(*held)

    return run


class SparseIndex:
    """Postings of chunks (chunk_id, text, title if there is one) in a folder.

    A row is (term, chunk_id, tf, text_tf, length); tf counts title and text,
    text_tf the text alone. A chunk also has one row with the empty term, which
    holds its length and a digest of its text, so numbers of chunks and mean
    lengths come from these rows and no search reads a text. Each change is a
    segment (see SegmentLog): added chunks replace those of the same id,
    removed ones are tombstones, and statistics are sums over the live rows of
    all segments, so a search gives what a rebuilt index would. The tokenizer,
    by its name, is part of what is stored: another one can't open the index.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer: str = "syllable"):
        self.spark, self.log, self.tokenizer, self.terms = spark, SegmentLog(spark, path), tokenizer, engine("tokenizer", tokenizer)
        for commit in self.log.commits():
            if commit["made_by"] not in (None, tokenizer):
                raise ValueError(f"the index was made with {commit['made_by']}, its queries can't be cut by {tokenizer}")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term) of queries, each term once a query."""
        return queries.select("query_id", F.explode(F.array_distinct(self.terms(F.col("text")))).alias("term"))

    def _made(self, chunks: DataFrame) -> DataFrame:
        titled = "title" in chunks.columns
        cut = in_small_batches(spread(chunks)).select("chunk_id", digest_of(chunks).alias("digest"), self.terms(F.col("text")).alias("terms"), (self.terms(F.col("title")) if titled else F.lit(None).cast("array<string>")).alias("title_terms"))
        kind = chunks.schema["chunk_id"].dataType.simpleString()
        arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
        rows = cut.mapInArrow(_postings(arrow), f"term string, chunk_id {kind}, tf int, text_tf int, length int, digest long")
        return rows.repartition(F.col("term"), F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS))).sortWithinPartitions("term", "chunk_id")

    def add(self, chunks: DataFrame, work: str | None = None, also_removed: DataFrame | None = None) -> int | None:
        """Index chunks; those of the same id are replaced. Ids are distinct within one call."""
        gone = chunks.select(F.col("chunk_id").alias("key"))
        if also_removed is not None:
            gone = gone.unionByName(also_removed.select(F.col("chunk_id").alias("key")))
        return self.log.append({"postings": self._made(chunks)}, gone if self.log.commits() else None, work, made_by=self.tokenizer)

    def remove(self, ids: DataFrame, work: str | None = None) -> int | None:
        """Take chunks (chunk_id) out; unknown ids don't matter."""
        return self.log.append({}, ids.select(F.col("chunk_id").alias("key")), work)

    def chunks(self) -> DataFrame | None:
        """(chunk_id, length, digest) of the live chunks."""
        return self.log.live("postings", "chunk_id", lambda rows: rows.where("term = ''").select("chunk_id", "length", "digest", "segment"))

    def heal(self, chunks: DataFrame, work: str | None = None) -> dict[str, int]:
        """Bring the index in step with the table of chunks: how many were missing, had changed, or were gone from it.

        Only what differs is cut into terms. An index without segments is built.
        """
        have = self.chunks()
        if have is None:
            self.add(chunks, work)
            return {"missing": self.chunks().count(), "changed": 0, "gone": 0}
        want = chunks.select("chunk_id", digest_of(chunks).alias("now"))
        both = want.join(have.select("chunk_id", "digest"), "chunk_id", "full").select("chunk_id", F.when(F.col("digest").isNull(), "missing").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("digest"), "changed").alias("state"))
        differing = stored(both.where("state is not null"), "differing")
        counts = {"missing": 0, "changed": 0, "gone": 0} | {r["state"]: r["count"] for r in differing.groupBy("state").count().collect()}
        if any(counts.values()):
            self.add(chunks.join(differing.where("state <> 'gone'").select("chunk_id"), "chunk_id", "left_semi"), work, differing.where("state = 'gone'"))
        elif work is not None:
            self.log.append({}, differing.select(F.col("chunk_id").alias("key")), work)
        drop_stored(differing)
        return counts

    def compact(self) -> int | None:
        """One segment of all live postings in place of many."""
        live = self.log.live("postings", "chunk_id")
        if live is None:
            return None
        return self.log.compact({"postings": live.repartition(F.col("term"), F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS))).sortWithinPartitions("term", "chunk_id")}, made_by=self.tokenizer)

    def postings(self, terms: DataFrame) -> DataFrame:
        """Live (term, chunk_id, tf, text_tf, length) of some terms. A few terms are sought in the files, which are sorted by term."""
        def of(rows: DataFrame) -> DataFrame:
            return rows.where(F.col("term").isin(few)) if len(few) <= 10 else rows.where("term <> ''").join(terms.select("term").distinct(), "term", "left_semi")

        few = [r["term"] for r in terms.select("term").distinct().limit(11).collect()]
        return self.log.live("postings", "chunk_id", of).drop("digest")

    def search(self, queries: DataFrame, k: int = CANDIDATES, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
        """The k best chunks of each query (query_id, text) by BM25: query_id, chunk_id, score (six decimals), rank. Ties go to the smaller chunk_id.

        Only postings of the queries' terms are read, and dealt by chunk into
        shards, so that a shard has all that its chunks' scores need; hits of
        queries and chunks are never rows. A task scores its shard for all
        queries of a block: rare terms first, which give a floor for the k
        best; with the largest parts of its common terms as bounds, the chunks
        that can still reach the floor are completed, and the others go. Each
        shard gives its k best a query. Queries beyond `block_terms` terms are
        asked block after block.
        """
        live = self.chunks()
        docs, total = live.where("length > 0").agg(F.count("*"), F.sum("length")).first() if live is not None else (0, 0)
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit((total or 0) / (docs or 1))))
        return self._best(queries, k, docs, part, lambda df: np.log(1 + (docs - df + 0.5) / (df + 0.5)), block_terms, shard_postings)

    def overlaps(self, queries: DataFrame, k: int = CANDIDATES, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
        """The k chunks with most distinct terms of each query: query_id, chunk_id, score, rank."""
        live = self.chunks()
        return self._best(queries, k, live.count() if live is not None else 0, F.lit(1.0), np.ones_like, block_terms, shard_postings)

    def _best(self, queries: DataFrame, k: int, docs: int, part: Column, weight: Callable[[np.ndarray], np.ndarray], block_terms: int, shard_postings: int) -> DataFrame:
        """The k best chunks by the sum of weight(document frequency) * part over a query's terms."""
        q = queries.schema["query_id"].dataType.simpleString()
        if not docs:
            return self.spark.createDataFrame([], f"query_id {q}, chunk_id string, score double, rank int")
        terms = stored(self._asked(queries), "asked")
        blocks, out = max(1, -(-terms.count() // block_terms)), []
        for block in range(blocks):
            mine = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            asked = mine.toArrow()
            found = self.postings(mine)
            df = found.groupBy("term").agg(F.count("*").alias("df")).toArrow()
            n = df.column("df").to_numpy().astype(float)
            weights = dict(zip(df.column("term").to_pylist(), weight(n).tolist()))
            by_query: dict = {}
            for query_id, term in zip(asked.column("query_id").to_pylist(), asked.column("term").to_pylist()):
                if term in weights:
                    by_query.setdefault(query_id, []).append(term)
            shards = max(1, int(-(-n.sum() // shard_postings)))
            shard = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard")
            dealt = found.select(shard, "term", "chunk_id", part.alias("part")).repartition(shards, "shard").sortWithinPartitions("shard", "term")
            c = found.schema["chunk_id"].dataType.simpleString()
            out.append(dealt.mapInArrow(_scored(by_query, weights, k, asked.schema.field("query_id").type), f"query_id {q}, chunk_id {c}, raw double"))
        return ranked(reduce(DataFrame.unionByName, out).select("query_id", "chunk_id", F.round("raw", 6).alias("score")), "score", k)

    def reranked(self, candidates: DataFrame, queries: DataFrame, k: int = TOP, min_score: float = 0.0) -> DataFrame:
        """The k candidates (query_id, chunk_id, rrf) whose text has the largest share of the query's terms; ties keep the fused order.

        Candidates that the index lacks are left out.
        """
        terms = self._asked(queries)
        n = terms.groupBy("query_id").agg(F.count("*").alias("n"))
        there = self.postings(terms).where("text_tf > 0").select("term", "chunk_id")
        shared = candidates.select("query_id", "chunk_id").join(terms, "query_id").join(there, ["term", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("shared"))
        rows = candidates.join(self.chunks().select("chunk_id"), "chunk_id", "left_semi").join(shared, ["query_id", "chunk_id"], "left").join(n, "query_id", "left")
        share = F.coalesce(F.col("shared") / F.col("n"), F.lit(0.0))
        kept = rows.select("query_id", "chunk_id", "rrf", F.round(share, 6).alias("score")).where(F.col("score") >= min_score)
        return ranked(kept, "score", k, F.desc("rrf"))
