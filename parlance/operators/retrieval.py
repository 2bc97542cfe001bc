"""Chunks, inverted-index and vector search, rank fusion and reranking over tables of queries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.storage import stored

# --- fixed values: results depend on them ---------------------------------------
K1, B, RRF, CANDIDATES, TOP = 1.5, 0.75, 60, 10, 3
DIMENSIONS, MAX_EXPANSIONS = 512, 6
CHUNK_CHARS, OVERLAP_CHARS, LEAST_CHARS = 700, 120, 40
#: Rows whose texts and terms are Python objects at one time.
AT_ONCE = 128
#: Rows with texts or terms that Spark sends to Python at one time; its default is 10,000.
ROWS = 512
#: What opens an article, and where a sentence ends.
ARTICLE_HEAD = r"^\s*(제\s*\d+\s*조|\d+\.\s|-\.\s|[가-힣]\.\s)"
SENTENCE_END = r"(?<=[.!?。])\s+"
# -------------------------------------------------------------------------------


def few_at_once(batches: Iterator[pa.RecordBatch], n: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches cut into such of at most n rows: Spark sends 10,000 whole texts at once, and their terms as Python objects take many times their bytes."""
    for b in batches:
        for at in range(0, len(b), n):
            yield b.slice(at, n)


def in_small_batches(rows: DataFrame, n: int = ROWS) -> DataFrame:
    """The rows, in a session that sends at most n of them to Python at once: whole texts and terms are held by Spark, Arrow and Python at the same time."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= n:
        conf.set(key, str(n))
    return rows


def indexed(chunks: DataFrame) -> DataFrame:
    """The index of chunks (chunk_id, text, title if there is one): a stored table, read by every search.

    Every text is cut into terms once. `terms` are those of the text, for
    vectors and reranking; `sparse` those of title and text, for BM25, whose
    number is `length`.
    """
    made = chunks.select("chunk_id", tokens(F.col("text")).alias("terms"), *([tokens(F.concat_ws("\n", "title", "text")).alias("sparse")] if "title" in chunks.columns else []))
    made = made if "title" in chunks.columns else made.withColumn("sparse", F.col("terms"))
    return stored(made.withColumn("length", F.size("sparse")), "index")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, text), each term once a query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def postings(index: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, term, tf, length) of an index, of some terms or of all.

    Other terms' rows go before anything is grouped.
    """
    rows = index.select("chunk_id", "length", F.explode("sparse").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("chunk_id", "term", "length").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, index: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k best chunks of each query (query_id, text): query_id, chunk_id, score (six decimals), rank.

    Statistics come from all chunks with a term; only postings of terms that a
    query has are grouped and joined. The one row of totals is broadcast by a
    cross join. Ties go to the smaller chunk_id.
    """
    totals = index.where("length > 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    terms = query_terms(queries)
    found = postings(index, terms)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hits = terms.join(df, "term").join(found, "term").crossJoin(F.broadcast(totals))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scored, "score", k)


def ranked(scored: DataFrame, score: str, k: int, *then: Column) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *then, "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(most_cells: int, most_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            width = max(1, len(b.column(1)[0]) if len(b) else 1)
            step = max(1, min(most_rows, most_cells // width))
            for at in range(0, len(b), step):
                part = b.slice(at, step)
                values = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array([block]), pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([values.tobytes()], pa.binary())], names=["block", "ids", "data"])
                block += 1

    return run


def _best(k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vectors = None
        for b in batches:
            for asks, ids, asked, data in zip(b.column("asks").to_pylist(), b.column("ids"), b.column("asked"), b.column("data").to_pylist()):
                values = np.frombuffer(data).reshape(len(asked if asks else ids), -1)
                if not asks:
                    own, vectors = ids.values, values
                    continue
                score = values @ vectors.T
                least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else -np.inf
                q, c = np.nonzero(score >= least - 2 * 10.0**-digits)  # what rounds to the k-th score may still win by its id
                yield pa.record_batch([asked.values.take(pa.array(q)), own.take(pa.array(c)), pa.array(score[q, c])], names=["query_id", "chunk_id", "raw"])

    return run


def dense(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, per_block: int = 256, cells: int = 2_000_000) -> DataFrame:
    """The k best chunks of each query by inner product (six decimals).

    queries has query_id and vector, vectors has chunk_id and vector, all of
    one length. Tasks pack their rows into blocks; the queries' blocks go to
    every block of vectors, which gives its k best a query by one product of
    matrices.
    """
    q, c = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    blocks = stored(vectors.select("chunk_id", "vector").mapInArrow(_packed(cells, 1 << 30), f"block long, ids array<{c}>, data binary"), "vectors")
    asked = stored(queries.select("query_id", "vector").mapInArrow(_packed(cells, per_block), f"block long, ids array<{q}>, data binary"), "queries")
    numbered = blocks.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("number"))  # one short row a block
    n = blocks.count()
    own = blocks.join(numbered, "block").select("number", F.lit(False).alias("asks"), "ids", F.lit(None).cast(f"array<{q}>").alias("asked"), "data")
    each = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("number"), F.lit(True).alias("asks"), F.lit(None).cast(f"array<{c}>").alias("ids"), F.col("ids").alias("asked"), "data") if n else own.limit(0)
    met = own.unionByName(each).repartition(max(1, n), "number").sortWithinPartitions("number", "asks")
    scored = met.mapInArrow(_best(k, 6), f"query_id {q}, chunk_id {c}, raw double").select("query_id", "chunk_id", F.round("raw", 6).alias("score"))
    return ranked(scored, "score", k)


def fused(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: query_id, chunk_id, both scores (0 where absent), rrf."""
    a = first.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("r1"))
    b = second.select("query_id", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("r2"))
    term = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return a.join(b, ["query_id", "chunk_id"], "full").select("query_id", "chunk_id", zero("dense_score"), zero("sparse_score"), F.round(term("r1") + term("r2"), 9).alias("rrf"))


def reranked(candidates: DataFrame, queries: DataFrame, index: DataFrame, k: int = TOP, min_score: float = 0.0) -> DataFrame:
    """The k candidates that have the largest share of the query's terms; ties keep the fused order.

    Candidates that the index lacks are left out.
    """
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    rows = candidates.join(q, "query_id").join(index.select("chunk_id", "terms"), "chunk_id")
    share = F.when(F.size("q") > 0, F.size(F.array_intersect("q", "terms")) / F.size("q")).otherwise(0.0)
    kept = rows.select("query_id", "chunk_id", "rrf", F.round(share, 6).alias("score")).where(F.col("score") >= min_score)
    return ranked(kept, "score", k, F.desc("rrf"))


def search(queries: DataFrame, index: DataFrame, k: int = TOP, candidates: int = CANDIDATES, min_score: float = 0.0, lexicon: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """Hybrid search: hashed vectors and BM25 to `candidates` each, fused, reranked, the k best kept.

    Queries are expanded first where a lexicon is given, and asked so of all parts.
    """
    if lexicon:
        queries = stored(queries.select("query_id", expanded(F.col("text"), lexicon).alias("text")), "expanded")
    vectors = hashed_vectors(index.select("chunk_id", "terms"))
    asked = hashed_vectors(queries.select("query_id", tokens(F.col("text")).alias("terms")))
    both = fused(dense(asked, vectors, candidates), bm25(queries, index, candidates))
    return reranked(both, queries, index, k, min_score)


def found_documents(results: DataFrame) -> DataFrame:
    """query_id and the distinct documents of its ranked chunks (query_id, rank, doc_id), in order of their first chunk."""
    first = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))


def expanded(query: Column, lexicon: list[tuple[str, tuple[str, ...]]], most: int = MAX_EXPANSIONS) -> Column:
    """The query followed by the terms of the triggers that it has, in the lexicon's order, at most `most`."""
    pairs = [(trigger, term) for trigger, terms in lexicon for term in terms]
    if not pairs:
        return query
    known = F.array(*(F.struct(F.lit(trigger).alias("trigger"), F.lit(term).alias("term")) for trigger, term in pairs))

    def add(added: Column, x: Column) -> Column:
        fits = F.contains(query, x["trigger"]) & ~F.contains(query, x["term"]) & ~F.array_contains(added, x["term"]) & (F.size(added) < most)
        return F.when(fits, F.concat(added, F.array(x["term"]))).otherwise(added)

    # one fold over the lexicon: a tree that names what was added so far at each step would double with every term
    added = F.aggregate(known, F.expr("cast(array() as array<string>)"), add)
    return F.concat_ws(" ", query, F.when(F.size(added) > 0, F.array_join(added, " ")))


def _place(word: str) -> int:
    """Twice the word's dimension, and one more where its sign is plus."""
    # fixed: bytes 0 to 3 give the place, the fifth's lowest bit the sign
    h = hashlib.blake2b(word.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "big") % DIMENSIONS * 2 + (h[4] & 1)


def hashed_vectors(rows: DataFrame) -> DataFrame:
    """An id and terms to the id and `vector`: 512 signed hash counts of the terms, as a unit vector.

    A plan node of its own, since the optimizer may move a scalar Python
    function into a lambda function, where it can't run.
    """
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_at_once(batches):
            terms = b.column("terms")
            words = terms.flatten().dictionary_encode()  # each word of a batch is hashed once
            code = np.array([_place(word) for word in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
            row = np.repeat(np.arange(len(b)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            n = np.bincount(row * 2 * DIMENSIONS + code, minlength=len(b) * 2 * DIMENSIONS).reshape(len(b), DIMENSIONS, 2)
            out = (n[:, :, 1] - n[:, :, 0]).astype(np.float64)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norm == 0, 1, norm)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, DIMENSIONS, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.record_batch([b.column(key), vectors], names=[key, "vector"])

    return in_small_batches(rows).select(key, "terms").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")


_HEAD, _SENTENCE = re.compile(ARTICLE_HEAD), re.compile(SENTENCE_END)


def _units(text: str, size: int) -> Iterator[str]:
    """Paragraphs; of long ones runs of sentences; of long sentences cuts."""
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if len(paragraph) <= size:
            yield paragraph
            continue
        run = ""
        for sentence in filter(None, map(str.strip, _SENTENCE.split(paragraph))):
            if len(run) + len(sentence) < size:
                run = f"{run} {sentence}" if run else sentence
                continue
            if run:
                yield run
            whole = (len(sentence) - 1) // size * size
            yield from (sentence[at : at + size] for at in range(0, whole, size))
            run = sentence[whole:]
        if run:
            yield run


def split_text(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, least: int = LEAST_CHARS) -> list[str]:
    """Paragraphs packed into pieces of at most `size` characters.

    An article's heading opens a piece. Other pieces start with the end of the
    one before, cut to the room that is left. Pieces under `least` join the
    one before at last, whatever its length.
    """
    pieces: list[str] = []
    for unit in _units(text, size):
        if not pieces or _HEAD.match(unit):
            pieces.append(unit)
        elif len(pieces[-1]) + len(unit) < size:
            pieces[-1] += f"\n{unit}"
        else:
            room = min(overlap, size - len(unit) - 1)
            tail = pieces[-1][-room:].strip() if room > 0 else ""
            pieces.append(f"{tail}\n{unit}" if tail else unit)
    out: list[str] = []
    for piece in pieces:
        if out and len(piece) < least:
            out[-1] += f"\n{piece}"
        else:
            out.append(piece)
    return out


def chunked(documents: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, least: int = LEAST_CHARS) -> DataFrame:
    """(chunk_id, doc_id, ordinal, text) of documents (doc_id, text); null texts have no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_at_once(batches):
            pieces = [split_text(t or "", size, overlap, least) for t in b.column("text").to_pylist()]
            rows = [(d, k, piece) for d, own in zip(b.column("doc_id").to_pylist(), pieces) for k, piece in enumerate(own)]
            ids, ordinals, texts = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([pa.array(ids, b.column("doc_id").type), pa.array(ordinals, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "ordinal", "text"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = in_small_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ordinal int, text string")
    return rows.select(F.concat_ws(":", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "ordinal", "text")


def ingested(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """State of each document after chunking: ready with its number of chunks, or failed without any."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.when(F.col("n") > 0, "ready").otherwise("failed").alias("state"), F.coalesce("n", F.lit(0)).alias("chunk_count"))


def upserted(table: DataFrame, fresh: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The table with the fresh rows, which replace those of the same key."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without_documents(table: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows whose document isn't among the removed ones (doc_id): for chunks, vectors and index alike."""
    return table.join(removed.select("doc_id").distinct(), "doc_id", "left_anti")


def fetched(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of requests (request_id, chunk_ids), in the order asked; ids that no chunk has are left out."""
    asked = ids.select("request_id", F.posexplode("chunk_ids").alias("place", "chunk_id"))
    return asked.join(chunks, "chunk_id").select("request_id", "place", *chunks.columns)


def containing(queries: DataFrame, chunks: DataFrame, block_chars: int = 8_000_000) -> DataFrame:
    """(query_id, chunk_id) of the chunks whose text holds the query's text.

    Queries go to the tasks in blocks of about so many characters; one
    automaton of a block's texts reads each chunk once, however many queries
    there are. A null text holds nothing and is held by nothing.
    """
    q, c = queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    known = queries.where("text is not null").groupBy("text").agg(F.collect_list("query_id").alias("ids"))
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = known.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(1, -(-total // block_chars)))))

    def held(words: list[tuple[str, list]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word, ids in words:
                if word:
                    automaton.add_word(word, ids)
            automaton.make_automaton()
            always = [i for word, ids in words if not word for i in ids]
            for b in few_at_once(batches):
                found = []
                for chunk_id, text in zip(b.column("chunk_id").to_pylist(), b.column("text").to_pylist()):
                    if text is not None:
                        there = {id(ids): ids for _, ids in automaton.iter(text)} if len(automaton) else {}
                        found += [(i, chunk_id) for i in [*always, *(i for ids in there.values() for i in ids)]]
                yield pa.record_batch([pa.array([i for i, _ in found], query_type), pa.array([k for _, k in found], b.column("chunk_id").type)], names=["query_id", "chunk_id"])

        return run

    out = None
    for block in range(max(1, -(-total // block_chars))):
        words = blocks.where(F.col("block") == block).select("text", "ids").toArrow()
        query_type = words.schema.field("ids").type.value_type
        part = chunks.select("chunk_id", "text").mapInArrow(held(list(zip(words.column("text").to_pylist(), words.column("ids").to_pylist()))), f"query_id {q}, chunk_id {c}")
        out = part if out is None else out.unionByName(part)
    return out


def retrieval_metrics(results: DataFrame, expected: DataFrame, k: int = TOP) -> DataFrame:
    """Recall, reciprocal rank and nDCG at k over all expected queries (four decimals).

    results has query_id, chunk_id, rank; expected has (query_id, chunk_id).
    """
    hits = results.where(F.col("rank") <= k).join(expected, ["query_id", "chunk_id"], "left_semi")
    gains = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    wanted = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1.0))
    rows = wanted.join(gains, "query_id", "left").select((F.col("first").isNotNull()).cast("int").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))
    return rows.agg(F.count("*").alias("cases"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg"))


def intent_scores(utterances: DataFrame, intents: DataFrame) -> DataFrame:
    """Per utterance the best intent's example similarity, or null when it abstains.

    utterances has utterance_id, node_id and text; intents has node_id, name
    and examples. The overlap coefficient counts (Jaccard where one side has a
    single term); the best must reach 0.20 and lead by 0.09.
    """
    rows = utterances.select("utterance_id", "node_id", F.array_distinct(tokens(F.col("text"))).alias("u")).join(intents, "node_id")

    def like(example: Column) -> Column:
        e = F.array_distinct(tokens(example))
        shared, least = F.size(F.array_intersect("u", e)), F.least(F.size("u"), F.size(e))
        return F.when(least == 0, 0.0).when(least < 2, shared / F.size(F.array_union("u", e))).otherwise(shared / least)

    scored = rows.select("utterance_id", "name", F.coalesce(F.array_max(F.transform("examples", like)), F.lit(0.0)).alias("s"))
    order = Window.partitionBy("utterance_id").orderBy(F.desc("s"), F.desc("name"))
    two = scored.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("s", 1, 0.0).over(order)).where("k = 1")
    return two.select("utterance_id", F.when((F.col("s") >= 0.20) & (F.round(F.col("s") - F.col("next"), 9) >= 0.09), F.col("name")).alias("intent"), "s")
