"""The library's queries over the test tables, and the SQL that checks them.

No test table holds conversations of a contact centre, so each operator runs on
the table that is nearest to its input: events as bus events, conversations as
turns, documents and benchmark as knowledge base and queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import analytics as A
from parlance.operators import governance as G
from parlance.operators import retrieval as R
from parlance.operators import stored_search as I
from parlance.plans.indexes import sparse_index, text_vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").withColumn("tenant_id", F.col("event_type"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = {"utterances": F.count("*"), "masked": F.count_if(F.col("value") > 50), "value_sum": A.exact_sum(F.col("value")), "value_n": F.count("value")}
    return A.daily_counters(_events(spark, sf_dir), counters)


_DAILY = """SELECT event_type AS tenant_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS utterances, count(*) FILTER (value > 50) AS masked,
    CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS value_sum, count(value) AS value_n FROM events GROUP BY 1, 2"""


@query(_DAILY)
def daily_stats(spark, sf_dir):
    return _daily(spark, sf_dir)


@query(f"""WITH d AS ({_DAILY}), c AS (SELECT tenant_id, strftime(g, '%Y-%m-%d') AS day FROM (SELECT DISTINCT tenant_id FROM d),
    generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) AS s(g))
    SELECT tenant_id, day, coalesce(utterances, 0) AS utterances, coalesce(masked, 0) AS masked, coalesce(value_sum, 0) AS value_sum, coalesce(value_n, 0) AS value_n
    FROM c LEFT JOIN d USING (tenant_id, day)""")
def daily_calendar_zero_fill(spark, sf_dir):
    return A.zero_filled(_daily(spark, sf_dir), "2023-12-25", "2024-02-05")


@query(f"""SELECT tenant_id, count(*) AS days, CAST(sum(utterances) AS BIGINT) AS utterances, CAST(sum(masked) AS BIGINT) AS masked, CAST(sum(value_n) AS BIGINT) AS value_n,
    round(sum(masked) / sum(utterances), 6) AS masked_rate, round(sum(value_sum) / sum(value_n), 6) AS mean_value FROM ({_DAILY}) GROUP BY 1""")
def period_overview_ratio(spark, sf_dir):
    made = A.overview(_daily(spark, sf_dir), {"masked_rate": ("masked", "utterances"), "mean_value": ("value_sum", "value_n")})
    return made.withColumn("masked_rate", F.round("masked_rate", 6)).withColumn("mean_value", F.round("mean_value", 6)).drop("value_sum")


@query("""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, key) AS INTEGER) AS rank FROM
    (SELECT event_type AS tenant_id, CAST(user_id AS VARCHAR) AS key, count(*) AS n, arg_max(props, (ts, props)) FILTER (props <> '') AS label FROM events GROUP BY 1, 2)) WHERE rank <= 20""")
def event_rankings_topk(spark, sf_dir):
    rows = _events(spark, sf_dir).select("tenant_id", F.col("user_id").cast("string").alias("key"), F.col("props").alias("label"), "ts")
    return A.rankings(rows, 20)


@query("""SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm, count(*) AS n, arg_min(text, (turn, conv_id, text)) AS text, max(turn) AS last_seen, arg_max(conv_id, (turn, conv_id, text)) AS session_id
    FROM conversations GROUP BY 1 HAVING norm <> '' ORDER BY n DESC, norm LIMIT 50""")
def fallback_dedup_topk(spark, sf_dir):
    return A.fallbacks(_turns(spark, sf_dir).withColumn("ts", F.col("seq")), 50)


def _flat(calls: DataFrame) -> DataFrame:
    return calls.select("session_id", "utterances", "customer_turns", "first_seq", "last_seq", "truncated", F.sha2(F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n"), 256).alias("digest"))


_CALLS = """SELECT conv_id AS session_id, count(*) AS utterances, count(*) FILTER (role IN ('user', 'customer')) AS customer_turns, min(turn) AS first_seq, max(turn) AS last_seq, count(*) > 500 AS truncated,
    sha256(array_to_string(list(concat_ws(':', role, text) ORDER BY turn, role, text)[1:500], chr(10))) AS digest"""


@query(f"{_CALLS} FROM conversations GROUP BY 1")
def call_records(spark, sf_dir):
    return _flat(A.call_records(_turns(spark, sf_dir)))


@query(f"{_CALLS} FROM conversations GROUP BY 1 HAVING bool_or(contains(lower(text), 'the')) OR contains(CAST(conv_id AS VARCHAR), 'the')")
def call_search(spark, sf_dir):
    return _flat(A.search_calls(A.call_records(_turns(spark, sf_dir)), "The"))


@query("""SELECT conv_id AS session_id, turn AS seq, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_customer FROM conversations""")
def asof_last_user_turn(spark, sf_dir):
    return A.with_last_customer_turn(_turns(spark, sf_dir)).select("session_id", "seq", "role", "last_customer")


@query("""SELECT conv_id AS session_id, turn AS seq, array_to_string(list(role || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), chr(10)) AS context FROM conversations""")
def context_last3(spark, sf_dir):
    rows = A.with_context(_turns(spark, sf_dir), 3)
    return rows.select("session_id", "seq", F.array_join(F.transform("context", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("context"))


@query("""SELECT conv_id AS session_id, role AS speaker, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS ms, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY sum(length(text)) DESC, role) AS INTEGER) AS place FROM conversations GROUP BY 1, 2""")
def speaker_talk_time(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    return A.talk_time(rows.select("session_id", F.col("role").alias("speaker"), F.length("text").cast("long").alias("duration_ms")))


@query("""SELECT strftime(ts, '%Y-%m') AS month, event_type AS tenant_id, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS prompt, CAST(sum(event_id) AS BIGINT) AS completion FROM events GROUP BY GROUPING SETS ((1, 2), (1))""")
def usage_by_month_rollup(spark, sf_dir):
    return A.usage(_events(spark, sf_dir).select("tenant_id", "ts", F.col("user_id").alias("prompt"), F.col("event_id").alias("completion")))


@query("""SELECT source AS tenant_id, count(*) AS total, count(*) FILTER (quality = 1) AS accepted, round(count(*) FILTER (quality = 1) / count(*), 4) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def feedback_stats(spark, sf_dir):
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return A.feedback_stats(rows.select(F.col("source").alias("tenant_id"), (F.col("quality") == 1).alias("accepted")))


@query("""WITH RECURSIVE s AS (SELECT event_type AS tenant_id, event_id AS session_id, ts, least(ts + INTERVAL 12 HOUR, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts + INTERVAL 12 HOUR END) AS ends,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT DISTINCT tenant_id, 0::BIGINT AS n, NULL::BIGINT AS session_id, NULL::TIMESTAMP AS opened_at, 0::BIGINT AS active, false AS over, []::TIMESTAMP[] AS ends FROM s
        UNION ALL SELECT tenant_id, n, session_id, ts, len(a)::BIGINT, len(a) >= 4, CASE WHEN len(a) >= 4 THEN a ELSE list_append(a, e) END
        FROM (SELECT s.tenant_id, s.n, s.session_id, s.ts, s.ends AS e, list_filter(r.ends, lambda x: x > s.ts) AS a FROM r JOIN s ON s.tenant_id = r.tenant_id AND s.n = r.n + 1))
    SELECT tenant_id, session_id, opened_at, active, over FROM r WHERE n > 0""")
def active_sessions_replay(spark, sf_dir):
    """Each event opens a session; a third of them close after an hour, the others expire."""
    closed = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 1 hour"))
    rows = _events(spark, sf_dir).select("tenant_id", F.col("event_id").alias("session_id"), F.col("ts").alias("opened"), closed.alias("closed"))
    return A.admission_replay(rows, 4)


@query("""SELECT event_type AS tenant_id, count(*) FILTER (ts <= TIMESTAMP '2024-01-10' AND ts > TIMESTAMP '2024-01-09 12:00:00' AND (event_id % 3 <> 0 OR ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-10')) AS active FROM events GROUP BY 1""")
def active_sessions_now(spark, sf_dir):
    closed = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 1 hour"))
    rows = _events(spark, sf_dir).select("tenant_id", F.col("event_id").alias("session_id"), F.col("ts").alias("opened"), closed.alias("closed"))
    return A.active_sessions(rows, F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")))


@query("""WITH o AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM o)
    SELECT user_id, session_no, count(*) AS events, min(ts) AS opened, max(ts) AS closed FROM n GROUP BY 1, 2""")
def session_windows(spark, sf_dir):
    return A.sessions_by_gap(_read(spark, sf_dir, "events"), 12 * 3600)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_wins_upsert(spark, sf_dir):
    rows = A.latest_wins(_read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


_TERMS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+'), lambda w: len(w) >= 2)"


@query(f"SELECT doc_id, CAST(len({_TERMS}) AS INTEGER) AS n_terms, md5(array_to_string({_TERMS}, ' ')) AS digest FROM documents")
def tokenize_terms(spark, sf_dir):
    terms = T.tokens(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(terms).alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("digest"))


_BM25 = f"""b AS (SELECT item_id AS query_id, text FROM benchmark),
    p AS (SELECT doc_id AS chunk_id, unnest({_TERMS}) AS term FROM documents),
    l AS (SELECT chunk_id, count(*) AS n FROM p GROUP BY 1), t AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
    f AS (SELECT chunk_id, term, count(*) AS tf FROM p GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
    q AS (SELECT DISTINCT query_id, unnest({_TERMS}) AS term FROM b),
    s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l.n / mean))), 6) AS score
          FROM q JOIN df USING (term) JOIN f USING (term) JOIN l USING (chunk_id), t GROUP BY 1, 2),
    sparse AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10)"""


def _chunks(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _asked(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark, sf_dir):
    """The stored index of all documents, which the searches share."""
    return sparse_index(spark, sf_dir, _chunks(spark, sf_dir))


def _sparse(spark, sf_dir):
    return _index(spark, sf_dir).search(_asked(spark, sf_dir))


@query(f"WITH {_BM25} SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM sparse")
def bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
    SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(spark, sf_dir):
    """The stated query set is every vector whose id is divisible by 20; all vectors are searched."""
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return R.dense(rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), rows)


_TF = """tfs AS (SELECT query_id, chunk_id, CAST(count(*) AS DOUBLE) AS score FROM q JOIN f USING (term) GROUP BY 1, 2),
    lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM tfs) WHERE rank <= 10)"""
_RRF = """fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf
    FROM lexical a FULL JOIN sparse b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)"""


def _fused(spark, sf_dir, index):
    asked = _asked(spark, sf_dir)
    return R.fused(index.overlaps(asked), index.search(asked))


@query(f"WITH {_BM25}, {_TF}, {_RRF} SELECT query_id, chunk_id, rrf FROM fused")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir, _index(spark, sf_dir)).select("query_id", "chunk_id", "rrf")


@query(f"""WITH {_BM25}, {_TF}, {_RRF}, dt AS (SELECT doc_id AS chunk_id, list_distinct({_TERMS}) AS d FROM documents), qt AS (SELECT query_id, list_distinct({_TERMS}) AS q FROM b),
    rr AS (SELECT query_id, chunk_id, rrf, round(len(list_intersect(q, d)) / len(q), 6) AS score FROM fused JOIN dt USING (chunk_id) JOIN qt USING (query_id))
    SELECT query_id, chunk_id, rrf, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf DESC, chunk_id) AS INTEGER) AS rank FROM rr) WHERE rank <= 3""")
def lexical_rerank_search(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.reranked(_fused(spark, sf_dir, index), _asked(spark, sf_dir))


@query(f"""WITH {_BM25}, e AS (SELECT query_id, doc_id AS chunk_id FROM b JOIN documents d ON contains(d.text, b.text)),
    w AS (SELECT query_id, count(*) AS n FROM e GROUP BY 1), h AS (SELECT query_id, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM sparse JOIN e USING (query_id, chunk_id) WHERE rank <= 3 GROUP BY 1)
    SELECT count(*) AS cases, count(first) AS hits, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 4) AS recall, round(avg(coalesce(1 / first, 0)), 4) AS mrr,
    round(avg(coalesce(dcg / list_sum(list_transform(range(1, least(n, 3) + 1), lambda i: 1 / log2(i + 1))), 0)), 4) AS ndcg FROM w LEFT JOIN h USING (query_id)""")
def retrieval_metrics(spark, sf_dir):
    """A query's expected documents are those that hold its text."""
    asked, chunks = _asked(spark, sf_dir), _chunks(spark, sf_dir)
    return R.retrieval_metrics(_index(spark, sf_dir).search(asked), R.containing(asked, chunks))


@query()
def hashing_embed(spark, sf_dir):
    return R.hashed_vectors(_chunks(spark, sf_dir).select("chunk_id", T.tokens(F.col("text")).alias("terms")))


_LEXICON = [("price", ("fee", "cost")), ("date", ("day",)), ("a", ("the",))]


@query()
def hybrid_search(spark, sf_dir):
    """Every benchmark text as a query over all documents: vectors and BM25, fused and reranked."""
    return I.search(_asked(spark, sf_dir), _index(spark, sf_dir), text_vectors(spark, sf_dir, _chunks(spark, sf_dir)))


@query("""SELECT item_id AS query_id, text || CASE WHEN len(l) = 0 THEN '' ELSE ' ' || array_to_string(l, ' ') END AS expanded FROM
    (SELECT *, list_concat(CASE WHEN contains(text, 'price') THEN list_filter(['fee', 'cost'], lambda x: NOT contains(text, x)) ELSE [] END,
        CASE WHEN contains(text, 'date') AND NOT contains(text, 'day') THEN ['day'] ELSE [] END, CASE WHEN contains(text, 'a') AND NOT contains(text, 'the') THEN ['the'] ELSE [] END) AS l FROM benchmark)""")
def query_expansion(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", R.expanded(F.col("text"), _LEXICON).alias("expanded"))


@query()
def chunk_documents(spark, sf_dir):
    return R.chunked(_read(spark, sf_dir, "documents"))


@query("""WITH m AS (SELECT doc_id, regexp_replace(text, '(^|[^0-9])[0-9]{4}[-\\s]?[0-9]{4}[-\\s]?[0-9]{4}[-\\s]?[0-9]{4}([^0-9]|$)', '\\1[CARD_MASKED]\\2', 'g') AS a FROM documents),
    e AS (SELECT doc_id, a, regexp_replace(a, '(^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}([^A-Za-z0-9.-]|$)', '\\1[EMAIL_MASKED]\\2', 'g') AS b FROM m)
    SELECT doc_id, contains(b, '[CARD_MASKED]') AS card, contains(b, '[EMAIL_MASKED]') AS email FROM e""")
def pii_mask(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.masked(F.col("text")).alias("masked")).select("doc_id", F.col("masked").contains("[CARD_MASKED]").alias("card"), F.col("masked").contains("[EMAIL_MASKED]").alias("email"))


_RULES = [("r1", "block", "refund", "(?i)refund|money back"), ("r2", "warn", "question", "\\?$"), ("r3", "note", "number", "[0-9]+")]


@query("""SELECT conv_id AS session_id, turn AS seq, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)refund|money back') THEN 'r1' END, CASE WHEN regexp_matches(text, '\\?$') THEN 'r2' END, CASE WHEN regexp_matches(text, '[0-9]+') THEN 'r3' END) AS rules FROM conversations""")
def rule_match(spark, sf_dir):
    rules = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("rule_id", "severity", "message", "pattern"), r))) for r in _RULES))
    return _turns(spark, sf_dir).select("session_id", "seq", F.array_join(T.matched_rules(F.col("text"), rules)["rule_id"], ",").alias("rules"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 4 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def json_tolerant_parse(spark, sf_dir):
    """Objects in fences, in prose, after blanks, broken, and as they are."""
    p = F.col("props")
    forms = F.array(F.concat(F.lit("```json\n"), p, F.lit("\n```")), F.concat(F.lit("Sure: "), p, F.lit(" done.")), F.concat(F.lit(" \n"), p), F.concat(F.lit("```"), p, F.lit("```")), F.substring(p, 1, 3), p)
    rows = _read(spark, sf_dir, "events").select("event_id", F.element_at(forms, (F.col("event_id") % 6 + 1).cast("int")).alias("raw"))
    return rows.select("event_id", T.json_object(F.col("raw"), "k long")["k"].cast("string").alias("k"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 11 / 10.0 AS n, doc_id % 7 / -5.0 AS p FROM documents),
    f AS (SELECT doc_id, 'as it is' AS form, t, n, p FROM d UNION ALL SELECT doc_id, 'one word', repeat(coalesce(regexp_extract(t, '[A-Za-z]+'), '') || ' ', 4), n, p FROM d UNION ALL SELECT doc_id, 'boilerplate', '{T.BOILERPLATE[0]}', n, p FROM d
        UNION ALL SELECT doc_id, 'marks', '...', n, p FROM d UNION ALL SELECT doc_id, 'blank', chr(10) || ' ', n, p FROM d),
    b AS (SELECT *, lower(regexp_replace(t, '[^\\pL\\pN\\pM]', '', 'g')) AS bare, regexp_extract_all(lower(t), '[\\pL\\pN\\pM]+') AS w FROM f)
    SELECT doc_id, form, CASE WHEN regexp_replace(t, '[\\s\\pZ]', '', 'g') = '' THEN 'empty' WHEN n > 0.6 THEN 'no speech' WHEN p < -1.0 THEN 'low probability' WHEN len(w) >= 4 AND len(list_distinct(w)) = 1 THEN 'repeated word'
        WHEN bare IN ({", ".join(f"'{x}'" for x in T.BOILERPLATE)}) AND (n > 0.2 OR p < -0.5) THEN 'boilerplate' END AS reason FROM b""")
def hallucination_judge_all(spark, sf_dir):
    """Every document, as it is, as its first word four times, as boilerplate, as marks and as blanks, so that all verdicts are reached."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 11 / 10.0).alias("n"), (F.col("doc_id") % 7 / -5.0).alias("p"))
    word = F.repeat(F.concat(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit(" ")), F.lit(4))
    forms = F.array(*(F.struct(F.lit(form).alias("form"), text.alias("text")) for form, text in (("as it is", F.col("text")), ("one word", word), ("boilerplate", F.lit(T.BOILERPLATE[0])), ("marks", F.lit("...")), ("blank", F.lit("\n ")))))
    rows = rows.select("doc_id", "n", "p", F.explode(forms).alias("f"))
    return rows.select("doc_id", "f.form", T.hallucination_verdict(F.col("f.text"), F.col("n"), F.col("p")).alias("reason"))


@query("""SELECT a.conv_id AS session_id, a.turn AS seq, CAST(levenshtein(lower(regexp_replace(a.text, '[^A-Za-z0-9]', '', 'g')), lower(regexp_replace(b.text, '[^A-Za-z0-9]', '', 'g'))) AS INTEGER) AS errors
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def wer_cer(spark, sf_dir):
    rows = A.with_context(_turns(spark, sf_dir), 2).where(F.size("context") == 2)
    bare = lambda t: F.regexp_replace(t, "[^A-Za-z0-9]", "")
    return rows.select("session_id", (F.col("seq") - 1).alias("seq"), T.character_error(bare(F.col("context")[0]["text"]), bare(F.col("context")[1]["text"])).alias("errors"))


@query()
def word_character_errors(spark, sf_dir):
    """Word and character errors between neighbouring turns, in letters of all scripts."""
    rows = A.with_context(_turns(spark, sf_dir), 2).where(F.size("context") == 2)
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # few bytes, much work: coalesced they would be one task
    a, b = (F.col("context")[i]["text"] for i in (0, 1))
    return rows.select("session_id", (F.col("seq") - 1).alias("seq"), T.word_error(a, b).alias("word_errors"), T.character_error(a, b).alias("character_errors"))


def _tampered(spark, sf_dir):
    """A chain for each type of event. Then some bodies and predecessors are altered, and some records removed."""
    rows, parts = G.numbered(_read(spark, sf_dir, "events").select("event_type", "event_id", "props"), "event_type", "event_id")
    rows = rows.select(F.col("event_type").alias("chain"), "seq_no", F.concat_ws(",", "event_id", "props").alias("body"), "part")
    event = F.split("body", ",")[0].cast("long")
    made = G.chained(rows, parts).withColumn("prev_hash", F.when(event % 89 == 0, F.lit(G.GENESIS)).otherwise(F.col("prev_hash"))).withColumn("body", F.when(event % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return made.where(event % 101 != 0)


_FAULTS = """n AS (SELECT event_type AS chain, event_id AS e, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq_no FROM events),
    k AS (SELECT n.chain, n.seq_no, n.e, p.e AS p FROM n LEFT JOIN n p ON p.chain = n.chain AND p.seq_no = n.seq_no - 1 WHERE n.e % 101 <> 0),
    f AS (SELECT chain, seq_no, CASE WHEN seq_no > 1 AND p % 101 = 0 THEN 'gap' WHEN seq_no > 1 AND e % 89 = 0 THEN 'predecessor' WHEN e % 97 = 0 THEN 'digest' END AS fault FROM k)"""


@query(f"WITH {_FAULTS} SELECT chain, seq_no, fault FROM f WHERE fault IS NOT NULL")
def hash_chain_verify(spark, sf_dir):
    return G.chain_faults(_tampered(spark, sf_dir))


@query(f"""WITH {_FAULTS} SELECT chain, count(*) AS total, count(fault) = 0 AS intact, min(seq_no) FILTER (fault IS NOT NULL) AS broken_at, arg_min(fault, seq_no) FILTER (fault IS NOT NULL) AS reason FROM f GROUP BY 1""")
def audit_chain_status(spark, sf_dir):
    return G.chain_status(_tampered(spark, sf_dir), heads=False)


@query("""SELECT event_id AS seq_no, event_type AS action, ts AS recorded_at FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY 1 DESC LIMIT 50""")
def audit_search(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("seq_no"), F.col("event_type").alias("action"), F.col("ts").alias("recorded_at"))
    least = rows.agg(F.min("action").alias("action"))
    moment = lambda day: F.to_timestamp_ntz(F.lit(f"2024-01-{day} 00:00:00"))
    return G.audit_query(rows.join(least, "action", "left_semi"), 50, moment("03"), moment("20"), action="")


@query("""WITH a AS (SELECT p_partkey AS id, p_size AS v1, p_brand AS h1 FROM part WHERE p_size > 5), b AS (SELECT p_partkey AS id, CASE WHEN p_size = 20 THEN 21 ELSE p_size END AS v2, CASE WHEN p_size = 30 THEN 'x' ELSE p_brand END AS h2 FROM part WHERE p_size < 45)
    SELECT id, change FROM (SELECT id, CASE WHEN v2 IS NULL THEN 'added' WHEN v1 IS NULL THEN 'removed' WHEN v1 <> v2 THEN 'version' WHEN h1 <> h2 THEN 'content' END AS change FROM a FULL JOIN b USING (id)) WHERE change IS NOT NULL""")
def config_diff(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("version"), F.col("p_brand").alias("hash"))
    old = rows.where("version < 45").select("id", F.when(F.col("version") == 20, 21).otherwise(F.col("version")).alias("version"), F.when(F.col("version") == 30, "x").otherwise(F.col("hash")).alias("hash"))
    return G.differences(rows.where("version > 5"), old)


@query("""WITH RECURSIVE e AS (SELECT r_name AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'supplier-' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey),
    r AS (SELECT r_name AS root, r_name AS node, 0 AS depth FROM region UNION ALL SELECT root, dst, depth + 1 FROM r JOIN e ON src = node) SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2""")
def dependency_closure(spark, sf_dir):
    nation, region, supplier = (_read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    more = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src"), F.concat(F.lit("supplier-"), "s_suppkey").alias("dst"))
    return G.closure(edges.unionByName(more), region.select(F.col("r_name").alias("node")))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation), w AS (SELECT src AS root, dst AS node, 1 AS steps FROM e UNION ALL SELECT root, dst, steps + 1 FROM w JOIN e ON src = node WHERE steps < 26)
    SELECT CAST(root AS BIGINT) AS node, CAST(min(steps) FILTER (node = root) AS INTEGER) AS steps, CAST(min(node) AS BIGINT) AS cycle FROM w GROUP BY root HAVING count(*) FILTER (node = root) > 0""")
def cycle_detect(spark, sf_dir):
    key = F.col("n_nationkey").cast("long")
    return G.cycles(_read(spark, sf_dir, "nation").select(key.alias("src"), ((key * 3 + 1) % 25).alias("dst")))


_GATE = [("recall_at_k", -1.0), ("accuracy", 0.0004), ("mrr", 1.0), ("total", 2.0), ("misroutes", -1.0), ("known_limitations", -1.0), ("mean_latency_ms", -60.0), ("p95_latency_ms", 1.0), ("other", 9.0)]


@query(f"""WITH a AS (SELECT event_type AS suite, count(*) AS v FROM events GROUP BY 1), m AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {d})" for n, d in _GATE)}) t(metric, d)),
    c AS (SELECT suite, metric, v AS now FROM a, m WHERE suite <> (SELECT min(suite) FROM a)), b AS (SELECT suite, metric, CASE WHEN metric LIKE '%latency%' THEN greatest(v + d, v / 3) ELSE v + d END AS was FROM a, m WHERE suite <> (SELECT max(suite) FROM a))
    SELECT * FROM (SELECT suite, metric, CASE WHEN metric IN ('recall_at_k', 'mrr', 'accuracy') AND now < was - 0.0005 THEN 'block: lower quality' WHEN metric = 'total' AND now < was THEN 'block: fewer cases' WHEN metric = 'misroutes' AND now > was THEN 'block: more misroutes'
        WHEN metric = 'known_limitations' AND now > was THEN 'warn: more limitations' WHEN metric LIKE '%latency%' AND was > 0 AND now > greatest(2 * was, 5) THEN 'warn: slower' END AS finding FROM c JOIN b USING (suite, metric)) WHERE finding IS NOT NULL
    UNION ALL SELECT DISTINCT suite, '__suite__', 'block: removed' FROM b WHERE suite NOT IN (SELECT suite FROM c) UNION ALL SELECT DISTINCT suite, '__suite__', 'note: added' FROM c WHERE suite NOT IN (SELECT suite FROM b)""")
def baseline_gate(spark, sf_dir):
    """One suite is gone, one is new, and of the others each metric moves by its own step."""
    counts = _events(spark, sf_dir).groupBy(F.col("tenant_id").alias("suite")).agg(F.count("*").cast("double").alias("v"))
    rows = counts.select("suite", "v", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.lit(d).alias("d")) for n, d in _GATE))).alias("m")).select("suite", "m.metric", "v", "m.d")
    now = rows.join(counts.agg(F.min("suite").alias("suite")), "suite", "left_anti").select("suite", "metric", F.col("v").alias("value"))
    was = F.when(F.col("metric").contains("latency"), F.greatest(F.col("v") + F.col("d"), F.col("v") / 3)).otherwise(F.col("v") + F.col("d"))
    return G.gate(now, rows.join(counts.agg(F.max("suite").alias("suite")), "suite", "left_anti").select("suite", "metric", was.alias("value")))


_PARTS = """d AS (SELECT doc_id, doc_id % 8 AS v, coalesce(text, '') AS t FROM documents),
    a AS (SELECT doc_id, v, t, CASE v WHEN 0 THEN ' ' WHEN 1 THEN '답변불가' WHEN 2 THEN substr(t, 1, 100) WHEN 3 THEN substr(t, 1, 100) || ' [3]' WHEN 4 THEN t || ' [1]' WHEN 5 THEN substr(t, 1, 100) || ' 987654321 [1]' WHEN 6 THEN substr(t, 1, 100) || ' 반드시 [1]' ELSE substr(t, 1, 130) || ' [2]' END AS raw FROM d),
    s AS (SELECT *, regexp_replace(raw, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS x FROM a), c AS (SELECT *, list_transform(regexp_extract_all(x, '\\[([0-9]+)\\]', 1), lambda n: TRY_CAST(n AS INTEGER)) AS cited, regexp_replace(x, '\\[[0-9]+\\]', ' ', 'g') AS body FROM s),
    u AS (SELECT *, CASE WHEN list_contains(cited, 1) THEN t ELSE '' END || ' ' || CASE WHEN list_contains(cited, 2) THEN 'nothing here' ELSE '' END AS used FROM c),
    n AS (SELECT *, list_filter(list_transform(regexp_extract_all(body, '[0-9]+(?:[.,][0-9]+)*'), lambda k: replace(k, ',', '')), lambda k: NOT list_contains(list_transform(regexp_extract_all(used, '[0-9]+(?:[.,][0-9]+)*'), lambda j: replace(j, ',', '')), k)) AS invented,
        list_distinct(list_filter(regexp_extract_all(lower(body), '[0-9a-z가-힣]+'), lambda w: len(w) >= 2)) AS q, list_distinct(list_filter(regexp_extract_all(lower(used), '[0-9a-z가-힣]+'), lambda w: len(w) >= 2)) AS e FROM u)"""


@query(f"""WITH {_PARTS} SELECT doc_id, CASE WHEN x = '' THEN 'empty' WHEN contains(x, '답변불가') THEN 'refusal' WHEN len(cited) = 0 THEN 'no citation' WHEN len(list_filter(cited, lambda k: k IS NULL OR k < 1 OR k > 2)) > 0 THEN 'unknown citation'
    WHEN length(regexp_replace(body, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')) > 140 THEN 'too long' WHEN len(invented) > 0 THEN 'invented number' WHEN contains(body, '반드시') THEN 'over-promise'
    WHEN len(q) + CASE WHEN v = 6 THEN 2 ELSE 0 END >= 20 AND len(list_intersect(q, e)) / len(q) < 0.35 THEN 'low coverage' END AS reason FROM n""")
def grounding_verify(spark, sf_dir):
    """Each document's text as an answer about itself, in eight forms by its id, so that all verdicts are reached."""
    t = F.coalesce("text", F.lit(""))
    head = F.substring(t, 1, 100)
    forms = [F.lit(" "), F.lit(T.REFUSAL), head, F.concat(head, F.lit(" [3]")), F.concat(t, F.lit(" [1]")), F.concat(head, F.lit(" 987654321 [1]")), F.concat(head, F.lit(" 반드시 [1]")), F.concat(F.substring(t, 1, 130), F.lit(" [2]"))]
    answer = F.element_at(F.array(*forms), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"), F.array(t, F.lit("nothing here")).alias("evidence"))
    return rows.select("doc_id", T.grounding_verdict(F.col("answer"), F.col("evidence")).alias("reason"))


@query("""SELECT doc_id, CASE WHEN d AND NOT l THEN 'extra' WHEN l AND NOT d THEN 'missed' ELSE 'both' END AS side FROM (SELECT doc_id, bool_or(d) AS d, bool_or(l) AS l FROM (SELECT doc_id, true AS d, false AS l FROM documents UNION ALL SELECT doc_id, false, true FROM labels) GROUP BY 1)""")
def setops_expected_found(spark, sf_dir):
    found, wanted = _read(spark, sf_dir, "documents").select("doc_id").distinct(), _read(spark, sf_dir, "labels").select("doc_id").distinct()
    side = lambda rows, name: rows.withColumn("side", F.lit(name))
    return side(found.exceptAll(wanted), "extra").unionByName(side(wanted.exceptAll(found), "missed")).unionByName(side(found.intersect(wanted), "both"))
