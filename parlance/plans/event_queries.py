"""Queries of the event, catalogue, evaluation, speech and dialogue operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import speech
from parlance.functions import text as T
from parlance.operators import catalog as C
from parlance.operators import dialogue as D
from parlance.operators import evaluation as E
from parlance.operators import lexicons as L
from parlance.operators import records as R
from parlance.operators import retrieval
from parlance.operators import studio as W
from parlance.operators.sparse_index import spread
from parlance.plans.queries import _read, _turns, query

_EVENTS = """e AS (SELECT *, event_type AS tenant_id, strftime(ts, '%Y-%m-%d') AS day, event_id % 4 <> 0 AS is_final, event_id % 5 AS v, event_id % 3 AS k FROM events)"""


def _bus(spark, sf_dir):
    """The events as bus events of every kind: the rest of their ids fills the fields that the table lacks."""
    e = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("tenant_id"), "ts", "value", "props", (e % 4 != 0).alias("is_final"), F.when(e % 5 == 0, " ").otherwise(F.col("props")).alias("clean_text"), (F.col("value") > 50).alias("pii_masked"),
        F.slice(F.array(F.lit("r1"), F.lit("r2")), F.lit(1), (e % 3).cast("int")).alias("matched_rules"), F.col("value").alias("confidence"), (e % 1000).alias("duration_ms"), (e % 7 == 0).alias("handed_off"),
        F.when(e % 3 == 0, "failed").otherwise("ready").alias("status"), (e % 11).alias("waited_ms"), (e % 13 * 10).alias("latency_ms"), (e % 17 == 0).alias("gave_up"), F.when(e % 2 == 0, "meeting").otherwise("aicc").alias("profile"),
    )


@query(f"""WITH {_EVENTS} SELECT tenant_id, day, count(*)::DOUBLE AS sessions, count(*) FILTER (event_id % 2 = 0)::DOUBLE AS sessions_meeting, count(*) FILTER (event_id % 2 <> 0)::DOUBLE AS sessions_aicc,
    count(*) FILTER (is_final AND v <> 0)::DOUBLE AS utterances, coalesce(sum(event_id % 1000) FILTER (is_final), 0)::DOUBLE AS audio_ms, coalesce(CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (is_final) AS DOUBLE), 0) AS confidence_sum, count(*) FILTER (is_final)::DOUBLE AS confidence_n,
    count(*) FILTER (is_final AND v <> 0 AND value > 50)::DOUBLE AS pii_masked, coalesce(sum(k) FILTER (is_final AND v <> 0), 0)::DOUBLE AS rule_hits, count(*)::DOUBLE AS bot_turns, count(*) FILTER (event_id % 7 = 0)::DOUBLE AS handoffs,
    count(*) FILTER (k <> 0)::DOUBLE AS summaries_ready, count(*) FILTER (k = 0)::DOUBLE AS summaries_failed, coalesce(sum(event_id % 13 * 10) FILTER (k <> 0), 0)::DOUBLE AS summary_latency_sum, count(*) FILTER (k <> 0 AND event_id % 13 > 0)::DOUBLE AS summary_latency_n,
    sum(event_id % 11)::DOUBLE AS summary_waited_sum, count(*) FILTER (event_id % 17 = 0)::DOUBLE AS summary_gave_up FROM e GROUP BY 1, 2""")
def event_counters(spark, sf_dir):
    rows = _bus(spark, sf_dir)
    return R.merged_counters(R.utterance_counters(rows), R.recognition_counters(rows), R.bot_counters(rows), R.summary_counters(rows), R.session_counters(rows))


@query(f"""WITH {_EVENTS}, d AS (SELECT tenant_id, day, sum(CAST(value AS DECIMAL(18,6))) FILTER (is_final) AS c, count(*) FILTER (is_final) AS n, count(*) FILTER (event_id % 7 = 0) AS h, count(*) AS b, count(*) FILTER (k <> 0) AS r FROM e GROUP BY 1, 2)
    SELECT tenant_id, day, round(coalesce(CAST(c AS DOUBLE) / nullif(n, 0), 0), 6) AS mean_confidence, round(h / b, 6) AS handoff_rate, round(r / b, 6) AS summary_success FROM d""")
def daily_ratios(spark, sf_dir):
    rows = event_counters(spark, sf_dir)
    return R.with_ratios(rows).select("tenant_id", "day", *(F.round(c, 6).alias(c) for c in ("mean_confidence", "handoff_rate", "summary_success")))


@query("""WITH s AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM conversations)
    SELECT conv_id AS session_id, turn AS ts, regexp_replace(said, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS text FROM s WHERE role = 'assistant' AND turn % 2 = 1 AND said <> ''""")
def handoff_fallbacks(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("session_id", "seq", F.col("seq").alias("ts"), F.when(F.col("role") == "user", "customer").otherwise(F.col("role")).alias("role"), "text", F.lit("n").alias("node_id"), ((F.col("role") == "assistant") & (F.col("seq") % 2 == 1)).alias("handed_off"))
    return R.handoff_utterances(rows).select("session_id", "ts", "text")


@query("""WITH s AS (SELECT event_type AS tenant_id, arg_max(props, event_id) AS p FROM events WHERE event_id % 5 = 0 AND event_type <> (SELECT min(event_type) FROM events) GROUP BY 1)
    SELECT event_id, coalesce(p, 'default') AS settings FROM events LEFT JOIN s ON tenant_id = event_type""")
def tenant_settings(spark, sf_dir):
    rows = _bus(spark, sf_dir)
    first = rows.agg(F.min("tenant_id").alias("tenant_id"))
    settings = rows.join(first, "tenant_id", "left_anti").select("tenant_id", F.col("event_id").alias("version"), (F.col("event_id") % 5 == 0).alias("published"), F.col("props").alias("value"))
    return R.with_settings(rows.select("tenant_id", "event_id"), settings, F.lit("default")).select("event_id", "settings")


@query("""SELECT conv_id AS session_id, turn AS start_ms, CASE WHEN turn % 3 = 0 THEN 'speaker_' || turn % 2 ELSE role END AS speaker_id, CASE CASE WHEN turn % 3 = 0 THEN 'speaker_' || turn % 2 ELSE '' END WHEN '' THEN CASE role WHEN 'user' THEN '고객' ELSE '참여자' END ELSE 'speaker_' || turn % 2 END AS label FROM conversations""")
def speaker_labels(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("session_id", F.col("seq").alias("start_ms"), F.lit("").alias("speaker_id"), F.when(F.col("role") == "user", "customer").otherwise("other").alias("channel"), "role")
    labels = rows.where("start_ms % 3 = 0").select("session_id", "start_ms", F.concat(F.lit("speaker_"), F.col("start_ms") % 2).alias("speaker_id"), F.col("start_ms").alias("ts"))
    made = R.labelled(rows, labels)
    return made.select("session_id", "start_ms", F.when(F.col("speaker_id") == "", F.col("role")).otherwise(F.col("speaker_id")).alias("speaker_id"), T.role_label(F.col("speaker_id"), F.col("channel")).alias("label"))


@query("""WITH c AS (SELECT DISTINCT conv_id AS session_id FROM conversations), d AS (SELECT user_id AS session_id, arg_max(CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ready' END, event_id) AS done FROM events GROUP BY 1)
    SELECT session_id, coalesce(done, 'none') AS summary_status FROM c LEFT JOIN d USING (session_id)""")
def summary_status_backfill(spark, sf_dir):
    calls = _turns(spark, sf_dir).select(F.col("session_id").cast("long").alias("session_id")).distinct().withColumn("summary_status", F.lit("none"))
    return R.with_summary_status(calls, _bus(spark, sf_dir).select(F.col("user_id").alias("session_id"), "status", F.col("event_id").alias("ts")))


@query("""WITH h AS (SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS version, o_orderstatus AS value FROM orders), l AS (SELECT id, max(version) AS last FROM h GROUP BY 1),
    f AS (SELECT c_custkey AS id, coalesce(last, 0) + 1 AS version, c_mktsegment AS value FROM customer LEFT JOIN l ON id = c_custkey), a AS (SELECT * FROM h UNION ALL SELECT * FROM f)
    SELECT id, version, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM a) WHERE k <= 5""")
def published_versions(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("o"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("published_at"))
    history = R.with_sequence(orders, ["id"], ["o"], "version").withColumn("version", F.col("version").cast("long"))
    drafts = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"), F.current_date().alias("published_at"))
    return R.published(drafts, history.withColumn("published_at", F.col("published_at").cast("date")), 5).select("id", "version", "value")


@query("""SELECT event_id, 'sess_' || strftime(ts, '%Y%m%d') || '_' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS session_id, event_id * 7 AS duration_ms, date_diff('day', TIMESTAMP '2024-01-15', date_trunc('day', ts)) AS days_left,
    CASE WHEN date_diff('day', TIMESTAMP '2024-01-15', date_trunc('day', ts)) >= 0 THEN 'valid' WHEN date_diff('day', TIMESTAMP '2024-01-15', date_trunc('day', ts)) >= -7 THEN 'grace' ELSE 'expired' END AS state FROM events""")
def session_times(spark, sf_dir):
    rows = _read(spark, sf_dir, "events")
    closed = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("event_id") * 7 / F.lit(1000))
    licence = R.licence_state(F.to_date(F.lit("2024-01-15")), F.to_date("ts"), 7)
    return rows.select("event_id", R.session_id(F.col("ts"), F.col("event_id")).alias("session_id"), R.session_ms(F.col("ts"), closed).alias("duration_ms"), licence["days_left"].cast("long").alias("days_left"), licence["state"].alias("state"))


@query("""SELECT event_type AS suite, count(*) AS total, count(*) FILTER (value > 50) AS passed, round(count(*) FILTER (value > 50) / count(*), 4) AS accuracy, count(*) FILTER (event_id % 10 = 0) AS known_limitations, count(*) FILTER (event_id % 7 = 0) AS misroutes,
    round(avg(event_id % 1000), 3) AS mean_latency_ms, round(quantile_disc(CAST(event_id % 1000 AS DOUBLE), 0.95), 3) AS p95_latency_ms FROM events GROUP BY 1""")
def check_metrics(spark, sf_dir):
    e = F.col("event_id")
    rows = _read(spark, sf_dir, "events").select(F.col("event_type").alias("suite"), (F.col("value") > 50).alias("passed"), (e % 10 == 0).alias("known_limitation"), (e % 7 == 0).alias("misroute"), (e % 1000).cast("double").alias("latency_ms"))
    return E.check_metrics(rows, ["suite"])


@query("""SELECT user_id, round(quantile_disc(value, 0.9), 3) AS percentile FROM events GROUP BY 1""")
def nearest_rank_percentile(spark, sf_dir):
    return E.nearest_rank(_read(spark, sf_dir, "events"), ["user_id"], "value", 0.9)


@query("""WITH w AS (SELECT doc_id, quality = 1 AS a, toxic = 1 AS b FROM labels), f AS (SELECT doc_id, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b FROM documents), j AS (SELECT doc_id, coalesce(w.a, false) AS wa, coalesce(w.b, false) AS wb, coalesce(f.a, false) AS fa, coalesce(f.b, false) AS fb FROM w FULL JOIN f USING (doc_id))
    SELECT doc_id, concat_ws(',', CASE WHEN wa AND NOT fa THEN 'quality' END, CASE WHEN wb AND NOT fb THEN 'toxic' END) AS missed, concat_ws(',', CASE WHEN fa AND NOT wa THEN 'quality' END, CASE WHEN fb AND NOT wb THEN 'toxic' END) AS extra, wa = fa AND wb = fb AS passed FROM j WHERE wa OR wb OR fa OR fb""")
def expected_kinds(spark, sf_dir):
    kinds = lambda rows, a, b: rows.select(F.col("doc_id").alias("case_id"), F.explode(F.array_compact(F.array(F.when(a, "quality"), F.when(b, "toxic")))).alias("kind"))
    wanted = kinds(_read(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    found = kinds(_read(spark, sf_dir, "documents"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0)
    return E.span_checks(found, wanted).select(F.col("case_id").alias("doc_id"), F.array_join("missed", ",").alias("missed"), F.array_join("extra", ",").alias("extra"), "passed")


@query("""SELECT CAST(item_id AS VARCHAR) AS case_id, 'doc-' || item_id AS doc_id, 'not in the corpus' AS gap FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT NULL, 'doc-' || doc_id, 'never expected' FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark)""")
def golden_coverage(spark, sf_dir):
    name = lambda c: F.concat(F.lit("doc-"), c)
    cases = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), name(F.col("item_id")).alias("doc_id"))
    return E.coverage_gaps(cases, _read(spark, sf_dir, "labels").select(name(F.col("doc_id")).alias("doc_id")))


@query("""WITH o AS (SELECT o_custkey AS product, o_orderkey AS line, o_orderkey % 5 AS a, o_orderkey % 7 AS b, CAST(o_orderdate AS VARCHAR)[1:10] AS d FROM orders),
    p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(d) OVER w AS pd, row_number() OVER (PARTITION BY product, a, b ORDER BY line) AS again FROM o WINDOW w AS (PARTITION BY product ORDER BY line))
    SELECT product, line, unnest(list_filter([CASE WHEN again > 1 THEN 'repeated' END, CASE WHEN line % 3 = 0 THEN 'commit' END, CASE WHEN pa IS NOT NULL AND (a, b) <= (pa, pb) THEN 'version goes back' END, CASE WHEN d < pd THEN 'date goes back' END], lambda x: x IS NOT NULL)) AS problem FROM p""")
def release_history(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("product"), key.alias("line"), F.concat_ws(".", key % 5, key % 7, F.lit("0")).alias("version"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("released_at"),
        F.when(key % 3 == 0, "none").otherwise(F.sha1(key.cast("string"))).alias("commit"), F.create_map(F.lit("p"), F.sha2(key.cast("string"), 256)).alias("packages"),
    )
    return C.release_faults(rows).select("product", "line", "problem")


@query("""SELECT p_brand AS package, sha256(string_agg(concat_ws(':', p_partkey, p_size, p_type), chr(10) ORDER BY p_partkey)) AS hash FROM part GROUP BY 1""")
def configuration_hashes(spark, sf_dir):
    return C.configuration_hash(_read(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_partkey").alias("id"), F.col("p_size").alias("version"), F.col("p_type").alias("hash")))


@query("""WITH c AS (SELECT s_suppkey, CAST(ceil(s_suppkey * 10 * 2 * 0.75) AS BIGINT) AS n FROM supplier) SELECT s_suppkey, n AS channels, CAST(ceil(n / CASE WHEN s_suppkey % 2 = 0 THEN 24 ELSE 4 END) AS BIGINT) AS stt, CAST(ceil(n / 128) AS BIGINT) AS speakers, CAST(ceil(ceil(n / 2) / 96) AS BIGINT) AS tts, s_suppkey % 2 <> 0 AND n > 16 AS too_many_for_cpu FROM c""")
def capacity_plan(spark, sf_dir):
    profile = F.when(F.col("s_suppkey") % 2 == 0, "stt-large-gpu").otherwise("stt-small-cpu")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", C.capacity(F.col("s_suppkey") * 10, profile, with_tts=True).alias("c")).select("s_suppkey", "c.*")


@query("""SELECT CAST(p_size AS VARCHAR) AS tier, count(*) AS blocks, CAST(sum(p_partkey) AS BIGINT) AS effort FROM part GROUP BY GROUPING SETS ((1), ())""")
def effort_totals(spark, sf_dir):
    return C.effort(_read(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("tier"), F.col("p_partkey").alias("effort")))


@query("""WITH b AS (SELECT n_name AS id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS c FROM nation WHERE n_nationkey % 2 = 0), m AS (SELECT min(c) AS channels, arg_min(id, (c, id)) AS id FROM b WHERE c IS NOT NULL)
    SELECT channels, id, round((SELECT count(*) FROM supplier) / channels, 3) AS used, (SELECT count(*) FILTER (s_suppkey % 2 = 0) FROM supplier) AS ready FROM m""")
def platform_limits(spark, sf_dir):
    key = F.col("n_nationkey")
    limit = C.channel_limit(_read(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.when(key % 5 != 0, key).alias("concurrent_channels"), (key % 2 == 0).alias("enabled")))
    status = C.status(_read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 2 == 0).alias("ready")))
    return limit.crossJoin(status).select("channels", "id", C.utilisation(F.col("total"), F.col("channels")).alias("used"), "ready")  # one row each


_SINO = """array_to_string(list_transform([3, 2, 1, 0], lambda p: CASE WHEN ({g}) // CAST(pow(10, p) AS BIGINT) % 10 = 0 THEN '' WHEN ({g}) // CAST(pow(10, p) AS BIGINT) % 10 = 1 AND p > 0 THEN ['', '십', '백', '천'][p + 1]
    ELSE ['영', '일', '이', '삼', '사', '오', '육', '칠', '팔', '구'][({g}) // CAST(pow(10, p) AS BIGINT) % 10 + 1] || ['', '십', '백', '천'][p + 1] END), '')"""


@query(f"""SELECT o_orderkey, CASE o_orderkey WHEN 0 THEN '영' ELSE concat_ws(' ', CASE o_orderkey // 10000 WHEN 0 THEN NULL WHEN 1 THEN '만' ELSE {_SINO.format(g="o_orderkey // 10000")} || '만' END, nullif({_SINO.format(g="o_orderkey % 10000")}, '')) END AS said FROM orders""")
def sino_numerals(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", speech.sino(F.col("o_orderkey").cast("string")).alias("said"))


@query()
def spoken_turns(spark, sf_dir):
    """Turns as a voice reads them, in sentences of which the first sounds early, with the mouth's frames."""
    said = spread(_turns(spark, sf_dir)).select("session_id", "seq", speech.spoken(F.col("text")).alias("said"))
    return said.select("session_id", "seq", "said", speech.first_sound(F.col("said")).alias("chunks"), speech.mouth_track(F.col("said"), F.length("said") * 80).alias("frames"))


_INTENTS = [("refund", ("refund", "money back"), ("i want my money back", "give me a refund")), ("help", ("help me", "how (do|can) i"), ("how do i do that", "can you help me")), ("thanks", ("thank",), ("thank you so much",))]


@query("""SELECT conv_id AS session_id, turn AS seq, CASE WHEN regexp_matches(text, '(?i)refund') OR regexp_matches(text, '(?i)money back') THEN 'refund' WHEN regexp_matches(text, '(?i)help me') OR regexp_matches(text, '(?i)how (do|can) i') THEN 'help' WHEN regexp_matches(text, '(?i)thank') THEN 'thanks' END AS intent FROM conversations""")
def intent_patterns(spark, sf_dir):
    intents = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, patterns)).alias("patterns")) for name, patterns, _ in _INTENTS))
    return _turns(spark, sf_dir).select("session_id", "seq", T.first_intent(F.col("text"), intents).alias("intent"))


@query()
def intent_route(spark, sf_dir):
    """The intent by pattern, else by the likeness of examples, of every turn."""
    turns = _turns(spark, sf_dir).select(F.concat_ws("/", "session_id", "seq").alias("utterance_id"), F.lit("n").alias("node_id"), "text")
    intents = spark.createDataFrame([("n", name, list(examples)) for name, _, examples in _INTENTS], "node_id string, name string, examples array<string>")
    patterns = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, patterns)).alias("patterns")) for name, patterns, _ in _INTENTS))
    names = F.array(*(F.lit(name) for name, *_ in _INTENTS))
    alike = retrieval.intent_scores(turns, intents).select("utterance_id", F.col("intent").alias("alike"))
    rows = turns.select("utterance_id", T.first_intent(F.col("text"), patterns).alias("first")).join(alike, "utterance_id", "left")
    return rows.select("utterance_id", T.first_declared([F.col("first"), F.col("alike")], names).alias("intent"))


@query()
def dialogue_replay(spark, sf_dir):
    """Users' turns of each conversation, played through a scenario of four nodes."""
    node = lambda **x: {"prompt": "", "reprompt": "", "next_node": "", "slot": "", "max_retries": 0, "intents": [], **x}
    ways = [{"name": name, "patterns": list(patterns), "next_node": "person" if name == "refund" else "ask"} for name, patterns, _ in _INTENTS]
    nodes = [node(node_id="hello", kind="say", prompt="hello", next_node="ask"), node(node_id="ask", kind="ask", prompt="what can I do?", reprompt="pardon?", slot="wish", max_retries=2, intents=ways), node(node_id="person", kind="handoff", prompt="one moment"), node(node_id="bye", kind="end", prompt="bye")]
    said = _turns(spark, sf_dir).where("role = 'user'").select("session_id", "seq", "text", F.lit(None).cast("string").alias("intent"))
    return D.played(said, nodes, "hello", "person")


@query("""SELECT conv_id AS session_id, turn AS seq, regexp_replace(text, 'a\\s*n\\s*s\\s*w\\s*e\\s*r|t\\s*h\\s*e|a\\s*n\\s*d', CASE WHEN true THEN '<x>' END, 'g') AS text FROM conversations""")
def lexicon_correct(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "seq", T.corrected(F.col("text"), [("<x>", ("the", "and", "answer", "x")), ("<y>", ("the",))]).alias("text"))


def _lexicons(spark, sf_dir):
    """A lexicon for each of forty tenants: in its second version the first words of four letters that its first turn has, in the first version others."""
    first = _turns(spark, sf_dir).groupBy((F.col("session_id") % 40).alias("tenant_id")).agg(F.min_by("text", F.struct("session_id", "seq", "role")).alias("text"))
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), 1, 3)
    name = F.concat(F.lit("<"), F.col("tenant_id").cast("string"), F.lit(">"))
    entry = lambda variants: F.array(F.struct(name.alias("surface"), variants.alias("variants"), F.lit(True).alias("enabled")))
    rows = first.select("tenant_id", words.alias("words"))
    made = rows.select("tenant_id", F.lit(2).alias("version"), entry(F.col("words")).alias("entries"))
    return made.unionByName(rows.select("tenant_id", F.lit(1).alias("version"), entry(F.array(F.lit("the"), F.lit("and"))).alias("entries")))


@query("""WITH f AS (SELECT conv_id % 40 AS tenant_id, regexp_extract_all(coalesce(arg_min(text, (conv_id, turn, role)), ''), '[A-Za-z]{4,}')[1:3] AS w FROM conversations GROUP BY 1),
    p AS (SELECT tenant_id, string_agg(array_to_string(string_split(form, ''), '\\s*'), '|' ORDER BY length(form) DESC, form) AS pattern FROM (SELECT tenant_id, unnest(list_append(w, '<' || tenant_id || '>')) AS form FROM f) WHERE length(form) >= 2 GROUP BY 1)
    SELECT c.conv_id AS session_id, c.turn AS seq, CASE WHEN p.pattern IS NULL THEN c.text ELSE regexp_replace(c.text, p.pattern, '<' || p.tenant_id || '>', 'g') END AS text FROM conversations c LEFT JOIN p ON p.tenant_id = c.conv_id % 40""")
def tenant_lexicons(spark, sf_dir):
    """Turns of many tenants, each corrected by its own tenant's newest lexicon, in one plan."""
    turns = _turns(spark, sf_dir).withColumn("tenant_id", F.col("session_id") % 40)
    return L.corrected_by_tenant(turns, _lexicons(spark, sf_dir)).select("session_id", "seq", "text")


@query("""WITH t AS (SELECT doc_id, text, regexp_replace(text, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS bare FROM documents)
    SELECT doc_id, md5(substr(bare, 1, 180) || CASE WHEN length(bare) > 180 THEN '...' ELSE '' END) AS snippet, md5(CASE WHEN length(text) > 600 THEN substr(text, 1, 400) || chr(10) || '…' || chr(10) || right(text, 200) ELSE text END) AS transcript,
    regexp_replace(regexp_replace(substr(text, 1, 60), '[^A-Za-z0-9._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name, length(bare) >= 6 AS search, round(least(1, greatest(0, exp(doc_id % 7 / -3.0))), 9) AS confidence,
    CAST((doc_id * 40503 % 65536 - doc_id * 7 % 65536 + 32768 + 65536) % 65536 - 32768 AS BIGINT) AS delta FROM t""")
def text_projections(spark, sf_dir):
    t, d = F.col("text"), F.col("doc_id")
    return _read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.snippet(t)).alias("snippet"), F.md5(T.truncated_transcript(t, 600)).alias("transcript"), T.safe_name(F.substring(t, 1, 60)).alias("name"), T.should_search(t).alias("search"), F.round(T.confidence(d % 7 / -3.0), 9).alias("confidence"),
        T.sequence_delta(d * 40503 % 65536, d * 7 % 65536).alias("delta"),
    )


def _masked_sql(text: str) -> str:
    for kind, inner in (("RRN", "[0-9]{6}[-\\s]?[1-4][0-9]{6}"), ("CARD", "[0-9]{4}[-\\s]?[0-9]{4}[-\\s]?[0-9]{4}[-\\s]?[0-9]{4}"), ("PHONE", "(?:01[016789]|02|0[3-6][1-5])[-\\s]?[0-9]{3,4}[-\\s]?[0-9]{4}"), ("ACCOUNT", "[0-9]{2,4}[-\\s][0-9]{2,6}[-\\s][0-9]{4,7}")):
        for _ in range(2):  # neighbours share the character between them
            text = f"regexp_replace({text}, '(^|[^0-9]){inner}([^0-9]|$)', '\\1[{kind}_MASKED]\\2', 'g')"
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}([^A-Za-z0-9.-]|$)', '\\1[EMAIL_MASKED]\\2', 'g')"
    return text


@query(f"SELECT doc_id, md5({_masked_sql('text')}) AS masked FROM documents")
def pii_mask_text(spark, sf_dir):
    """The masked text itself, by its digest."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.masked(F.col("text"))).alias("masked"))


@query(f"""SELECT conv_id AS session_id, turn AS seq, md5({_masked_sql('text')}) AS clean_text, {_masked_sql('text')} <> text AS pii_masked, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)refund') THEN 'a' END, CASE WHEN regexp_matches(text, '[?]') THEN 'b' END) AS rules FROM conversations""")
def filter_projection(spark, sf_dir):
    rules = F.array(*(F.struct(F.lit(i).alias("rule_id"), F.lit("warn").alias("severity"), F.lit("").alias("message"), F.lit(p).alias("pattern")) for i, p in (("a", "(?i)refund"), ("b", "[?]"))))
    rows = W.filtered(_turns(spark, sf_dir), rules)
    return rows.select("session_id", "seq", F.md5("clean_text").alias("clean_text"), "pii_masked", F.array_join("matched_rules.rule_id", ",").alias("rules"))


@query("""WITH f AS (SELECT d.source AS tenant_id, doc_id AS ts, d.lang AS query, quality = 1 AS accepted, row_number() OVER (PARTITION BY d.source ORDER BY doc_id DESC, d.lang) AS k FROM labels JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL AND d.lang IS NOT NULL),
    c AS (SELECT tenant_id, query, count(*) AS n, max(ts) AS last FROM f WHERE k <= 50 AND NOT accepted GROUP BY 1, 2)
    SELECT tenant_id, query, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, last DESC, query) AS INTEGER) AS rank FROM c) WHERE rank <= 2""")
def rejected_queries(spark, sf_dir):
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").where("source is not null and lang is not null"), "doc_id")
    return W.rejected_queries(rows.select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("ts"), F.col("lang").alias("query"), (F.col("quality") == 1).alias("accepted")), 50, 2)


@query("""SELECT item_id AS request_id, CAST(p AS INTEGER) AS place, doc_id AS chunk_id, source FROM (SELECT item_id, unnest([item_id + 100, 1000000000, item_id]) AS id, unnest([0, 1, 2]) AS p FROM benchmark) JOIN documents ON doc_id = id""")
def chunks_by_id(spark, sf_dir):
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.array(F.col("item_id") + 100, F.lit(1_000_000_000).cast("long"), F.col("item_id")).alias("chunk_ids"))
    chunks = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return retrieval.fetched(asked, chunks)


@query("""SELECT o_orderkey AS doc_id, CASE WHEN count(l_orderkey) > 0 THEN 'ready' ELSE 'failed' END AS state, count(l_orderkey) AS chunk_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 GROUP BY 1""")
def ingest_states(spark, sf_dir):
    """Orders as documents, and their larger lines as the chunks that came of them."""
    return retrieval.ingested(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), _read(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("doc_id")))


@query("""SELECT p_partkey AS chunk_id, p_brand AS text FROM part WHERE p_size <= 40 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_size > 40""")
def index_upsert(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return retrieval.upserted(part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("text")), part.where("p_size > 40").select(F.col("p_partkey").alias("chunk_id"), F.lit("new").alias("text")))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS ordinal FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def document_delete(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal"))
    return retrieval.without_documents(rows, _read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id")))


@query("""WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, min(l_suppkey % 3) AS doc_id FROM lineitem GROUP BY 1, 2), f AS (SELECT query_id, doc_id, min(rank) AS rank FROM r GROUP BY 1, 2) SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS doc_ids FROM f GROUP BY 1""")
def document_fold(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank")).agg(F.min(F.col("l_suppkey") % 3).alias("doc_id"))
    return retrieval.found_documents(rows).select("query_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query("""SELECT event_id, user_id FROM events WHERE event_id % 4 <> 0 AND ts > TIMESTAMP '2024-01-15 08:00:00'""")
def live_dialogue_states(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("updated_at"), (F.col("event_id") % 4 == 0).alias("finished"))
    return W.live_dialogues(rows, F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))).select("event_id", "user_id")
