"""Golden sets against results: rows of checks, their metrics, and transcripts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.speech import spoken
from parlance.functions.text import character_error, comparable, first_intent, grounding_verdict, masked, masked_kinds, word_error
from parlance.operators import retrieval
from parlance.storage import drop_stored, stored

#: Groups up to this size are ordered in one task; the range of larger ones is counted in so many parts.
FEW_VALUES, BINS = 10_000, 1024


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


def selected(rows: DataFrame, keys: list[str], value: str, rank: Column, few: int = FEW_VALUES) -> DataFrame:
    """The rank-th smallest value of each group, as column `chosen`; rank is a column over n, the group's number of values; nulls don't count.

    Groups of up to `few` values are ordered where they stand. In larger ones
    the range of values is counted in BINS parts, of which the one with the
    wanted place goes on, with its own least and greatest value, until few
    values or a single one are left. So no group is held by one task, however
    large it is or however often a value occurs.
    """
    own = rows.select(*keys, F.col(value).alias("_v")).where("_v is not null")
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    bounds = stored(sizes.withColumn("k", rank.cast("long")), "bounds")
    while not (wide := bounds.where((F.col("n") > few) & (F.col("low") < F.col("high")))).isEmpty():
        inside = own.alias("o").join(wide.alias("b"), _same("o", "b", keys) & F.col("_v").between(F.col("low"), F.col("high")))
        part = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS))
        counts = inside.select(*(F.col(f"b.{key}") for key in keys), "k", "_v", part.alias("bin")).groupBy(*keys, "k", "bin").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))  # at most BINS rows a group
        chosen = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        narrowed = chosen.select(*keys, "n", "low", "high", (F.col("k") - F.col("upto") + F.col("n")).alias("k"))
        fresh = stored(bounds.where((F.col("n") <= few) | (F.col("low") >= F.col("high"))).unionByName(narrowed), "bounds")
        drop_stored(bounds)
        bounds = fresh
    single = bounds.where("low >= high").select(*keys, F.col("low").alias("chosen"))
    left = own.alias("o").join(bounds.where("low < high").alias("b"), _same("o", "b", keys) & F.col("_v").between(F.col("low"), F.col("high"))).select(*(F.col(f"b.{key}") for key in keys), "_v", "k")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))  # at most `few` rows a group
    found = left.withColumn("place", place).where(F.col("place") == F.col("k")).select(*keys, F.col("_v").alias("chosen")).unionByName(single)
    every = rows.select(*keys).distinct()
    return every.alias("e").join(found.alias("f"), _same("e", "f", keys), "left").select(*(F.col(f"e.{key}") for key in keys), "chosen")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, share: float, few: int = FEW_VALUES) -> DataFrame:
    """The nearest-rank percentile of each group, the ceil(n * share)-th value, as column `percentile` (three decimals); nulls don't count."""
    made = selected(rows, keys, value, F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share))), few)
    return made.select(*keys, F.round("chosen", 3).alias("percentile"))


def check_metrics(checks: DataFrame, keys: list[str], few: int = FEW_VALUES) -> DataFrame:
    """Per suite: cases, passed, accuracy (four decimals), known limitations, misroutes, mean and 95th percentile of latency_ms (three).

    checks has the keys, passed, known_limitation, misroute and latency_ms.
    """
    sums = checks.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.round(F.count_if("passed") / F.count("*"), 4).alias("accuracy"),
        F.count_if("known_limitation").alias("known_limitations"), F.count_if("misroute").alias("misroutes"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"),
    )
    p95 = nearest_rank(checks, keys, "latency_ms", 0.95, few)
    return sums.alias("s").join(p95.alias("p"), _same("s", "p", keys)).select("s.*", F.col("percentile").alias("p95_latency_ms"))


def studio_results(runs: DataFrame) -> DataFrame:
    """Runs of a golden set (case_id, expected, returned, latency_ms) with hit and rank: the first place among the returned ids, repeated ones too, that is expected."""
    places = F.filter(F.transform("returned", lambda d, i: F.when(F.array_contains("expected", d), i + 1)), lambda i: i.isNotNull())
    return runs.withColumn("rank", F.array_min(places)).withColumn("hit", F.col("rank").isNotNull())


def studio_report(runs: DataFrame, keys: list[str] = (), few: int = FEW_VALUES) -> DataFrame:
    """Per set: total, hits, recall_at_k (four decimals), mean_latency_ms (two) and p95_latency_ms, the floor(n * 0.95)-th latency and the first at least."""
    keys = list(keys)
    rows = studio_results(runs)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 4).alias("recall_at_k"), F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms")).where("total > 0")
    chosen = selected(rows.withColumn("_all", F.lit(0)), [*keys, "_all"], "latency_ms", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.95))), few).drop("_all")
    return sums.alias("s").join(chosen.alias("p"), _same("s", "p", keys), "left").select("s.*", F.col("chosen").cast("double").alias("p95_latency_ms"))


def intent_checks(cases: DataFrame) -> DataFrame:
    """Cases (case_id, expect, chosen; null abstains) with passed, and misroute where another intent was chosen than expected."""
    return cases.select("*", F.col("expect").eqNullSafe(F.col("chosen")).alias("passed"), F.coalesce(F.col("chosen") != F.coalesce("expect", F.lit("")), F.lit(False)).alias("misroute"))


def span_checks(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per case the kinds missed and extra, and whether neither is (case_id, kind on both sides)."""
    sides = wanted.select("case_id", "kind", F.lit(1).alias("w")).distinct().join(found.select("case_id", "kind", F.lit(1).alias("f")).distinct(), ["case_id", "kind"], "full")
    kinds = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("kind"))))
    made = sides.groupBy("case_id").agg(kinds(F.col("f").isNull()).alias("missed"), kinds(F.col("w").isNull()).alias("extra"))
    return made.withColumn("passed", (F.size("missed") == 0) & (F.size("extra") == 0))


def coverage_gaps(cases: DataFrame, articles: DataFrame) -> DataFrame:
    """Expected articles (case_id, doc_id) that the corpus lacks, and corpus articles that no case expects."""
    lost = cases.join(articles.select("doc_id").distinct(), "doc_id", "left_anti").select("case_id", "doc_id", F.lit("not in the corpus").alias("gap"))
    idle = articles.join(cases.select("doc_id").distinct(), "doc_id", "left_anti").select(F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), "doc_id", F.lit("never expected").alias("gap"))
    return lost.unionByName(idle)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand on more than one row, and on how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def not_first(ranks: DataFrame) -> DataFrame:
    """Cases (case_id, rank; null: not found) whose first relevant result isn't at rank 1."""
    return ranks.where("rank is null or rank <> 1")


def composed(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with the named text columns in composed form (NFC), by Arrow batches; only texts that differ are rewritten."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for name, column in zip(b.schema.names, b.columns):
                if name in columns and not pc.all(pc.string_is_ascii(column), skip_nulls=True).as_py():
                    column = pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in column.to_pylist()], column.type)
                made.append(column)
            yield pa.record_batch(made, names=b.schema.names)

    return rows.mapInArrow(run, schema)


def transcript_scores(pairs: DataFrame) -> DataFrame:
    """Word and character errors of (case_id, reference, heard), with the reference's lengths. Texts are composed first."""
    rows = composed(pairs.select("case_id", F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("heard", F.lit("")).alias("heard")), "reference", "heard")
    r, h = F.col("reference"), F.col("heard")
    words = F.size(F.filter(F.split(comparable(r), " "), lambda w: w != ""))
    return rows.select("case_id", word_error(r, h).alias("word_errors"), words.alias("words"), character_error(r, h).alias("character_errors"), F.length(F.replace(comparable(r), F.lit(" "), F.lit(""))).alias("characters"), (comparable(h) == "").alias("empty"))


def transcript_metrics(scores: DataFrame) -> DataFrame:
    """Error rates of the whole set: sums of errors over sums of lengths, never means of rates (three decimals)."""
    rate = lambda a, b: F.round(F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0), 3)
    return scores.agg(F.count("*").alias("cases"), rate("word_errors", "words").alias("wer"), rate("character_errors", "characters").alias("cer"), F.count_if("empty").alias("empty"))


def _checks(rows: DataFrame, suite: str, passed: Column, misroute: Column | None = None) -> DataFrame:
    """Rows of cases as checks (suite, case_id, passed, known_limitation, misroute, latency_ms); Spark times no single case."""
    known = F.coalesce("known_limitation", F.lit(False)) if "known_limitation" in rows.columns else F.lit(False)
    return rows.select(F.lit(suite).alias("suite"), "case_id", F.coalesce(passed, F.lit(False)).alias("passed"), known.alias("known_limitation"), F.coalesce(misroute if misroute is not None else F.lit(False), F.lit(False)).alias("misroute"), F.lit(None).cast("double").alias("latency_ms"))


def reading_suite(cases: DataFrame, readings: dict[str, str] | None = None) -> DataFrame:
    """Whether texts (case_id, text, expect) are read just as expected."""
    return _checks(cases, "tts", spoken(F.col("text"), readings) == F.col("expect"))


def masking_suite(cases: DataFrame) -> DataFrame:
    """Whether just the expected kinds are found in texts (case_id, text, expect_types, must_not_contain, known_limitation), and nothing is left that must not be."""
    none = F.expr("cast(array() as array<string>)")
    found, want = F.array_sort(F.array_distinct(masked_kinds(F.col("text")))), F.array_sort(F.array_distinct(F.coalesce("expect_types", none)))
    left = F.exists(F.coalesce("must_not_contain", none), lambda x: F.contains(masked(F.col("text")), x))
    return _checks(cases, "pii", (found == want) & ~left)


def grounding_suite(cases: DataFrame) -> DataFrame:
    """Whether answers (case_id, answer, evidence, accept, known_limitation) are accepted just where they should be."""
    return _checks(cases, "grounding", grounding_verdict(F.col("answer"), F.col("evidence")).isNull() == F.col("accept"))


def intent_suite(cases: DataFrame, by_examples: bool = True) -> DataFrame:
    """Whether texts (case_id, utterance, expect, intents) get the expected intent: the first by pattern, else by the likeness of examples.

    A wrong intent is a misroute; none where one is expected is a failure only.
    """
    texts = cases.select(F.col("case_id").alias("utterance_id"), F.col("case_id").alias("node_id"), F.col("utterance").alias("text"))
    examples = lambda i: F.array_compact(F.concat(F.coalesce(i["examples"], F.expr("cast(array() as array<string>)")), F.array(i["description"], i["name"])))
    intents = cases.select(F.col("case_id").alias("node_id"), F.explode("intents").alias("i")).select("node_id", "i.name", examples(F.col("i")).alias("examples"))
    alike = retrieval.intent_scores(texts, intents).select(F.col("utterance_id").alias("case_id"), F.col("intent").alias("alike")) if by_examples else cases.select("case_id", F.lit(None).cast("string").alias("alike"))
    rows = cases.join(alike, "case_id", "left").withColumn("chosen", F.coalesce(first_intent(F.col("utterance"), F.col("intents")), "alike"))
    judged = intent_checks(rows.withColumn("expect", F.when(F.col("expect") != "", F.col("expect"))))
    return _checks(judged, "intent", F.col("passed"), F.col("misroute"))


def retrieval_suite(cases: DataFrame, corpus: DataFrame, k: int = retrieval.TOP, lexicon: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranks, metrics) of queries (case_id, query, expected) over articles (doc_id, title, text).

    Articles are cut into chunks, searched, and the chunks found are folded to
    their documents in order; ranks has case_id, doc_ids and the first relevant
    rank (null: not among them).
    """
    chunks = retrieval.chunked(corpus).join(corpus.select("doc_id", "title"), "doc_id")
    queries = cases.select(F.col("case_id").alias("query_id"), F.col("query").alias("text"))
    found = retrieval.search(queries, retrieval.indexed(chunks), k, lexicon=lexicon).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    folded = retrieval.found_documents(found).select(F.col("query_id").alias("case_id"), "doc_ids")
    rows = cases.select("case_id", "expected").join(folded, "case_id", "left")
    places = F.filter(F.transform(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.when(F.array_contains("expected", F.get("doc_ids", i - 1)), i)), lambda i: i.isNotNull())
    ranks = rows.select("case_id", "doc_ids", F.when(F.size("doc_ids") > 0, F.array_min(places)).alias("rank"))
    listed = folded.select(F.col("case_id").alias("query_id"), F.posexplode("doc_ids").alias("place", "chunk_id")).select("query_id", "chunk_id", (F.col("place") + 1).alias("rank"))
    wanted = cases.select(F.col("case_id").alias("query_id"), F.explode(F.array_distinct("expected")).alias("chunk_id"))
    return ranks, retrieval.retrieval_metrics(listed, wanted, k)


def recognition_suite(pairs: DataFrame) -> DataFrame:
    """Error rates of a set of transcripts (case_id, reference, heard)."""
    return transcript_metrics(transcript_scores(pairs))
