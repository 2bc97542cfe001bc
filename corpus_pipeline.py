"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage works on all that the one before kept. All but the last return the
columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm._shared import stored
from parlance.llm.langid import UNDETERMINED, fit_languages, identify
from parlance.llm.mixing import mix
from parlance.llm.ngram_join import ngram_components
from parlance.llm.packing import pack_documents
from parlance.llm.pii import fit_pii, redact

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that go to Python at once. Spark's default of 10,000 whole texts is held in the executor, in its buffers and in
#: Python at the same time, for each task.
ROWS = 1000


def _in_small_batches(docs: DataFrame) -> DataFrame:
    """The documents, in a session that sends ROWS rows to Python at once."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the language model rejects: no letters, or a calibrated chance under its threshold.

    Rows are judged each by its own text, so repeated rows stay or go together
    and null ids, labels and sources don't matter. Null and empty texts have no
    letters and go. Without labelled rows there is no model, and all documents
    pass. An empty table stays empty; columns beside the five are left out.
    """
    model = fit_languages(_in_small_batches(docs))
    if model is None:
        return docs.select(*COLUMNS)
    named = docs.select("doc_id", "lang", "source", "n_chars", "text", F.col("text").alias("body"))
    found = identify(named, model, ("doc_id", "lang", "source", "n_chars", "body"))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= (model["reject"])))
    return kept.withColumnRenamed("body", "text").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the least id, null ids last.

    Rows are named by a hash of id and text, so rows that share an id but not a
    text are judged each for itself. Rows with equal names are copies, of which
    the least by all columns stays. Texts without words have no links; all of
    them stay, nulls too. An empty table stays empty; columns beside the five
    are left out.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    rows = _in_small_batches(docs).select(*COLUMNS, key.alias("h"))
    found = ngram_components(rows.select(F.col("h").alias("doc_id"), "text"))
    keys = found.groupBy(F.col("doc_id").alias("h")).agg(F.max("n_shingles").alias("n"), F.max("component_id").alias("component"), F.count("*").alias("rows"))
    named = stored(keys.join(rows.groupBy("h").agg(F.max("doc_id").alias("doc_id")), "h"), "named")
    worded = named.where("n > 0")
    least = worded.groupBy("component").agg(F.min_by("h", F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("h"))
    kept = worded.join(least.select("h"), "h", "left_semi")
    whole = rows.join(kept.where("rows = 1").unionByName(named.where("n = 0")).select("h"), "h", "left_semi")
    repeats = rows.join(kept.where("rows > 1").select("h"), "h", "left_semi").groupBy("h").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return whole.select(*COLUMNS).unionByName(repeats.select("r.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in all texts by the names of its kinds.

    Null texts become empty; every row stays, repeated ones and null ids too;
    n_chars is counted anew. An empty table stays empty; columns beside the
    five are left out.
    """
    clean = redact(docs, fit_pii(docs), "doc_id", "lang", "source")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows are named by a hash of id, source and text; equal rows share what
    the mix takes of them. Null sources are one source; null and empty texts
    have size 0, so taking them changes no sum. An empty table stays empty;
    columns beside the five are left out.
    """
    key = F.xxhash64("doc_id", "source", "text")
    taken = mix(docs).groupBy("h").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    rows = docs.select(*COLUMNS, key.alias("h")).join(taken, "h")
    number = F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))
    own = F.floor(F.col("copies") / F.col("n")) + (number <= F.col("copies") % F.col("n")).cast("int")
    return rows.withColumn("own", own.cast("int")).select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("own"))).alias("copy")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    Every row is packed, repeated ones and null ids too; a null or empty text is
    its end alone. An empty table gives no pieces.
    """
    return pack_documents(_in_small_batches(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

#: SQL can't fit the language model; tests/llm holds every stage against brute force on what its predecessor kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
