"""Language identification by averaged hashed subword embeddings (operator 9)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm._shared import held_out_bucket

#: Hash buckets of subwords, embedding width, and the subwords' lengths in bytes.
BUCKETS, WIDTH, LENGTHS = 1 << 15, 16, (2, 3, 4)
#: The classifier is fitted on at most so many labelled documents of each language value.
SAMPLE_PER_LANGUAGE = 1_000
EPOCHS, RATE, SEED = 6, 0.5, 17
UNDETERMINED = "und"


def subwords(text: bytes) -> np.ndarray:
    """Buckets of all byte n-grams of a whole text, A-Z in lower case."""
    raw = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8)
    code, out = np.zeros(len(raw), np.uint32), []
    for k in range(max(LENGTHS)):
        code = code[: len(raw) - k] * np.uint32(257) + raw[k:] + np.uint32(1)
        if k + 1 in LENGTHS and len(code):
            out.append(((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return np.concatenate(out)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> dict:
    """Fit embeddings and a linear softmax by stochastic gradient descent.

    Every fifth row is set aside: on it the softmax temperature is fitted and
    the rejection threshold is set where no more than one in 1000 of the right
    answers would be rejected.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    want = np.array([names.index(x) for x in langs])
    aside = np.arange(len(bags)) % 5 == 4
    fit = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(bags))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            index, weight = bags[i]
            hidden = weight @ embed[index]
            error = _softmax(hidden @ out + bias)
            error[want[i]] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            bias -= rate * error
            embed[index] -= (rate * len(index) ** 0.5) * weight[:, None] * back
    table = embed @ out
    held = np.flatnonzero(aside) if aside.any() else fit
    scores = np.array([w @ table[i] + bias for i, w in (bags[k] for k in held)])
    temperature = min((0.25, 0.5, 1.0, 2.0, 4.0), key=lambda t: -np.log(_softmax(scores / t)[np.arange(len(held)), want[held]] + 1e-12).mean())
    chance = _softmax(scores / temperature)
    right = chance.max(1)[chance.argmax(1) == want[held]]
    reject = float(min(0.4, np.quantile(right, 0.001))) if len(right) else 0.0
    return {"names": names, "table": (table / temperature).astype(np.float32), "bias": bias / temperature, "reject": reject}


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    index, n = np.unique(subwords(text), return_counts=True)
    return index, (n / n.sum()).astype(np.float32)


def _train_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += [(rank, lang, _bag(text)) for rank, lang, text in zip(b.column("rank").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist())]
    if rows:
        rows.sort(key=lambda r: (r[0], r[1]))
        model = train([r[2] for r in rows], [r[1] for r in rows])
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit_languages(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict | None:
    """A model from rows (text, lang) with neither null; None if there are none.

    Of each language at most `per_language` rows are taken, those with the
    least hash of their text; one task fits the model on this bounded sample.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", F.col("text").cast("binary").alias("text")).withColumn("rank", F.xxhash64("text"))
    wanted = _least(rows, per_language)
    sample = rows.join(F.broadcast(wanted), ["lang", "rank"], "left_semi").dropDuplicates(["lang", "rank"])
    got = sample.repartition(1).mapInArrow(_train_in_task, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def _least(rows: DataFrame, n: int) -> DataFrame:
    """The n least ranks of each language, taken first in 64 parts so that no task ranks a whole language."""
    order = Window.partitionBy("lang").orderBy("rank")
    salted = Window.partitionBy("lang", F.pmod("rank", F.lit(64))).orderBy("rank")
    some = rows.select("lang", "rank").distinct().withColumn("k", F.row_number().over(salted)).where(F.col("k") <= n)
    return some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("lang", "rank")


def _predict(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for text, letter in zip(b.column("text"), b.column("has_letter").to_pylist()):
                if model is None or not letter:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                buckets = np.bincount(subwords(text.as_py()), minlength=BUCKETS).astype(np.float32)
                chance = _softmax((buckets @ model["table"]) / buckets.sum() + model["bias"])
                k = int(chance.argmax())
                langs.append(model["names"][k])
                scores.append(float(min(1.0, chance[k])))
            kept = [b.column(i) for i, name in enumerate(b.schema.names) if name not in ("text", "has_letter")]
            names = [x for x in b.schema.names if x not in ("text", "has_letter")]
            yield pa.record_batch([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score (the calibrated probability) of each row.

    Only the text is read. A text that is null or has no letter gets `und` and
    score 0, as does every text when there was nothing to learn from. Repeated
    rows, ties (the first language by name) and very long texts need nothing
    special: whole texts are read, and rows stay as they are. Further columns
    of docs don't matter; keep may not name the result's own columns.
    """
    if taken := {"text", "has_letter", "lang_pred", "score"} & set(keep):
        raise ValueError(f"columns {sorted(taken)} are of the result's own")
    rows = docs.select(*keep, F.col("text").cast("binary").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_predict(model), f"{schema}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("held_out", held_out_bucket(F.col("doc_id"), 4) == 2)
    model = fit_languages(docs.where("not held_out"))
    return identify(docs, model, ("doc_id", "held_out"))
