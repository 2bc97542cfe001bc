"""Mixing sources to target weights by pivotal dependent rounding (operator 10)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm._shared import WS, mix64, stored

#: Weights of the sources by code point, null last, repeating; share of all words; cap per source.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Rows that one pivotal pass takes, and how many passes' residuals one pass of the next level takes.
ROWS, FAN = 4096, 1024
STATE = "source string, unit long, h long, doc_id long, size long, p double, copies int, pass long"


def n_words(text):
    """How many [^\\x20\\x09-\\x0D]+ a text has; null: 0."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{WS}]+|[{WS}]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"[{WS}]+"))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target words per source: by weight, none above cap times its size.

    What the cap cuts off is shared again by weight among the other sources
    until none is above. Sources of size 0 get 0.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[k % len(weights)]) for k, (s, _) in enumerate(order)}
    most = {s: cap * n for s, n in order}
    total, out, free = share * sum(n for _, n in order), {}, [s for s, _ in order]
    while free:
        left = total - sum(out.values())
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > most[s]]
        if not full:
            return out | {s: weight[s] * unit for s in free}
        out |= {s: most[s] for s in full}
        free = [s for s in free if s not in out]
    return out


def _coin(a: int, b: int) -> float:
    """The same number in [0, 1) for the same two rows, in every run."""
    x = np.array([(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
    return int(mix64(x)[0] >> np.uint64(11)) / float(1 << 53)


def pivot(p: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding in the order given: the rounded p, and the row left fractional or -1.

    Two rows at a time, probability moves from one to the other until one of
    them is 0 or 1; each keeps its chance, and the sum stays as it is.
    """
    p, open_row = p.copy(), -1
    for j in range(len(p)):
        if not 1e-9 < p[j] < 1 - 1e-9:
            p[j] = round(p[j])
            continue
        if open_row < 0:
            open_row = j
            continue
        i, a, b = open_row, p[open_row], p[j]
        u = _coin(int(unit[i]), int(unit[j]))
        if a + b < 1:
            keep_first = u < a / (a + b)
            p[i], p[j] = (a + b, 0.0) if keep_first else (0.0, a + b)
        else:
            keep_first = u < (1 - b) / (2 - a - b)
            p[i], p[j] = (1.0, a + b - 1) if keep_first else (a + b - 1, 1.0)
        open_row = next((k for k in (i, j) if 1e-9 < p[k] < 1 - 1e-9), -1)
        for k in (i, j):
            if k != open_row:
                p[k] = round(p[k])
    return p, open_row


def _pass(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "unit"], kind="stable").reset_index(drop=True)
    p, left = pivot(rows["p"].to_numpy(), rows["unit"].to_numpy())
    if left >= 0 and rows["last"].iloc[0]:
        p[left] = float(_coin(int(rows["unit"][left]), 0) < p[left])
        left = -1
    rows["copies"] += p.astype(np.int64).astype(np.int32)
    rows["p"] = 0.0
    if left >= 0:
        rows.loc[left, "p"] = p[left]
    return rows[["source", "unit", "h", "doc_id", "size", "p", "copies", "pass"]]


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """How often the mix takes each document.

    docs has doc_id, text and source. Returns a row for each row given:
    doc_id, size, source_size, target, taken (size times copies), copies, h (a
    hash of id, source and text), and unit, which names the row. All documents of a source have the expected
    copies target / source_size, at most `cap`; its whole part is taken at
    once and the fraction is rounded by the pivotal method. Rows of a source
    are dealt by hash into passes of about ROWS, ordered by size in each, so
    that probability moves between documents of like size and words stay near
    the target; each pass leaves at most one row fractional. These rows go up
    a tree whose passes take FAN each, until a source has one pass, whose last
    row is decided by its own chance. All chances are hashes of the rows, so
    reruns agree.

    A null text has size 0, a null source is a source of its own, repeated rows
    are told apart by a number, and an empty table gives no rows.
    """
    named = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("h"))
    again = Window.partitionBy("doc_id", "h").orderBy("size")
    rows = stored(named.withColumn("k", F.row_number().over(again)).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "h", F.xxhash64("doc_id", "h", "k").alias("unit")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    known = per_source.collect()  # one row a source
    if not known:
        return rows.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies"), "h", "unit")
    target = targets([(r["source"], r["source_size"]) for r in known], weights, share, cap)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(r["source"], r["source_size"], target[r["source"]], target[r["source"]] / r["source_size"] if r["source_size"] else 0.0, -(-r["n"] // ROWS)) for r in known],
        "source string, source_size long, target double, rate double, passes long",
    )
    side = F.broadcast(table) if len(known) <= 100_000 else table
    rated = rows.join(side, rows["source"].eqNullSafe(table["source"])).drop(table["source"])
    level = rated.select("source", "unit", "h", "doc_id", "size", (F.col("rate") - F.floor("rate")).alias("p"), F.floor("rate").cast("int").alias("copies"), F.pmod(F.xxhash64("unit"), "passes").alias("pass"), (F.col("passes") == 1).alias("last"))
    most, settled = max(-(-r["n"] // ROWS) for r in known), None
    while True:
        done = stored(level.groupBy("source", "pass").applyInPandas(_pass, STATE), "level")
        whole = done.where("p = 0").select("doc_id", "source", "size", "h", "unit", "copies")
        settled = whole if settled is None else settled.unionByName(whole)
        if most == 1:
            break
        most = -(-most // FAN)
        level = done.where("p > 0").select("source", "unit", "h", "doc_id", "size", "p", "copies", F.floor(F.col("pass") / FAN).alias("pass"), (F.lit(most) == 1).alias("last"))
    out = settled.join(side, settled["source"].eqNullSafe(table["source"])).drop(table["source"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "h", "unit")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
