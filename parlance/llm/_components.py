"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._shared import drop_stored, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its least node.

    Each round hooks a node's larger neighbours, then its smaller ones, to the
    least of them (the alternating algorithm of Kiveris and others, 2014), so
    long chains take a logarithmic number of rounds. Everything is a
    groupBy and an equi-join; the rounds' edges are tables in shared storage.
    Self-loops and repeated edges are fine; no edges give no rows.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(hooked.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_stored(current)
        current = small
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    # stars now: every u points at its component's least node
    return stored(current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct()), "components")
