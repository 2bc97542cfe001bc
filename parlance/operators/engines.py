"""Tokenizers, embedders and rerankers by name, so that settings can choose them and indexes can say which one made them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import strip, tokens
from parlance.operators import retrieval


def _spaced(text: Column) -> Column:
    """Lower-case runs of anything but white space."""
    return F.filter(F.split(F.lower(strip(F.coalesce(text, F.lit("")))), r"(?U)\s+"), lambda w: w != "")


def _lexical(candidates: DataFrame, queries: DataFrame, index: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    return retrieval.reranked(candidates, queries, index, k, min_score)


def _as_fused(candidates: DataFrame, queries: DataFrame, index: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """The fused order as it is, its score as the score."""
    kept = candidates.select("query_id", "chunk_id", "rrf", F.col("rrf").alias("score")).where(F.col("score") >= min_score)
    return retrieval.ranked(kept, "score", k)


#: By kind and name. A tokenizer is a function of a column of texts; an embedder
#: of rows (id, terms); a reranker of candidates, queries, an index and k.
ENGINES: dict[str, dict[str, Callable]] = {
    "tokenizer": {"syllable": tokens, "space": _spaced},
    "embedder": {"hashing": retrieval.hashed_vectors},
    "reranker": {"lexical": _lexical, "none": _as_fused},
}


def engine(kind: str, name: str) -> Callable:
    """The engine of a kind and name; unknown ones are an error that names those there are."""
    if kind not in ENGINES:
        raise ValueError(f"no kind {kind}: there are {', '.join(sorted(ENGINES))}")
    if name not in ENGINES[kind]:
        raise ValueError(f"no {kind} {name}: there are {', '.join(sorted(ENGINES[kind]))}")
    return ENGINES[kind][name]


def register(kind: str, name: str, made: Callable) -> None:
    """Add an engine; a name that is taken by another one is an error."""
    if ENGINES.setdefault(kind, {}).get(name, made) is not made:
        raise ValueError(f"{kind} {name} is there already")
    ENGINES[kind][name] = made
