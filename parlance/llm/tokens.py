"""Token ids of whole texts, and token counts through a digest cache (operator 6)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm._shared import fresh_path

MAX_TOKENS = 1024
#: The words and runs that the byte-level pre-tokenizer of the tokenizers library makes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CODERS: dict[str, Coder] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """Whole texts to ids by a byte-level BPE file of the tokenizers library.

    Where ids stand in the order of merges, merging by the least id and by the
    first merge are the same, and tiktoken's core gives the ids several times
    as fast; tests compare it with the library over all kinds of characters.
    Files of another make, and texts that its patterns give up on (white space
    by the million), go through the library. Nothing grows with the texts.
    """

    def __init__(self, path: str):
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, vocab, byte_of = made["model"], made["model"].get("vocab"), _byte_of()
        cut = made["pre_tokenizer"] or {}
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges") or ()]
        plain = (
            model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and made["normalizer"] is None
            and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and None not in merged and merged == sorted(merged)
            and not any(t[k] for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if plain:
            import tiktoken

            special = {t["content"]: t["id"] for t in made["added_tokens"]}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special and all(c in byte_of for c in token)}
            self.fast = tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in _CODERS:
            _CODERS[path] = cls(path)
        return _CODERS[path]

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:  # the pattern's stack is full
                pass
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path)
        for b in batches:
            n = [len(coder.ids(t.as_py() or "")) // 4 for t in b.column("text")]
            yield pa.record_batch([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, version: str = "byte_bpe_50k", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Tokens of each whole text, counted once per distinct content and cached.

    docs has doc_id and text; cache_path is a folder of Parquet files with
    (digest, version, n_tokens), made when absent and appended to. A text's
    digest is SHA-256 of its UTF-8 bytes. Normalising means that null becomes
    empty: anything more would change the counts. Contents that the cache
    lacks for this tokenizer version are coded once each and appended; then all
    rows take their count by a join on the digest. Hot contents are combined
    before the shuffle, and adaptive execution splits the join's hot keys.

    Rows come back as they were given: repeated rows and null ids each give a
    row; an empty table gives none; further columns of docs don't matter.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    texts = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("text"))
    schema = "digest binary, version string, n_tokens long"
    before = _cache(spark, cache_path, schema)
    if before is not None:
        texts = texts.join(before.where(F.col("version") == version).select("digest"), "digest", "left_anti")
    missing = texts.groupBy("digest").agg(F.first("text").alias("text"))
    fresh = missing.mapInArrow(_counted(tokenizer_path), "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(schema).parquet(cache_path).where(F.col("version") == version)
    # two runs may append the same content; one count per digest is enough
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def _cache(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(schema).parquet(path)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, over a cache that starts empty."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))
