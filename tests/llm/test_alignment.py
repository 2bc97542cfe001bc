"""Tokens aligned by divide and conquer, against plain comparison of all ends."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm.alignment import align_tokens, op12_token_alignment, shared_cuts

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ZERO = (0, 0, 0, 0, 0, 0, "")


def _byte(c):
    """The byte of a byte-level vocabulary's character: printable ones stand for themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return ord(c) if ord(c) in shown else [b for b in range(256) if b not in shown][ord(c) - 256]


def brute(docs):
    tok, sp = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    tok.encode_special_tokens = True
    cache, aligned, count = {}, [], Counter()
    for _, text in docs:
        groups = []
        if text:
            a, b, whole = tok.encode(f" {text}", add_special_tokens=False), sp.encode(text), f" {text}".encode()
            a_bytes = [bytes(cache.setdefault(c, _byte(c)) for c in t) for t in a.tokens]
            b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
            if b"".join(a_bytes) == whole == b"".join(b_bytes):
                ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
                for end in sorted(set(ends_a) & set(ends_b)):
                    done = (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups)) if len(groups) < 50 else (i, j)
                    i, j = ends_a.index(end, done[0]) + 1, ends_b.index(end, done[1]) + 1
                    groups.append((a.ids[done[0] : i], b[done[1] : j]))
        count.update((x[-1], y[-1]) for x, y in groups)
        aligned.append(groups)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for (doc_id, _), groups in zip(docs, aligned):
        links = [(x[-1], y[-1]) for x, y in groups]
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sums = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links))
        out.append((doc_id, *sums, hashlib.sha256(listed.encode()).hexdigest()) if groups else (doc_id, *ZERO))
    return sorted(map(repr, out))


def rows_of(df):
    assert df.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted(repr(tuple(r)) for r in df.collect())


def test_query_by_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert rows_of(op12_token_alignment(spark, small)) == brute(docs)


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_odd_rows(spark, limit):
    docs = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, " "), (4, "   three  blanks\n\n\ttabs \r\n"), (5, "x<|endoftext|> y <s> </s> <unk> <0x41>"), (6, "▁ lower block"), (7, "é ﬁ 　 日本語 🎉🎉 한글 \x00 \x7f"), (8, "word " * 30_000 + "end"), (9, "é" * 5000), (10, "a" * 20_000), (11, "\U0001f9d1‍\U0001f680" * 900), (12, "same text"), (12, "same text")]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({c: F.lit("x") for c in ("row", "pairs", "times", "n", "pair", "best", "n_a")})
    got = rows_of(align_tokens(made, FIRST, SECOND, broadcast_pairs=limit))
    assert got == brute(docs)
    assert repr((6, *ZERO)) in got and repr((5, *ZERO)) not in got
    assert align_tokens(made.limit(0), FIRST, SECOND, broadcast_pairs=limit).count() == 0


def test_cuts_are_all_shared_ends():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 100, 5000):
        for share in (0.02, 0.5, 1.0):
            a, b = (np.unique(np.r_[rng.choice(4 * n, max(1, int(share * 2 * n))), 4 * n]) for _ in range(2))
            assert a[shared_cuts(a, b)].tolist() == np.intersect1d(a, b).tolist()
    none = np.arange(0, 4000, 2)
    assert shared_cuts(none, none + 1).tolist() == [] and shared_cuts(none[:0], none).tolist() == []
