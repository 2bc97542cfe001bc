"""Search over a golden set, with and without query expansion, where one is given.

GOLDEN_SEARCH names a folder with corpus/ (Markdown articles), queries.jsonl
(case_id, query, expected) and lexicon.json (trigger to terms, in order).
"""

import json
import os

import pytest

from parlance.operators import evaluation as E
from parlance.operators import retrieval as R
from parlance.operators import stored_search
from parlance.operators.sparse_index import SparseIndex
from parlance.operators.vector_index import VectorIndex
from parlance.functions.text import tokens
from parlance.sources import files as S
from pyspark.sql import functions as F

GOLDEN = os.environ.get("GOLDEN_SEARCH")
#: recall, mean reciprocal rank and nDCG at three over 42 queries with the lexicon.
PUBLISHED = (1.0, 0.9484, 0.9617)


@pytest.mark.skipif(not GOLDEN, reason="GOLDEN_SEARCH names no folder")
def test_published_figures(spark):
    corpus, cases = S.articles(spark, f"{GOLDEN}/corpus"), S.golden(spark, f"{GOLDEN}/queries.jsonl", "retrieval")
    with open(f"{GOLDEN}/lexicon.json", encoding="utf-8") as file:
        lexicon = [(k, tuple(v)) for k, v in json.load(file).items()]
    _, metrics = E.retrieval_suite(cases, corpus, lexicon=lexicon)
    got = metrics.first()
    assert (got["recall"], got["mrr"], got["ndcg"]) == PUBLISHED


def test_stored_search_equals_search(spark, tmp_path):
    texts = ["해지 신청은 고객센터에서 합니다", "연체 이자와 수수료 안내", "한도 상향 신청과 한도 하향", "분실 신고 후 재발급 수수료 면제", "결제일 변경은 영업일 기준", "the fee of a card", "cancel the contract today"]
    chunks = spark.createDataFrame([(f"c{k}", t, f"제{k}조") for k, t in enumerate(texts)], "chunk_id string, text string, title string")
    queries = spark.createDataFrame([(1, "공짜로 재발급"), (2, "카드 잃어버림"), (3, "fee"), (4, ""), (5, "해지하고 싶어요 제0조")], "query_id long, text string")
    lexicon = [("공짜", ("면제",)), ("잃어버", ("분실", "신고"))]
    sparse, vectors = SparseIndex(spark, f"file://{tmp_path}/s"), VectorIndex(spark, f"file://{tmp_path}/v")
    sparse.add(chunks)
    made = R.hashed_vectors(chunks.select("chunk_id", tokens(F.col("text")).alias("terms")))
    vectors.fit(made, lists=3)
    vectors.add(made)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    for words in (None, lexicon):
        assert rows(stored_search.search(queries, sparse, vectors, lexicon=words)) == rows(R.search(queries, R.indexed(chunks), lexicon=words))
