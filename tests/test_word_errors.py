"""Word and character errors against brute force."""

import time

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.plans.queries import QUERIES


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors_with_many_words(spark):
    a = [f"w{i}" for i in range(450)]
    b = a[:3] + [a[203]] + a[4:]  # both had the code of place 4
    pairs = [(a, b), (a, a), ("안녕 세상".split(), "안녕 세계".split()), ("é a".split(), "e a".split()), (["x"], "x y z".split())]
    rows = spark.createDataFrame([(k, " ".join(x), " ".join(y)) for k, (x, y) in enumerate(pairs)], "k int, a string, b string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("k", T.word_error(F.col("a"), F.col("b")), T.character_error(F.col("a"), F.col("b"))).collect()}
    assert got == {k: (_distance(x, y), _distance("".join(x), "".join(y))) for k, (x, y) in enumerate(pairs)}


def test_word_errors_are_registered(spark, small):
    rows = QUERIES["word_character_errors"](spark, small)
    assert rows.count() == QUERIES["wer_cer"](spark, small).count() and rows.where("word_errors > 0").count() > 0


def test_word_errors_of_long_texts_take_no_square_of_splits(spark):
    a = [f"w{i}" for i in range(6000)]
    b = a[:10] + ["x"] + a[11:]
    rows = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    began = time.monotonic()
    assert rows.select(T.word_error(F.col("a"), F.col("b"))).first()[0] == 1
    assert time.monotonic() - began < 30
