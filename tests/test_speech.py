"""Numbers as they are read, sentences and mouth shapes."""

import time

import pytest
from pyspark.sql import functions as F

from parlance.functions import speech as S

READ = {
    "잔액은 1,234,567원": "잔액은 백이십삼만 사천오백육십칠 원",
    "10,000원": "만 원",
    "3억 2천만원": "삼억 이천만원",
    "상품 3개를 주문": "상품 세 개를 주문",
    "커피 20잔": "커피 스무 잔",
    "사과 21개": "사과 스물한 개",
    "100명": "백 명",
    "45분 걸립니다": "사십오 분 걸립니다",
    "고객 3분이 대기": "고객 세 분이 대기",
    "2024-03-05": "이천이십사년 삼월 오일",
    "14:30 방문": "십사 시 삼십 분 방문".replace("십사", "열네"),
    "9:00": "아홉 시 정각",
    "010-1234-5678": "공일공 일이삼사 오육칠팔",
    "900101-1234567": "구공공일공일 일이삼사오육칠",
    "이자율 15%": "이자율 십오 퍼센트",
    "5kg": "오 킬로그램",
    "VIP 고객": "브이아이피 고객",
    "20개월": "이십 개월",
    "번호 0": "번호 영",
    "값 110011": "값 십일만 십일",
    "100000000": "억",
    "10001": "만 일",
    "７개": "일곱 개",
    "안녕하세요": "안녕하세요",
    "": "",
}


@pytest.fixture(scope="module")
def one(spark):
    return lambda column, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} {'int' if isinstance(x, int) else 'string'}" for k, x in v.items())).select(column.alias("x")).first()["x"]


def test_numbers_are_read(spark):
    rows = spark.createDataFrame(list(enumerate(READ)), "k int, t string")
    got = {r["t"]: r["x"] for r in rows.select("t", S.spoken(F.col("t")).alias("x")).collect()}
    assert got == READ


def test_numerals_of_all_sizes(spark):
    def group(n):
        return "".join(("" if d == 1 and p else S.SINO_DIGITS[d]) + S.SINO_SMALL_UNITS[p] for p in (3, 2, 1, 0) if (d := n // 10**p % 10))

    def read(n):
        parts = [(k, n // 10**(4 * k) % 10000) for k in range(5)]
        return " ".join(S.SINO_BIG_UNITS[k] if g == 1 and k and n // 10**(4 * k) == 1 else group(g) + S.SINO_BIG_UNITS[k] for k, g in reversed(parts) if g) or "영"

    numbers = [0, 1, 9, 10, 11, 99, 100, 101, 1000, 1001, 9999, 10000, 10001, 20000, 110000, 10**8, 10**8 + 10**4, 10**12, 10**16, 10**16 + 1, 12345678901234567890, 10**19]
    rows = spark.createDataFrame([(str(n),) for n in numbers], "n string")
    assert {r["n"]: r["x"] for r in rows.select("n", S.sino(F.col("n")).alias("x")).collect()} == {str(n): read(n) for n in numbers}


def test_readings_in_one_pass(one):
    readings = {"행복플러스": "해피", "무배당행복플러스": "무배당 행복"}
    assert one(S.spoken(F.col("t"), readings), t="무배당 행복 플러스와 행복플러스") == "무배당 행복와 해피"


def test_sentences(one):
    assert one(S.sentences(F.col("t")), t="처리했습니다.다음 안내입니다. 네") == ["처리했습니다.", "다음 안내입니다. 네"]
    assert one(S.sentences(F.col("t")), t="제3조. 목적은 이렇습니다.") == ["제3조. 목적은 이렇습니다."]
    assert one(S.sentences(F.col("t")), t=" ") == []
    long = "확인해 보니 지난달 요금이, 두 번 청구된 것으로 보입니다. 다음."
    assert one(S.first_sound(F.col("t")), t=long) == ["확인해 보니 지난달 요금이,", "두 번 청구된 것으로 보입니다. 다음."]
    assert one(S.first_sound(F.col("t")), t="짧은 말입니다.") == ["짧은 말입니다."]


def test_mouth_shapes(one):
    assert tuple(one(S.jamo(F.col("t")), t="밥")) == ("ㅂ", "ㅏ", "ㅂ") and tuple(one(S.jamo(F.col("t")), t="가")) == ("ㄱ", "ㅏ", "") and one(S.jamo(F.col("t")), t="a") is None
    shapes = [(s["shape"], round(s["share"], 2)) for s in one(S.syllable_shapes(F.col("t")), t="밥")]
    assert shapes == [("PP", 0.45), ("AA", 0.4), ("PP", 0.15)]
    track = one(S.mouth_track(F.col("t"), F.col("d")), t="바 바", d=1000)
    assert [tuple(f) for f in track] == [(0, "PP"), (225, "AA"), (500, "PP"), (725, "AA"), (1000, "SIL")]
    assert one(S.mouth_track(F.col("t"), F.col("d")), t="바", d=0) == [] and [tuple(f) for f in one(S.mouth_track(F.col("t"), F.col("d")), t=" ", d=9)] == [(0, "SIL")]


def test_long_texts_have_mouth_tracks(spark):
    text, ms = "밥 a가각!" * 700, 200_000
    shapes = {c: [tuple(s) for s in spark.createDataFrame([(c,)], "t string").select(S.syllable_shapes(F.col("t"))).first()[0]] for c in set(text) - {" "}}
    marks, want, cursor = text.replace(" ", ""), [], 0.0
    for mark in marks:
        for shape, share in shapes[mark]:
            at = int(cursor)
            if not (want and (want[-1][1] == shape or at - want[-1][0] < 20)):
                want.append((at, shape))
            cursor += ms / len(marks) * share
    began = time.monotonic()
    track = spark.createDataFrame([(text, ms)], "t string, d int").select(S.mouth_track(F.col("t"), F.col("d"))).first()[0]
    assert [tuple(f) for f in track] == [*want, (ms, "SIL")]
    assert time.monotonic() - began < 30
