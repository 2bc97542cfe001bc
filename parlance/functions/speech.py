"""Column functions for spoken Korean: numbers as they are read, sentences, readings and mouth shapes. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import strip

# --- fixed values: results depend on them ------------------------------------
SINO_DIGITS = ("영", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구")
SINO_SMALL_UNITS = ("", "십", "백", "천")
SINO_BIG_UNITS = ("", "만", "억", "조", "경")
NATIVE_ONES = ("", "한", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉")
NATIVE_TENS = ("", "열", "스물", "서른", "마흔", "쉰", "예순", "일흔", "여든", "아흔")
NATIVE_TWENTY = "스무"
NATIVE_COUNTERS = ("개", "명", "분", "번", "살", "마리", "권", "장", "대", "채", "켤레", "그루", "송이", "자루", "통", "잔", "병", "시", "가지", "달")
SINO_COUNTERS = ("원", "년", "월", "일", "초", "％", "%", "퍼센트", "도", "층", "호", "회", "km", "kg", "m", "cm", "g", "ml", "l", "일간", "개월", "주")
UNIT_READING = {"%": "퍼센트", "％": "퍼센트", "km": "킬로미터", "kg": "킬로그램", "cm": "센티미터", "ml": "밀리리터", "m": "미터", "g": "그램", "l": "리터", "℃": "도", "$": "달러"}
LETTER_READING = {
    "A": "에이", "B": "비", "C": "씨", "D": "디", "E": "이", "F": "에프", "G": "지", "H": "에이치", "I": "아이", "J": "제이", "K": "케이", "L": "엘", "M": "엠",
    "N": "엔", "O": "오", "P": "피", "Q": "큐", "R": "알", "S": "에스", "T": "티", "U": "유", "V": "브이", "W": "더블유", "X": "엑스", "Y": "와이", "Z": "지",
}
PEOPLE_HINTS, HINT_CHARS = ("고객", "손님", "참석", "직원", "가족", "동반", "인원"), 12
RRN = r"(?U)\b(\d{6})-(\d{7})\b"
PHONE = r"(?U)\b(0\d{1,2})[-.](\d{3,4})[-.](\d{4})\b"
DATE = r"(?U)\b(\d{4})[-./](\d{1,2})[-./](\d{1,2})\b"
TIME = r"(?U)\b(\d{1,2}):(\d{2})\b"
MAGNITUDE = r"(?U)(\d{1,3}(?:,\d{3})*|\d+)\s*(조|억|만|천|백|십)"
MONEY = r"(?U)\b(\d{1,3}(?:,\d{3})+|\d+)\s*원"
NUMBER_UNIT = r"(?U)(\d{1,3}(?:,\d{3})*|\d+)\s*(%|％|[A-Za-z]{1,2}|[가-힣]{1,3})"
NUMBER = r"(?U)\b\d{1,3}(?:,\d{3})+\b|\b\d+\b"
ACRONYM = r"(?U)\b[A-Z]{2,}\b"
SENTENCE_END = r"(?U)(?<=[!?。？！])\s+|(?<=[다요]\.)\s*|(?<![0-9조항호장절목]\.)(?<=\.)\s+|\n+"
CLAUSE_BREAK = r"(?U)(?<=[,、])\s*|(?<=니다)\s+(?=[가-힣])"
FIRST_CHUNK, LEAST_CHUNK = 24, 4
CHOSEONG, JUNGSEONG, JONGSEONG = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ", " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
CONSONANT_SHAPES = {"PP": "ㅁㅂㅃㅍ", "DD": "ㄴㄷㄸㅌㄹ", "CH": "ㅅㅆㅈㅉㅊ", "KK": "ㄱㄲㅋ", "AA": "ㅎ"}
VOWEL_SHAPES = {"AA": "ㅏㅑㅘ", "E": "ㅐㅒㅔㅖㅙㅞ", "OH": "ㅓㅕㅗㅛㅝ", "OU": "ㅜㅠㅟㅚ", "IH": "ㅡㅣㅢ"}
LIPS_SHARE, ONSET_SHARE, CODA_SHARE, LEAST_FRAME_MS = 0.45, 0.3, 0.15, 20
# -----------------------------------------------------------------------------

MOST_DIGITS = 4 * len(SINO_BIG_UNITS)
_FULL_WIDTH = "".join(chr(0xFF10 + d) for d in range(10))
_NONE = "cast(array() as array<string>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once and named inside.

    Columns are trees: a column used twice is written and computed twice, and
    steps that each use the one before twice or more grow without bound.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _replaced(text: Column, pattern: str, reading: Callable[..., Column], wide: bool = False) -> Column:
    """The text with each match of a pattern replaced by reading(match), or where wide by reading(match, number, text, between, matches).

    Spark has no replacement by function: the text between matches and the
    readings of the matches are put together again.
    """

    def put(t: Column, between: Column, found: Column) -> Column:
        each = F.transform(found, lambda m, i: F.concat(F.get(between, i), reading(m, i, t, between, found) if wide else reading(m)))
        return F.concat(F.array_join(each, ""), F.element_at(between, -1))

    def matched(t: Column) -> Column:
        found = lambda f: F.when(F.size(f) > 0, let(F.split(t, pattern, -1), lambda b: put(t, b, f))).otherwise(t)
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), found)

    return let(text, matched)


def _look_up(table: tuple[str, ...], digit: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, table)), digit.cast("int") + 1)


def _digits(number: Column) -> Column:
    """ASCII digits without commas and leading zeros; "0" for zero."""
    bare = F.translate(F.replace(number, F.lit(","), F.lit("")), _FULL_WIDTH, "0123456789")
    return F.regexp_replace(bare, "^0+(?=.)", "")


def sino(number: Column) -> Column:
    """A whole number, given as text, in Sino-Korean: groups of four digits apart; a leading one before 만 and up is not read.

    Numbers over 20 digits stay as they are.
    """

    def read(digits: Column, padded: Column) -> Column:
        groups = []
        for k in reversed(range(len(SINO_BIG_UNITS))):
            at = MOST_DIGITS - 4 * k - 3
            group, parts = F.substring(padded, at, 4), []
            for place in (3, 2, 1, 0):
                digit = F.substring(padded, at + 3 - place, 1)
                parts.append(F.when(digit == "0", "").when((digit == "1") & F.lit(place > 0), SINO_SMALL_UNITS[place]).otherwise(F.concat(_look_up(SINO_DIGITS, digit), F.lit(SINO_SMALL_UNITS[place]))))
            alone = (group == "0001") & (F.length(digits) <= 4 * k + 1) & F.lit(k > 0)
            groups.append(F.when(group == "0000", F.lit(None)).when(alone, SINO_BIG_UNITS[k]).otherwise(F.concat(*parts, F.lit(SINO_BIG_UNITS[k]))))
        return F.when(digits == "0", SINO_DIGITS[0]).when(F.length(digits) > MOST_DIGITS, digits).otherwise(F.concat_ws(" ", *groups))

    return let(_digits(number), lambda d: let(F.lpad(d, MOST_DIGITS, "0"), lambda p: read(d, p)))


def native(number: Column) -> Column:
    """1 to 99 as native numerals before a counter, other numbers in Sino-Korean."""

    def read(digits: Column) -> Column:
        two = F.lpad(digits, 2, "0")
        tens = F.when(digits == "20", NATIVE_TWENTY).otherwise(_look_up(NATIVE_TENS, F.substring(two, 1, 1)))
        return F.when((F.length(digits) > 2) | (digits == "0"), sino(digits)).otherwise(F.concat(tens, _look_up(NATIVE_ONES, F.substring(two, 2, 1))))

    return let(_digits(number), read)


def digit_by_digit(text: Column) -> Column:
    """Every digit by itself, zero as 공; other characters go."""
    bare = F.regexp_replace(F.translate(text, _FULL_WIDTH, "0123456789"), "[^0-9]", "")
    return F.translate(bare, "0123456789", "공" + "".join(SINO_DIGITS[1:]))


def _group(pattern: str, match: Column, k: int) -> Column:
    return F.regexp_extract(match, pattern, k)


def counter_of(token: Column) -> Column:
    """The longest known counter that a token starts with, else the whole token."""
    known = sorted({*NATIVE_COUNTERS, *SINO_COUNTERS}, key=lambda c: (-len(c), c))
    return F.coalesce(*(F.when(token.startswith(c), F.lit(c)) for c in known), token)


def counted(number: Column, unit: Column, context: Column) -> Column:
    """A number with its unit: native before native counters; 분 counts people only near a hint of them."""
    people = F.lit(False)
    for hint in PEOPLE_HINTS:
        people = people | context.contains(hint)
    natively = ~unit.isin(*UNIT_READING) & unit.isin(*NATIVE_COUNTERS) & ((unit != "분") | people)
    name = F.coalesce(*(F.when(unit == u, F.lit(r)) for u, r in UNIT_READING.items()), unit)
    return F.concat_ws(" ", F.when(natively, native(number)).otherwise(sino(number)), name)


def _unit_read(match: Column, i: Column, text: Column, between: Column, found: Column) -> Column:
    length = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + F.length(x))
    start = length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(found, F.lit(1), i))

    def window(at: Column) -> Column:
        first = F.greatest(F.lit(0), at - HINT_CHARS)
        return F.substring(text, first + 1, at + F.length(match) + HINT_CHARS - first)

    def read(token: Column) -> Column:
        said = lambda unit: F.concat(let(let(start, window), lambda w: counted(_group(NUMBER_UNIT, match, 1), unit, w)), F.substring(token, F.length(unit) + 1, F.length(token)))
        return let(counter_of(token), said)

    return let(_group(NUMBER_UNIT, match, 2), read)


def with_readings(text: Column, readings: dict[str, str]) -> Column:
    """Surfaces replaced by their readings in one pass: the longest first, white space between characters allowed."""
    known = sorted(((s, "".join(s.split())) for s in readings), key=lambda x: -len(x[0]))
    known = [(bare, readings[s]) for s, bare in known if bare]
    if not known:
        return text
    pattern = "(?U)" + "|".join(r"\s*".join(f"\\Q{c}\\E" for c in bare) for bare, _ in known)
    first = dict(reversed(known))
    table = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    return _replaced(text, pattern, lambda m: F.coalesce(F.try_element_at(table, F.regexp_replace(m, r"(?U)\s+", "")), m))


def spoken(text: Column, readings: dict[str, str] | None = None) -> Column:
    """A text as a voice should read it: readings, then numbers of each kind, then acronyms; white space squeezed."""
    if readings:
        text = with_readings(text, readings)
    text = _replaced(text, RRN, lambda m: F.concat_ws(" ", digit_by_digit(_group(RRN, m, 1)), digit_by_digit(_group(RRN, m, 2))))
    text = _replaced(text, PHONE, lambda m: F.concat_ws(" ", *(digit_by_digit(_group(PHONE, m, k)) for k in (1, 2, 3))))
    text = _replaced(text, DATE, lambda m: F.concat(sino(_group(DATE, m, 1)), F.lit("년 "), sino(_group(DATE, m, 2)), F.lit("월 "), sino(_group(DATE, m, 3)), F.lit("일")))
    minutes = lambda m: _digits(_group(TIME, m, 2))
    text = _replaced(text, TIME, lambda m: F.concat(native(_group(TIME, m, 1)), F.lit(" 시"), F.when(minutes(m) == "0", " 정각").otherwise(F.concat(F.lit(" "), sino(minutes(m)), F.lit(" 분")))))
    text = _replaced(text, MAGNITUDE, lambda m: F.concat(sino(_group(MAGNITUDE, m, 1)), _group(MAGNITUDE, m, 2)))
    text = _replaced(text, MONEY, lambda m: F.concat(sino(_group(MONEY, m, 1)), F.lit(" 원")))
    text = _replaced(text, NUMBER_UNIT, _unit_read, wide=True)
    text = _replaced(text, NUMBER, lambda m: sino(m))
    letters = F.create_map(*(F.lit(x) for pair in LETTER_READING.items() for x in pair))
    text = _replaced(text, ACRONYM, lambda m: F.array_join(F.transform(F.split(m, ""), lambda c: F.coalesce(F.try_element_at(letters, c), c)), ""))
    return strip(F.regexp_replace(text, r"(?U)\s{2,}", " "))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern, -1), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences of a text; what is under four characters joins the one before."""

    def add(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), part)))
        return F.when((F.size(done) > 0) & (F.length(part) < LEAST_CHUNK), joined).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(_parts(text, SENTENCE_END), F.expr(_NONE), add)


def first_sound(text: Column) -> Column:
    """Sentences, of which a long first one is cut after its first clause, so that speech can begin early."""
    after = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1)))

    def cut(whole: Column, clauses: Column) -> Column:
        first = F.get(clauses, F.lit(0))
        early = (F.length(F.get(whole, F.lit(0))) > FIRST_CHUNK) & (F.size(clauses) > 1) & (F.length(first) >= LEAST_CHUNK)
        return F.when(early, F.concat(F.array(first, F.array_join(after(clauses), " ")), after(whole))).otherwise(whole)

    return let(sentences(text), lambda w: let(_parts(F.get(w, F.lit(0)), CLAUSE_BREAK), lambda c: cut(w, c)))


def _shape(letter: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(F.contains(F.lit(letters), letter), F.lit(shape)) for shape, letters in table.items()))


def jamo(syllable: Column) -> Column:
    """Struct of a Hangul syllable's onset, vowel and coda (empty if none); null for other characters."""
    code = F.conv(F.hex(F.encode(syllable, "UTF-32")), 16, 10).cast("long") - 0xAC00
    pick = lambda letters, at: F.substring(F.lit(letters), (at + 1).cast("int"), F.lit(1))
    made = F.struct(pick(CHOSEONG, F.floor(code / 588)).alias("onset"), pick(JUNGSEONG, F.floor(code % 588 / 28)).alias("vowel"), F.trim(pick(JONGSEONG, code % 28)).alias("coda"))
    return F.when((code >= 0) & (code < 11172), made)


def syllable_shapes(syllable: Column) -> Column:
    """Mouth shapes of a character with their shares of its time, as array of (shape, share)."""
    return let(jamo(syllable), lambda part: _shapes_of(syllable, part))


def _shapes_of(syllable: Column, part: Column) -> Column:
    pair = lambda shape, share: F.struct(shape.alias("shape"), share.cast("double").alias("share"))
    onset = _shape(part["onset"], CONSONANT_SHAPES)
    coda = F.when(part["coda"] != "", _shape(part["coda"], CONSONANT_SHAPES))
    onset_share = F.when(onset.isNull(), 0.0).when(onset == "PP", LIPS_SHARE).otherwise(ONSET_SHARE)
    coda_share = F.when(coda.isNull(), 0.0).otherwise(CODA_SHARE)
    vowel = pair(F.coalesce(_shape(part["vowel"], VOWEL_SHAPES), F.lit("AA")), F.greatest(F.lit(0.1), 1.0 - (onset_share + coda_share)))
    shapes = F.filter(F.array(pair(onset, onset_share), vowel, pair(coda, coda_share)), lambda s: s["shape"].isNotNull())
    return F.when(part.isNotNull(), shapes).when(strip(syllable) != "", F.array(pair(F.lit("E"), F.lit(1.0)))).otherwise(F.array(pair(F.lit("SIL"), F.lit(1.0))))


def mouth_track(text: Column, duration_ms: Column) -> Column:
    """Frames (at_ms, shape) over a text's duration: equal neighbours are one, frames under 20 ms go, silence closes."""
    kind = "array<struct<at_ms:int,shape:string>>"
    frames = F.expr(f"cast(array() as {kind})")
    last = F.expr("cast(null as struct<at_ms:int,shape:string>)").alias("last")
    silence = lambda at: F.array(F.struct(at.cast("int").alias("at_ms"), F.lit("SIL").alias("shape")))

    def add(state: Column, s: Column, each: Column) -> Column:
        at, before = F.floor(state["cursor"]).cast("int"), state["last"]
        drop = F.coalesce((before["shape"] == s["shape"]) | (at - before["at_ms"] < LEAST_FRAME_MS), F.lit(False))
        frame = F.struct(at.alias("at_ms"), s["shape"].alias("shape"))
        return F.struct((state["cursor"] + each * s["share"]).alias("cursor"), F.when(drop, before).otherwise(frame).alias("last"), F.when(drop, state["out"]).otherwise(F.concat(state["out"], F.array(frame))).alias("out"))

    def run(state: Column, marks: Column, each: Column) -> Column:
        """One run of characters: an array that grows is copied each time, so runs are folded alone and then put together."""
        start = F.struct(state["cursor"].alias("cursor"), state["last"].alias("last"), frames.alias("out"))
        fold = F.aggregate(F.flatten(F.transform(marks, syllable_shapes)), start, lambda t, s: add(t, s, each))
        return let(fold, lambda f: F.struct(f["cursor"].alias("cursor"), f["last"].alias("last"), F.concat(state["out"], F.array(f["out"])).alias("out")))

    def track(marks: Column, each: Column, n: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(marks) / n).cast("int") - 1), lambda i: F.slice(marks, i * n + 1, n))
        start = F.struct(F.lit(0.0).alias("cursor"), last, F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        return F.aggregate(runs, start, lambda state, r: run(state, r, each), lambda s: F.flatten(s["out"]))

    def closed(marks: Column) -> Column:
        made = let(duration_ms / F.size(marks), lambda each: let(F.ceil(F.sqrt(F.size(marks))).cast("int"), lambda n: track(marks, each, n)))
        return let(made, lambda t: F.when(F.element_at(t, -1)["shape"] == "SIL", t).otherwise(F.concat(t, silence(duration_ms))))

    marks = F.filter(F.split(F.regexp_replace(text, r"(?U)\s+", ""), ""), lambda c: c != "")
    return F.when(duration_ms <= 0, frames).otherwise(let(marks, lambda m: F.when(F.size(m) == 0, silence(F.lit(0))).otherwise(closed(m))))
