"""Quality rules with a linear-chain CRF over lines (operator 5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm._shared import drop_stored, mix64, stored

SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: About so many labelled documents are gone through in turn by one task; the models of such parts are averaged after each epoch.
PART = 2_000
#: Shares are told apart in steps of 1 / STEPS when the least one is sought.
STEPS = 10_000
EPOCHS, ROUNDS, RATE, SEED = 4, 2, 0.2, 5
#: Of labelled documents of good quality, at least this share must be kept.
KEPT_GOOD = 0.998
SIGNS = ("repeated", "wordless", "under 3 words", "under 8 words", "symbols", "many symbols", "sentence end", "bar or tag", "capital", "many digits")
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    w = mix64(mix64(h[:-2]) * np.uint64(3) + mix64(h[1:-1] + np.uint64(1)) * np.uint64(5) + mix64(h[2:] + np.uint64(2)) * np.uint64(7))
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def line_codes(lines: list[bytes]) -> tuple[list[int], int, list[int]]:
    """A number of SIGNS bits for each line, how many lines repeat an earlier one, and words a line."""
    seen: set[bytes] = set()
    codes, repeats, sizes = [], 0, []
    for line in lines:
        words = line.split()
        n = len(words)
        sizes.append(n)
        if not n:
            codes.append(2)
            continue
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        code = 0
        if line in seen:
            code, repeats = 1, repeats + 1
        else:
            seen.add(line)
        code |= (4 if n < 3 else 0) | (8 if n < 8 else 0)
        if symbols:
            code |= 16 | (32 if 20 * symbols >= len(line) else 0) | (128 if b"|" in line or b"<" in line else 0)
        code |= 64 if words[-1][-1:] in b".!?" else 0
        code |= 256 if words[0][:1].isupper() or words[0][0] == 0xC3 else 0
        if 5 * (len(line) - len(line.translate(None, b"0123456789"))) >= len(line):
            code |= 512
        codes.append(code)
    return codes, repeats, sizes


def emissions(weights: np.ndarray) -> np.ndarray:
    """Scores (code, label) of every possible number of signs; label 1 is boilerplate."""
    bits = (np.arange(1 << len(SIGNS))[:, None] >> np.arange(len(SIGNS))) & 1
    return np.hstack([bits, np.ones((len(bits), 1))]) @ weights


def viterbi(codes: list[int], table: list[tuple[float, float]], move: np.ndarray) -> list[int]:
    """The best labels of a text's lines; ties go to content."""
    (cc, cb), (bc, bb) = move.tolist()
    a, b = table[codes[0]]
    back = []
    for code in codes[1:]:
        ea, eb = table[code]
        from_a, to_b = a + cc >= b + bc, a + cb >= b + bb
        back.append((0 if from_a else 1, 0 if to_b else 1))
        a, b = (a + cc if from_a else b + bc) + ea, (a + cb if to_b else b + bb) + eb
    label = 0 if a >= b else 1
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def content_share(codes: list[int], sizes: list[int], table, move) -> float:
    """The share of a text's words that stand in lines marked content."""
    labels = viterbi(codes, table, move)
    total = sum(sizes)
    return sum(n for n, x in zip(sizes, labels) if not x) / total if total else 0.0


def _scan(codes: list[int], weights: np.ndarray, move: np.ndarray):
    """(signs of the lines, their scores, forward and backward scores, the log of all labellings' sum)."""
    code, n = np.array(codes), len(codes)
    x = np.hstack([(code[:, None] >> np.arange(len(SIGNS))) & 1, np.ones((n, 1))])
    e = x @ weights
    (cc, cb), (bc, bb) = move.tolist()
    rows = e.tolist()
    a, b = rows[0]
    ahead = [(a, b)]
    for c0, c1 in rows[1:]:
        a, b = c0 + _either(a + cc, b + bc), c1 + _either(a + cb, b + bb)
        ahead.append((a, b))
    total = _either(a, b)
    a = b = 0.0
    behind = [(a, b)]
    for c0, c1 in rows[:0:-1]:
        a, b = _either(cc + c0 + a, cb + c1 + b), _either(bc + c0 + a, bb + c1 + b)
        behind.append((a, b))
    return x, e, np.array(ahead), np.array(behind[::-1]), total


def _either(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))


def _relabelled(codes: list[int], weights: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Lines of a document judged bad: boilerplate where the model finds it, and at least its likeliest line."""
    _, _, ahead, behind, total = _scan(codes, weights, move)
    chance = np.exp(ahead + behind - total)[:, 1]
    return (chance >= min(0.5, chance.max())).astype(int)


def _start() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((len(SIGNS) + 1, 2)), np.zeros((2, 2))


def _epoch(data: list[tuple[int, list[int]]], now: tuple, labelled_by: tuple | None, epoch: int, seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves after one gradient step on the likelihood for each (quality, line codes), in an order of the seed's.

    Lines of good documents are content, those of bad ones boilerplate, or what
    the model labelled_by finds.
    """
    weights, move, rate = now[0].copy(), now[1].copy(), RATE / (1 + epoch)
    for k in np.random.default_rng(seed).permutation(len(data)):
        q, codes = data[k]
        y = np.full(len(codes), int(q != 1)) if q == 1 or labelled_by is None else _relabelled(codes, *labelled_by)
        x, e, ahead, behind, total = _scan(codes, weights, move)
        weights += rate * (x.T @ (np.eye(2)[y] - np.exp(ahead + behind - total))) / len(y)
        if len(y) > 1:
            pair = np.exp(ahead[:-1, :, None] + move + (e + behind)[1:, None, :] - total)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            move += rate * (seen - pair.sum(0)) / len(y)
    return weights, move


def _fitted(step: Callable) -> dict:
    """A model without its least share, by step(now, labelled_by, round, epoch).

    Only whole documents are judged, so their lines' labels are found as the
    model is: all lines of good documents are content; all of bad ones begin as
    boilerplate, and after a round those that the model takes for content, by
    what good documents' lines look like, are content in the next. No rule
    over the signs labels a line.
    """
    now, labelled_by = _start(), None
    for again in range(ROUNDS):
        for epoch in range(EPOCHS):
            now = step(now, labelled_by, again, epoch)
        labelled_by = now
    return {"table": [tuple(r) for r in emissions(now[0]).tolist()], "move": now[1]}


def _least(counts: list[tuple[int, int]]) -> float:
    """The share that KEPT_GOOD of the good documents reach (between two of them, in proportion), from how many there are by step; at most a half."""
    if not counts:
        return 0.0
    counts = sorted(counts)
    ends = np.cumsum([n for _, n in counts])
    place = (1 - KEPT_GOOD) * (int(ends[-1]) - 1)
    low, high = (counts[int(np.searchsorted(ends, int(at), side="right"))][0] for at in (np.floor(place), np.ceil(place)))
    return min(0.5, (low + (high - low) * (place % 1)) / STEPS)


def train(rows: list[tuple[int, bytes]]) -> dict:
    """The model of (quality, text) rows that are one part, a fifth of which is set aside for the least share (see fit_lines)."""
    data = [(q, *(line_codes(t.split(b"\n"))[k] for k in (0, 2))) for q, t in rows]
    data = [(q, c, s) for q, c, s in data if sum(s)]
    fit = [x[:2] for k, x in enumerate(data) if k % 5 != 4]
    model = _fitted(lambda now, labelled_by, again, epoch: _epoch(fit, now, labelled_by, epoch, (SEED, again, epoch)))
    held = data[4::5] or data
    steps = [int(content_share(c, s, model["table"], model["move"]) * STEPS) for q, c, s in held if q == 1 and sum(s) >= MIN_WORDS]
    return model | {"least": _least([(k, 1) for k in steps])}


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [line_codes(text.as_py().split(b"\n")) for text in b.column("text")]
        lines = pa.list_(pa.int32())
        yield pa.record_batch([b.column("doc_id"), b.column("mark"), pa.array([m[0] for m in made], lines), pa.array([m[2] for m in made], lines)], names=["doc_id", "mark", "codes", "sizes"])


def fit_lines(docs: DataFrame, labels: DataFrame, part: int = PART) -> dict | None:
    """A line model from labelled documents (doc_id, text) and (doc_id, quality); None if there are none.

    All of them are fitted on: they are dealt by hash into parts of about `part`
    documents, each part makes its steps from the model of the epoch before, and
    the parts' models are averaged by their numbers of documents. A fifth of the
    documents is set aside, on whose good ones the share is set that KEPT_GOOD
    of them reach; those with so few words that the base rules fail them don't
    count there. Of the rows of one id, one counts, and of several labels the
    highest. Texts become line codes before rows meet, so no text is shuffled.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    lined = texts.mapInArrow(_lined, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, codes array<int>, sizes array<int>")
    lined = lined.where("exists(sizes, n -> n > 0)").join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("mark", "codes", "sizes")).alias("m"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 4
    data = stored(lined.select("quality", F.xxhash64("doc_id").alias("rank"), aside.alias("aside"), "m.codes", "m.sizes"), "quality-lines")
    n = {r["aside"]: r["n"] for r in data.groupBy("aside").agg(F.count("*").alias("n")).collect()}
    if not n:
        drop_stored(data)
        return None
    parts = max(1, round(n.get(False, 0) / part))
    fit = data.where("not aside").select(F.pmod("rank", F.lit(parts)).alias("part"), "rank", "quality", "codes")

    def step(now, labelled_by, again, epoch):
        def run(table: pa.Table) -> pa.Table:
            own = table.sort_by("rank")
            rows = list(zip(own.column("quality").to_pylist(), own.column("codes").to_pylist()))
            made = _epoch(rows, now, labelled_by, epoch, (SEED, again, epoch))
            return pa.table({"part": own.column("part")[:1], "n": [len(rows)], "model": [np.concatenate([m.ravel() for m in made]).tolist()]})

        got = fit.groupBy("part").applyInArrow(run, "part long, n long, model array<double>").collect()  # a short row a part
        got.sort()
        if not got:
            return now
        flat = np.average([r["model"] for r in got], axis=0, weights=[r["n"] for r in got])
        return flat[: now[0].size].reshape(now[0].shape), flat[now[0].size :].reshape(2, 2)

    model = _fitted(step)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [int(content_share(c, s, model["table"], model["move"]) * STEPS) for c, s in zip(b.column("codes").to_pylist(), b.column("sizes").to_pylist())]
            yield pa.record_batch([pa.array(found, pa.int64())], names=["step"])

    held = data.where("aside" if n.get(True) else "true").where("quality = 1").where(F.aggregate("sizes", F.lit(0), lambda n, m: n + m) >= MIN_WORDS).select("codes", "sizes")
    model["least"] = _least([(r["step"], r["count"]) for r in held.mapInArrow(shares, "step long").groupBy("step").count().collect()])  # at most STEPS + 1 rows
    drop_stored(data)
    return model


def _judge(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, value in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = value.as_py() or b""
                words = text.split()
                codes, repeats, sizes = line_codes(text.split(b"\n"))
                spoken = text.translate(None, SPACES)
                again = repeated_words(words)
                failed = len(words) < MIN_WORDS or 100 * again > MAX_REPEATED_PERCENT * len(words)
                share = content_share(codes, sizes, model["table"], model["move"]) if model else 1.0
                kept = not failed and (model is None or share >= model["least"])
                out.append((doc_id, len(words), len(spoken.decode(errors="replace")), len(text) - len(text.translate(None, SYMBOLS)), repeats, again, failed, kept, share))
            types = (*[pa.int64()] * 6, pa.bool_(), pa.bool_(), pa.float64())
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return run


def judge_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """Counts, the base rules' verdict, and the line model's verdict on each document.

    kept is false if the base rules fail the text, else whether the share of
    its words in content lines reaches the model's threshold. Null texts count
    as empty (and fail, having no words). Repeated rows and null ids stay rows,
    each judged by its own text, so ties don't arise; an empty table gives no
    rows. Without a model only the base rules decide; whole texts are read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_judge(model), RESULT)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_quality(docs, fit_lines(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
