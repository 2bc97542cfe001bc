"""The training-data operators against brute force, over the small tables and over odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm.langid import identify
from parlance.llm.lm import op7_lm_scores, score_texts
from parlance.llm.mixing import mix, pivot, targets
from parlance.llm.ngram_join import ngram_components
from parlance.llm.packing import op2_best_fit_packing, pack_documents, plan_patterns
from parlance.llm.pii import KINDS, find_pii, op3_pii
from parlance.llm.quality import judge_quality, op5_quality_rules
from parlance.llm.tokens import op6_token_counts, token_counts
from parlance.llm.topk import Lists, quantized, search_block, top_k
from parlance.llm.warc import op8_warc, read_warc, write_warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"
ODD = [
    (1, None, None, None, None, 9), (2, "", "en", "a", 0, 9), (None, "a b c d e f", "en", None, 1, 9), (3, "a b c d e f", "en", "a", 1, 9), (3, "a b c d e f", "en", "a", 1, 9),
    (4, "word " * 20_000 + "end", "en", "b", 1, 9), (5, "mail x@y.zz or 10.0.0.256 or +1 (555) 123-4567", "en", "b", 1, 9), (6, "\n\n \t", "fr", "b", 1, 9), (7, "é" * 3000, "fr", "c", 1, 9),
]


#: Names that the operators use inside; a table may have columns of these names.
CLASHING = "h n node gram copies block unit lang_pred score spans base has_letter rank v content shard row held_out held words counts digest n_tokens length bucket piece start owner component family part parts pass p target".split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def _near_copies(seed, families, most, length):
    """Families of texts in which each differs from another by a few words, and texts that only share passages."""
    rng, out = np.random.default_rng(seed), []
    for f in range(families):
        first = [f"f{f}w{i}" for i in range(length)]
        family = [first]
        for k in range(int(rng.integers(1, most))):
            new = list(family[int(rng.integers(len(family)))])
            for at in rng.integers(0, length, 2):
                new[at] = f"f{f}k{k}a{at}"
            family.append(new)
        out += [" ".join(w) for w in family]
    return out + [f"{out[0][:200]} other{k} " + " ".join(f"o{k}x{i}" for i in range(60)) for k in range(40)]


def _brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORDS.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    name, links = list(range(len(rows))), [0] * len(rows)
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * (o := len(x & y)) >= 80 * (len(x) + len(y) - o):
                links[i] += 1
                links[j] += 1
                if name[i] != name[j]:
                    old, new = name[i], name[j]
                    name = [new if n == old else n for n in name]
    least = {}
    for (k, *_), n in zip(rows, name):
        if k is not None:
            least[n] = min(least.get(n, k), k)
    return sorted(repr((rows[i][0], len(s), least.get(name[i]), links[i])) for i, s in enumerate(sets))


@pytest.mark.parametrize("limits", [{}, {"small": 3, "group_rows": 7, "family_nodes": 5, "family_grams": 2000, "broadcast_ids": 0}])
def test_components_and_links_by_brute_force(spark, odd, empty, limits):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [base, base + " x", base.replace("w50", "y"), base.replace("w50", "y").replace("w20", "z"), "one two", "one two", "other " * 9, None, base.upper(), ""]
    rows = [(k, t, None, None, None, 0) for k, t in enumerate([*rows, *_near_copies(1, 12, 40, 90), *_near_copies(2, 3, 30, 300)])]
    rows += [(None, base, None, None, None, 0), (None, "no id here at all either", None, None, None, 0), (None, "no id here at all either", None, None, None, 0), (3, "an id again with another text", None, None, None, 0)]
    got = ngram_components(spark.createDataFrame(rows, SCHEMA).repartition(5), **limits).collect()
    assert sorted(repr(tuple(r)) for r in got) == _brute_components(rows)
    assert sorted(repr(tuple(r)) for r in ngram_components(odd, **limits).collect()) == _brute_components(ODD)
    assert ngram_components(empty, **limits).count() == 0


def test_linked_pairs_in_many_fragments(monkeypatch):
    from parlance.llm import ngram_join

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 380, replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)]) for _ in range(30)]
    want = np.array([[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]) & ~np.eye(30, dtype=bool)
    for cells in (4_000_000, 900):
        monkeypatch.setattr(ngram_join, "_CELLS", cells)
        assert (ngram_join.linked_pairs(sets, None, 80) == want).all() and (ngram_join.linked_pairs(sets[:9], sets[9:], 80) == want[:9, 9:]).all()
    assert 0 < want.sum() < want.size


def _check_packing(rows, docs):
    tok, pieces, places = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in docs.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        mine = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 1024)))
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places)


def test_coder_equals_the_library():
    import random

    from parlance.llm.tokens import Coder

    tok, coder, rng = Tokenizer.from_file(PATH), Coder(PATH), random.Random(7)
    assert coder.fast is not None
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    texts = [f"a{chr(c)}{chr(c)}b 1{chr(c)}1 {chr(c)} .{chr(c)}." for c in points]
    letters = "abcdefghijklmnopqrstuvwxyz" * 2 + "'''   \n\n\t.,;!?-_()<|>ETAOIN0123456789éß한글日本\u3000\u2009\u0301🎉\x00"
    texts += ["".join(rng.choice(letters) for _ in range(rng.choice([3, 8, 30, 300]))) for _ in range(20_000)]
    texts += ["", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "<|endoftext", " " * 50_000 + "x", "\n" * 3000, "é" * 3000, "don't DON'T we'll", "word " * 30_000, " " * 2_000_000 + "x"]
    for text, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert coder.ids(text) == np.array(want.ids, "<u4").tobytes(), text[:80]
    coder.fast = None
    assert all(coder.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[-9:-1])


def test_packing_round_trip(spark, small, texts, odd, empty):
    rows = op2_best_fit_packing(spark, small).collect()
    used = _check_packing(rows, texts)
    assert used <= math.ceil(sum(r["length"] for r in rows) / 1024) * 1.02 + 1
    assert pack_documents(odd, PATH).where("doc_id = 3").count() == 2
    assert pack_documents(empty, PATH).count() == 0
    assert plan_patterns({600: 2, 424: 1, 200: 2, 224: 1}, 1024)[0] == ((600, 424), 1)


def _luhn(digits):
    return sum((d if i % 2 == 0 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and _luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_by_brute_force(spark, small, texts, odd, empty):
    for r in op3_pii(spark, small).collect():
        spans = base_spans(texts[r["doc_id"]])
        listed = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert not listed or set(listed) <= set(r["spans"].split(","))
    got = [(r["doc_id"], [tuple(s) for s in r["base"]]) for r in find_pii(odd, None, "doc_id").collect()]
    assert sorted(map(repr, got)) == sorted(repr((row[0], base_spans(row[1] or ""))) for row in ODD)
    assert find_pii(empty, None, "doc_id").count() == 0


def _brute_top(rows, k=20):
    """query -> (rank, vec_id, score), with Python's integers."""
    q = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows]
    asks = {}
    for i, v in q:
        if i % 20 == 0:
            asks[i] = min(asks.get(i, v), v)
    best = {i: sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i))[:k] for i, v in asks.items()}
    return sorted((i, r + 1, j, -s) for i, found in best.items() for r, (s, j) in enumerate(found))


@pytest.mark.parametrize("count, dims, deviation", [(300, 8, 0.3), (400, 768, 10.0), (120, 16, 600.0), (90, 4, 1e6), (60, 3, 1.2e7), (30, 5, 1.0)])
def test_top_k_by_brute_force(spark, count, dims, deviation):
    rng = np.random.default_rng(count)
    vectors = np.round(rng.normal(0, deviation, (count, dims)), 1).tolist()
    vectors[3], vectors[7], vectors[5] = vectors[20 % count], vectors[20 % count], [0.0] * dims  # ties, and a query's copy
    rows = [(k, v, 0) for k, v in enumerate(vectors)] + [(9, vectors[1], 0), (20, vectors[2], 0), (9, vectors[9], 0)]
    odd_rows = [(1000, None, 0), (1001, [1.0] * (dims - 1) + [None], 0), (1002, [float("nan")] * dims, 0), (1020, [float("inf")] * dims, 0), (None, vectors[0], 0)]
    table = quantized(spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>, score int").repartition(3))
    for limits in ({}, {"cells": 50 * dims, "per_block": 4}):
        got = top_k(table, table.where("vec_id % 20 = 0"), **limits).collect()
        assert sorted(tuple(r) for r in got) == _brute_top(rows)


def test_top_k_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, rank int"
    none = quantized(spark.createDataFrame([], schema))
    one = quantized(spark.createDataFrame([(0, [1.0, 2.0], 1)], schema))
    assert top_k(none, none).count() == 0 and top_k(one, one).count() == 0 and top_k(none, one).count() == 0
    uneven = quantized(spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0], 1)], schema).coalesce(1))
    huge = quantized(spark.createDataFrame([(0, [1e9, 1e9], 1), (1, [1e9, 1e9], 1)], schema))
    for bad in (lambda: top_k(uneven, uneven).collect(), lambda: top_k(huge, huge).collect(), lambda: quantized(spark.createDataFrame([(0, [3e38], 1)], schema)).collect()):
        with pytest.raises(Exception, match="components|64-bit"):
            bad()


def test_top_k_stops_early():
    rng = np.random.default_rng(5)
    x = np.zeros((5000, 16), np.int64)
    x[:, :2] = rng.integers(-1000, 1000, (5000, 2))
    x[:, 2:] = rng.integers(-2, 3, (5000, 14))
    lists, read = Lists(np.arange(5000), x), []
    original = lists.read
    lists.read = lambda start, end, kind: read.append((start, end)) or original(start, end, kind)
    for (ids, score), q in zip(search_block(lists, np.array([-1, 7]), x[[0, 7]], 20), (0, 7)):
        want = sorted((i for i in range(5000) if q != 7 or i != 7), key=lambda i: (-int(x[i] @ x[q]), i))[:20]
        assert ids.tolist() == want and score.tolist() == [int(x[i] @ x[q]) for i in want]
    assert len(read) == 2  # the first bounds decided; the rest was read once, for those in doubt


def test_quality_base_by_brute_force(spark, small, texts, odd, empty):
    for r in op5_quality_rules(spark, small).collect():
        t = texts[r["doc_id"]]
        w = WORDS.findall(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            dup += bool(WORDS.search(line)) and line in seen
            seen.add(line)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), failed)
        assert not (failed and r["kept"])
    assert judge_quality(odd, None).count() == len(ODD) and judge_quality(empty, None).count() == 0


def test_viterbi_by_enumeration():
    from itertools import product

    from parlance.llm.quality import viterbi

    rng = np.random.default_rng(2)
    for n in range(1, 9):
        table, move = [tuple(r) for r in rng.normal(0, 1, (4, 2)).tolist()], rng.normal(0, 1, (2, 2))
        codes = rng.integers(0, 4, n).tolist()
        score = lambda y: sum(table[c][k] for c, k in zip(codes, y)) + sum(move[a, b] for a, b in zip(y, y[1:]))
        assert tuple(viterbi(codes, table, move)) == max(product((0, 1), repeat=n), key=score)


def test_quality_verdicts_on_documents_set_aside(spark, small):
    from parlance.llm.quality import content_share, line_codes, train

    rows = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.1')}/labels.parquet").join(spark.read.parquet(f"{small.replace('sf0.001', 'sf0.1')}/documents.parquet"), "doc_id").where("text is not null and quality is not null")
    rows = [(r["quality"], r["text"].encode()) for r in rows.orderBy(F.xxhash64("doc_id")).select("quality", "text").collect()]
    model = train(rows[:1500])
    passed = [(q, content_share(*(line_codes(t.split(b"\n"))[k] for k in (0, 2)), model["table"], model["move"]) >= model["least"]) for q, t in rows[1500:] if t.split()]
    assert sum(ok for q, ok in passed if q == 1) >= 0.99 * sum(q == 1 for q, _ in passed)
    assert sum(ok for q, ok in passed if q == 0) <= 0.4 * sum(q == 0 for q, _ in passed)


def test_line_model_counts_an_id_once(spark, small):
    """Rows that share an id add nothing to what the model is fitted on, however many there are."""
    from parlance.llm.quality import fit_lines

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    once = fit_lines(docs, labels)
    again = fit_lines(docs.unionByName(docs).unionByName(docs.where("doc_id % 2 = 0")), labels.unionByName(labels))
    assert once["least"] == again["least"] and np.array_equal(once["table"], again["table"]) and np.array_equal(once["move"], again["move"])


def test_line_model_sees_every_labelled_document(spark):
    """Each labelled document counts, however many parts they make: what only those beyond the first 2,000 by hash tell is learned."""
    from parlance.llm.quality import content_share, fit_lines, line_codes

    plain, odd = "This is a line of plain words that goes on. " * 6, "99 11 22 33 44 55 66 77"
    rank = F.row_number().over(Window.orderBy(F.xxhash64("doc_id")))
    labels = spark.range(6000).select(F.col("id").alias("doc_id")).withColumn("late", rank > 2000).select("doc_id", "late", F.when(F.col("late"), F.col("doc_id") % 2).otherwise(1).cast("int").alias("quality"))
    docs = labels.select("doc_id", F.when(F.col("late") & (F.col("quality") == 0), odd).otherwise(plain).alias("text"))
    model = fit_lines(docs, labels.drop("late"), 700)
    share = lambda text: content_share(*(line_codes(text.encode().split(b"\n"))[k] for k in (0, 2)), model["table"], model["move"])
    assert share(plain) >= model["least"] > share(odd)


def test_token_counts_and_cache(spark, small, texts, odd, empty, tmp_path):
    tok = Tokenizer.from_file(PATH)
    for r in op6_token_counts(spark, small).collect():
        n = len(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)
    cache = f"file://{tmp_path}/cache"
    first = {repr(tuple(r)) for r in token_counts(odd, PATH, cache).collect()}
    stored = spark.read.parquet(cache).count()
    assert {repr(tuple(r)) for r in token_counts(odd, PATH, cache).collect()} == first and spark.read.parquet(cache).count() == stored
    assert token_counts(empty, PATH, cache).count() == 0


def test_language_model_base_and_gain(spark, small, texts, odd, empty):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    tokens = {d: [*WORDS.findall(lower(t)), None] for d, t in texts.items()}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = op7_lm_scores(spark, small).collect()
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
    assert score_texts(odd, F.lit(False)).count() == len(ODD) and score_texts(empty, F.lit(False)).count() == 0


def test_language_model_sums_to_one():
    from parlance.llm import lm

    rng = np.random.default_rng(4)
    words = rng.integers(-(1 << 62), 1 << 62, 900)
    counts = np.sort(rng.zipf(1.5, 900) % 500 + 1)[::-1]
    top, total = list(zip(words[:256].tolist(), counts[:256].tolist())), int(counts.sum())
    rest = {g: (int(counts[256:][mine].sum()), int(mine.sum())) for g in range(lm.GROUPS) for mine in [words[256:] & (lm.GROUPS - 1) == g]}
    model = lm.Model(top, total, 900, rest)
    for factor in (model.classes, model.members, model.groups):
        factor.w[:] = rng.normal(0, 0.5, factor.w.shape)
    unknown = np.arange(lm.GROUPS) + (1 << 40)  # a word of each group that training doesn't have
    every, n = np.r_[words, unknown], np.r_[counts, np.zeros(lm.GROUPS, int)]
    position = model.positions(every.view(np.uint64))
    for one, two in ((3, 9), (1 << 50, 77)):
        f = lm.features(np.full(len(every), one, np.uint64), np.full(len(every), two, np.uint64))
        assert (10 ** model.log10(position, f, n)).sum() == pytest.approx(1, abs=2e-4)


def test_language_model_steps_do_not_overshoot():
    """A word that is rare in all but follows half the times after a frequent one: no update may make the other half unlikely."""
    from parlance.llm import lm

    factor = lm.Factor(np.array([[0.99, 0.0099, 0.0001]]), 4, 0)
    f, kind = np.zeros((10_000, lm.FEATURES), np.uint64), np.zeros(10_000, np.int64)
    chosen = np.repeat([0, 2], 5_000)
    likely = lambda: np.log10(np.maximum(1e-300, factor.chances(f, kind)[1][np.arange(10_000), chosen].astype(float))).mean()
    before = likely()
    for _ in range(lm.ROUNDS):
        counts = factor.empty()
        factor.count(f, kind, chosen, counts)
        factor.update(counts)
        assert likely() > before
        before = likely()
    assert before > -0.4


def test_language_model_learns_rare_words(spark):
    """A word outside the frequent classes is expected where its context says so."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"c{rng.integers(300)}" for _ in range(20)) + (" before rare" if k % 3 == 0 else " other thing"), None, None, None, 0) for k in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = score_texts(docs, F.col("doc_id") % 10 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_language_model_odd_ids(spark):
    rows = spark.createDataFrame([(-(1 << 63), "a b"), (None, "a"), (None, None), (0, "b"), (0, "b")], "doc_id long, text string")
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in score_texts(rows, F.lit(False)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(-(1 << 63), 3, 3, 10), (None, 2, 2, 10), (None, 1, 1, 10), (0, 2, 2, 10), (0, 2, 2, 10)]))
    assert {r["n_known"] for r in score_texts(rows, F.lit(True)).collect()} == {0}


def _brute_warc(pages):
    newest = {}
    for page_id, _, html in pages:
        if page_id is not None:
            newest[html or ""] = max(newest.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in pages:
        data, last = (html or "").encode(), newest.get(html or "")
        to = last if page_id is not None and page_id < last else None
        out.append(repr((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to)))
    return sorted(out)


def test_warc_query_by_brute_force(spark, small):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in op8_warc(spark, small).collect()) == _brute_warc(pages)


def test_warc_of_hot_and_null_ids(spark, tmp_path):
    pages = [(7, f"u{k}", f"x{k}" * 300) for k in range(60)] + [(None, f"n{k}", f"y{k}" * 300) for k in range(40)] + [(k, "u", "same") for k in range(20)] + [(k, "u", f"z{k % 9}" * 50) for k in range(100, 300)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("shard", F.lit(1)).withColumn("content", F.lit(2))
    for k, limits in enumerate(({}, {"broadcast_rows": 0})):
        manifest = write_warc(rows, f"file://{tmp_path}/{k}", roll_bytes=2000, shard_bytes=8000, **limits)
        got = read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(repr(tuple(r)) for r in got) == _brute_warc(pages)
        files = manifest.collect()
        assert len({f["shard"] for f in files}) > 3 and max(f["slice"] for f in files) > 0 and sum(f["records"] for f in files) == len(pages) and not list((tmp_path / str(k)).glob(".shard-*.gz.*"))
    assert [r["sha256"] for r in spark.read.parquet(f"file://{tmp_path}/0/manifest").orderBy("path").collect()] == [r["sha256"] for r in spark.read.parquet(f"file://{tmp_path}/1/manifest").orderBy("path").collect()]


@pytest.mark.parametrize("far", [[1 << 62], [-(1 << 63), (1 << 63) - 1], [10**k for k in range(3, 19)], [(1 << 40) + k for k in range(500)]])
def test_warc_shards_are_even_for_any_ids(spark, tmp_path, far):
    """Ids spread wide, or in clusters far apart: no shard gets much more than its bytes, and reruns give equal files."""
    pages = [(k, f"u{k}", f"{k} " * 300) for k in [*range(1000), *far]]
    rows = spark.createDataFrame([*pages, (None, "n", "y")], "page_id long, url string, html string").repartition(5)
    manifest = write_warc(rows, f"file://{tmp_path}/a", shard_bytes=8000)
    got = read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(repr(tuple(r)) for r in got) == _brute_warc([*pages, (None, "n", "y")])
    sizes = Counter()
    for f in manifest.collect():
        sizes[f["shard"]] += f["records"]
    assert len(sizes) > 100 and max(sizes.values()) <= 30
    digests = lambda at: [r["sha256"] for r in spark.read.parquet(f"file://{tmp_path}/{at}/manifest").orderBy("path").collect()]
    write_warc(rows.repartition(2), f"file://{tmp_path}/b", shard_bytes=8000)
    assert digests("a") == digests("b")


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, None, "same"), (5, "http://c", "same"), (3, "http://d", None), (4, "http://e", ""), (None, "http://f", "x" * 100_000)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in read_warc(write_warc(rows, f"file://{tmp_path}/a")).collect()}
    assert {k: r["refers_to"] for k, r in got.items()} == {1: 5, 2: 5, 5: None, 3: 4, 4: None, None: None}
    assert got[5]["payload"] == b"same" and got[1]["record_type"] == "revisit" and got[None]["payload_bytes"] == 100_000
    again = write_warc(rows, f"file://{tmp_path}/b")
    assert [r["sha256"] for r in again.collect()] == [r["sha256"] for r in spark.read.parquet(f"file://{tmp_path}/a/manifest").collect()]
    assert read_warc(write_warc(rows.limit(0), f"file://{tmp_path}/c")).count() == 0


def test_language_accuracy(spark, small, odd, empty):
    from parlance.llm.langid import fit_languages, op9_language_id

    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    rows = op9_language_id(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(known)
    for r in rows:
        lang, text = known[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    judged = [r["lang_pred"] == known[r["doc_id"]][0] for r in rows if r["held_out"] and r["lang_pred"] != "und" and known[r["doc_id"]][0] is not None]
    assert sum(judged) >= 0.95 * len(judged) > 0
    model = fit_languages(docs)
    # labels, sources and ids are no inputs: the same texts under others get the same answers
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("s").alias("source"))
    assert {(r["doc_id"] - 7, r["lang_pred"], r["score"]) for r in identify(other, model).collect()} == {tuple(r) for r in identify(docs, model).collect()}
    assert {r["lang_pred"] for r in identify(odd, None).collect()} == {"und"} and identify(empty, None).count() == 0 and identify(odd, model).count() == len(ODD)
    assert fit_languages(empty) is None


def _brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Water filling by steps of one source: the least full one per weight is capped first."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(spark, small, odd, empty, monkeypatch):
    from parlance.llm import mixing

    assert targets([("a", 100), ("b", 100), (None, 10)]) == pytest.approx({"a": 200.0, "b": 95.0, None: 20.0})
    p, left = pivot(np.full(10, 0.3), np.arange(10))
    assert set(np.round(np.delete(p, left), 9) if left >= 0 else p) <= {0.0, 1.0} and p.sum() == pytest.approx(3.0)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = docs.select("doc_id", "source", "text").collect()
    sizes = {}
    for r in texts:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORDS.findall(r["text"] or ""))
    want = _brute_targets(sizes)
    for rows_, fan in ((4096, 1024), (8, 3)):
        monkeypatch.setattr(mixing, "ROWS", rows_)
        monkeypatch.setattr(mixing, "FAN", fan)
        got = mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
        assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in texts)
        copies, count = {}, {}
        for r in got:
            rate = want[r["source"]] / sizes[r["source"]]
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            assert r["copies"] in (math.floor(rate), math.floor(rate) + 1) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
            copies[r["source"]] = copies.get(r["source"], 0) + r["copies"]
            count[r["source"]] = count.get(r["source"], 0) + 1
        for s, n in count.items():  # pivotal steps keep the sum of chances
            assert abs(copies[s] - n * want[s] / sizes[s]) < 1 + 1e-6
        again = sorted(map(repr, mix(docs.repartition(3)).select("doc_id", "taken").collect()))
        assert again == sorted(f"Row(doc_id={r['doc_id']}, taken={r['taken']})" for r in got)
    sums = mix(docs).groupBy("source_size", "target").agg({"taken": "sum", "size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 2 * r["max(size)"] for r in sums)
    assert mix(odd).count() == len(ODD) and mix(odd).where("taken > 2 * size").count() == 0 and mix(empty).count() == 0


def test_mixing_query_by_brute_force(spark, small):
    """The registered query: sizes, targets by water filling, and per source a sum of taken words near its target."""
    from parlance.llm.mixing import op10_source_mixing

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    size = {k: len(WORDS.findall(r["text"] or "")) for k, r in docs.items()}
    sizes = {}
    for k, r in docs.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[k]
    want, taken = _brute_targets(sizes), {}
    rows = op10_source_mixing(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[source]) and r["target"] == pytest.approx(want[source]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, n in taken.items():
        assert abs(n - want[source]) <= 2 * max(size[k] for k, r in docs.items() if r["source"] == source)
    assert sorted(map(repr, op10_source_mixing(spark, small).collect())) == sorted(map(repr, rows))


def test_pipeline_run(spark, small):
    """All stages, written and read again: whole documents in gapless sequences, each as often as the mix took it."""
    import corpus_pipeline as C

    rows = C.run(spark, small).collect()
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert rows and set(pieces) <= {r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    for own in pieces.values():
        copies = sum(p == 0 for p, *_ in own)
        assert all(sum(p == k for p, *_ in own) == copies for k in range(max(p for p, *_ in own) + 1)) and {s for p, s, _ in own if p == 0} == {0}


def test_pipeline_stages(spark, small):
    """Each stage on what its predecessor kept: rows in, rows out, whole texts."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{small}/documents.parquet")
    spoken = C.language_id(spark, docs, small)
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (docs, spoken))
    assert spoken.columns == list(C.COLUMNS) and all(tuple(r) == tuple(before[k][c] for c in C.COLUMNS) for k, r in after.items())
    assert all(not any(c.isalpha() for c in before[k]["text"] or "") or len(before[k]["text"]) < 60 for k in before.keys() - after.keys())

    clean = C.near_duplicates(spark, spoken, small)
    brute = _brute_components([(k, r["text"]) for k, r in after.items()])
    classes = {int(x[1:].split(",")[0]): int(x.split(",")[2]) for x in brute}
    worded = {k for k, r in after.items() if WORDS.search(r["text"] or "")}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k in after if k not in worded or classes[k] == k)

    hidden = {r["doc_id"]: r for r in C.personal_data(spark, clean, small).collect()}
    for k, r in hidden.items():
        assert r["n_chars"] == len(r["text"]) and not base_spans(r["text"])
        if not base_spans(after[k]["text"] or "") and not re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r["text"]):
            assert r["text"] == (after[k]["text"] or "")

    safe = spark.createDataFrame(list(hidden.values()), clean.schema)
    mixed, want = C.mixing(spark, safe, small).collect(), {r["doc_id"]: r["copies"] for r in mix(safe).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({k: n for k, n in want.items() if n})
    assert all(tuple(r) == tuple(hidden[r["doc_id"]]) for r in mixed)

    packed = C.packing(spark, spark.createDataFrame(mixed, clean.schema), small).collect()
    ids = Counter()
    for r in packed:
        ids[r["doc_id"]] += r["length"]
    tok = Tokenizer.from_file(PATH)
    assert ids == Counter({k: n * (len(tok.encode(hidden[k]["text"], add_special_tokens=False).ids) + 1) for k, n in want.items() if n})


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_of_odd_and_empty_tables(spark, odd, empty, stage):
    """No letters or no words, nulls in every column, repeats, clashing columns: a defined result, and no row lost by accident."""
    import corpus_pipeline as C

    assert C.STAGES[stage][1](spark, empty, "").count() == 0
    rows = C.STAGES[stage][1](spark, odd, "").collect()
    ids = Counter(r["doc_id"] for r in rows)
    if stage == 0:  # texts with letters stay: there is a model, since some rows have a language
        assert {k for k, t, *_ in ODD if any(map(str.isalpha, t or ""))} >= set(ids) and ids[3] in (0, 2)
    elif stage == 1:  # the copies under id 3 and under no id are one group, whose least id is 3; wordless texts stay
        assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1})
    elif stage == 2:
        assert ids == Counter(k for k, *_ in ODD) and {r["text"] for r in rows if r["doc_id"] == 1} == {""}
    elif stage == 3:
        assert sum(ids.values()) > 0 and max(ids.values()) <= 4 and all(r["text"] in {t for _, t, *_ in ODD} for r in rows)
    else:
        assert ids.keys() == {k for k, *_ in ODD} and sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
