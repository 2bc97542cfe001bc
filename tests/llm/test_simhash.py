"""SimHash fingerprints and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm.simhash import near_links, op13_simhash_dedup, segments, simhash_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints, bits=4):
    """A name for each place, by all pairs."""
    name = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if name[i] != name[j] and (prints[i] ^ prints[j]).bit_count() <= bits:
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    return name


def brute(docs):
    prints = [brute_print(t) for _, t in docs]
    least, name = {}, brute_components(prints)
    for (k, _), n in zip(docs, name):
        if k is not None:
            least[n] = min(least.get(n, k), k)
    return sorted(repr((k, f"{p:016x}", least.get(n))) for (k, _), p, n in zip(docs, prints, name))


def test_query_by_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = op13_simhash_dedup(spark, small)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(docs)


@pytest.mark.parametrize("limits", [{}, {"small": 2, "large": 5}])
def test_odd_rows(spark, limits):
    base = [f"w{k}" for k in range(120)]
    docs = [(1, None), (2, ""), (3, " \n\t"), (None, "one two three"), (None, "no id at all here"), (4, "One TWO three"), (5, "x"), (6, "é 日本 " * 2000), (7, "word " * 60_000 + "end"), (8, " ".join(base)), (8, " ".join(base)), (9, "w w w w w w")]
    rng = np.random.default_rng(3)
    for k in range(60):  # a chain of near copies, many texts apart
        w = list(base)
        for at in rng.integers(0, 120, 1 + k % 3):
            w[at] = f"k{k}"
        docs.append((100 + k, " ".join(w)))
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("print", "key", "component", "owner", "a", "b", "part")})
    assert sorted(repr(tuple(r)) for r in simhash_components(made, **limits).collect()) == brute(docs)
    assert simhash_components(made.limit(0), **limits).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 4, 7])
@pytest.mark.parametrize("limits", [{}, {"small": 3, "large": 1 << 20}, {"small": 2, "large": 9}])
def test_links_join_what_all_pairs_join(spark, bits, limits):
    rng = np.random.default_rng(bits)
    prints = {0, (1 << 64) - 1} | {int(x) for x in rng.integers(0, 1 << 63, 150)}
    for centre in list(prints)[:12]:  # clouds of 1 to 9 flipped bits
        for _ in range(int(rng.integers(5, 40))):
            prints.add(centre ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 10)), replace=False)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = near_links(spark.createDataFrame([(s,) for s in signed], "print long").repartition(4), bits, **limits).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1) for r in found)
    want, got, at = brute_components(prints, bits), list(range(len(prints))), {s: k for k, s in enumerate(signed)}
    for r in found:
        old, new = got[at[r["a"]]], got[at[r["b"]]]
        got = [new if x == old else x for x in got]
    first = lambda names: [names.index(x) for x in names]
    assert first(got) == first(want) and 1 < len(set(want)) < len(prints)


def test_segments_leave_one_bit_at_most():
    for bits in range(1, 12):
        cut = segments(bits)
        assert sum(w for _, w in cut) == 64 and bits < 2 * len(cut)
