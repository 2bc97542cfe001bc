"""Audit chains longer than a round: the same hashes and numbers as in one pass."""

from pyspark.sql import functions as F

from parlance.operators import governance as G

ROWS = [(c, k * step, None if k % 5 == 0 else f"b{k}") for c, n, step in (("long", 40, 1), ("sparse", 9, 1000), (None, 12, 3), ("one", 1, 7)) for k in range(1, n + 1)] + [("long", 7, "again"), ("sparse", None, "no number")]


def _hashes(rows):
    out, last = [], {}
    for c, k, body in sorted(((c, k, b or "") for c, k, b in rows), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        prev = last.get(c, G.GENESIS)
        last[c] = G._entry(prev, k, body)
        out.append((c, k, body, prev, last[c]))
    return sorted(out, key=repr)


def test_rounds_give_the_hashes_of_one_pass(spark, monkeypatch):
    rows = spark.createDataFrame(ROWS, "chain string, seq_no long, body string").repartition(5)
    assert sorted(map(tuple, G.chained(rows).collect()), key=repr) == _hashes(ROWS)
    monkeypatch.setattr(G, "PART", 6)
    read, plain = [], G._linked
    monkeypatch.setattr(G, "_linked", lambda part, ends: read.append(part.where("body is not null").count()) or plain(part, ends))
    assert sorted(map(tuple, G.chained(rows).collect()), key=repr) == _hashes(ROWS)
    assert len(read) > 5 and max(read) <= 12 and sum(read) == len(ROWS)  # no round holds much more than PART rows


def test_numbers_over_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "PART", 6)
    ids = [(c, k) for c, n in (("a", 30), ("b", 8), (None, 5)) for k in range(n * 3, 0, -3)]
    rows, parts = G.numbered(spark.createDataFrame(ids, "key string, id long").repartition(4), "key", "id")
    assert parts > 4 and {tuple(r) for r in rows.select("key", "id", "seq_no").collect()} == {(c, k, k // 3) for c, k in ids} and rows.count() == len(ids)
    biggest = rows.groupBy("part").count().agg(F.max("count")).first()[0]
    assert biggest <= 12


def test_status_without_heads(spark):
    chain = G.chained(spark.createDataFrame([(c, k, "x") for c in ("s", "t", None) for k in range(1, 6)], "chain string, seq_no long, body string")).where("seq_no <> 3 or chain = 's'")
    status = {r["chain"]: tuple(r) for r in G.chain_status(chain).collect()}
    heads = {(r["chain"], r["seq_no"]): r["entry_hash"] for r in chain.collect()}
    assert status["s"] == ("s", 5, True, None, None, heads["s", 5]) and status["t"] == ("t", 4, False, 4, "gap", heads["t", 2])
    assert {r["chain"]: tuple(r) for r in G.chain_status(chain, heads=False).collect()} == {c: r[:-1] for c, r in status.items()}
