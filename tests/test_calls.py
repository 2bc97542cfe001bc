"""Calls as they close, over tables and streams; summaries, each once; and files that keep one copy."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.operators.calls import EVENTS, closed_calls
from parlance.sources.segments import SegmentLog
from parlance.sources.summary_store import SummaryStore
from parlance.streaming.calls import calls_stream
from parlance.streaming.summaries import SummaryWorker

T0 = datetime(2024, 1, 1)
NAMES = [f.split()[0] for f in EVENTS.split(", ")]


def _events(seed, sessions, n):
    rng, rows = random.Random(seed), []
    for k in range(n):
        kind = rng.choices(["utterance", "bot", "closed"], [40, 5, 1])[0]
        rows.append({"session_id": f"s{rng.randrange(sessions)}", "tenant_id": "t", "seq": k, "kind": kind, "channel": rng.choice(["customer", "agent", None]), "speaker_id": rng.choice([None, "", "kim"]),
                     "text": rng.choice([None, " ", "hello", "hello", " pay now "]), "is_final": rng.choice([True, True, True, True, False, None]), "pii_masked": rng.choice([True, False, None]),
                     "rule_ids": rng.choice([None, [], ["r1"], ["r2", "r1", "r2"], ["r3", "r1"]]), "handed_off": rng.choice([None, False, False, True])})
    return rows


@pytest.fixture
def run(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(batches, **limits):
        source, out = tmp_path / "in", f"file://{tmp_path}/out"
        source.mkdir()
        for k, rows in enumerate(batches):
            file = source / f"{k:03d}.json"
            file.write_text("\n".join(json.dumps(r | {"ts": str(T0 + timedelta(seconds=r["seq"]))}) for r in rows))
            os.utime(file, (1e9 + k, 1e9 + k))
        stream = spark.readStream.schema(f"{EVENTS}, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        made = calls_stream(stream, **limits)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.schema(made.schema).parquet(out)

    yield go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _plain(rows):
    return sorted(repr(r.asDict(True)) for r in rows)


def _first_calls(rows):
    """Events up to each session's first closing: later ones are other calls."""
    closed, out = set(), []
    for r in rows:
        if r["session_id"] not in closed:
            out.append(r)
        if r["kind"] == "closed":
            closed.add(r["session_id"])
    return out


@pytest.mark.parametrize("cuts", [[], [40, 41, 150], list(range(15, 300, 15))])
def test_stream_equals_table(spark, run, cuts):
    rows = _first_calls(_events(0, 6, 300))
    got = run([p for a, b in zip([0, *cuts], [*cuts, 300]) if (p := rows[a:b])], shards=3, most_turns=6)
    table = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], EVENTS)
    want = closed_calls(table, 6).collect()
    assert _plain(got.collect()) == _plain(want)
    assert any(r["truncated"] for r in want) and any(r["handed_off"] for r in want) and any(r["rule_hits"][:2] == ["r2", "r1"] for r in want)


def test_the_oldest_open_call_goes(spark, run):
    say = lambda s, k, kind="utterance": dict.fromkeys(NAMES) | {"session_id": s, "tenant_id": "t", "seq": k, "kind": kind, "text": "x", "is_final": True}
    batches = [[say("a", 1), say("b", 2)], [say("c", 3), say("b", 4)], [say("a", 5, "closed"), say("b", 6, "closed"), say("c", 7, "closed")]]
    got = {r["session_id"]: r["utterances"] for r in run(batches, shards=1, most_open=2).collect()}
    assert got == {"a": 0, "b": 2, "c": 1} or got == {"a": 0, "b": 0, "c": 1}  # a was dropped for c; its closing opens and ends an empty call
    assert got["c"] == 1


def _answers(calls):
    def complete(rows):
        calls.append(rows.count())
        raw = F.when(F.col("session_id") == "empty", "{}").when(F.col("session_id") == "broken", "no json").when(F.col("profile") == "meeting", '{"title": "t"}').otherwise('{"category": "c", "resolution": "done"}')
        return rows.where("session_id <> 'lost'").select("session_id", F.when(F.col("session_id") != "error", raw).alias("raw"), F.when(F.col("session_id") == "error", "time out").alias("error"))

    return complete


ENDED = "session_id string, tenant_id string, profile string, transcript string"


def test_summaries_and_announcements_come_once(spark, tmp_path):
    ended = [("good", "t", "call", "a: b"), ("meet", "t", "meeting", "a: b"), ("silent", "t", "call", " "), ("nothing", "t", "call", None), ("empty", "t", "call", "x"), ("broken", "t", "meeting", "x"), ("error", "t", "call", "x"), ("lost", "t", "call", "x")]
    calls: list[int] = []
    worker = SummaryWorker(spark, f"file://{tmp_path}/s", _answers(calls))
    rows = spark.createDataFrame(ended, ENDED)
    append, worker.log.append = worker.log.append, None

    def dies(tables, removed=None, work=None, **k):  # the job ends between the waiting states and the results
        if work and not work.endswith("-waiting"):
            raise RuntimeError("killed")
        return append(tables, removed, work, **k)

    worker.log.append = dies
    with pytest.raises(RuntimeError):
        worker.batch(rows, 7)
    assert {r["session_id"]: r["status"] for r in worker.summaries().collect()} == {k: "waiting" for k, _, _, t in ended if (t or "").strip()} and worker.announced() is None
    worker.log.append = append
    worker.batch(rows, 7)  # the restart
    worker.batch(rows, 7)  # and a batch that is done again
    got = {r["session_id"]: (r["status"], r["error"], r["summary"]) for r in worker.summaries().collect()}
    assert {k: s for k, (s, *_) in got.items()} == {"good": "ready", "meet": "ready", "silent": "ready", "nothing": "ready", "empty": "failed", "broken": "failed", "error": "failed", "lost": "failed"}
    assert json.loads(got["good"][2])["resolution"] == "done" and json.loads(got["meet"][2])["title"] == "t" and got["error"][1] == "time out" and got["silent"][2] is None
    assert sorted(r["session_id"] for r in worker.announced().collect()) == sorted(k for k, *_ in ended) and calls == [6, 6]
    assert "summary" not in worker.announced().columns


def test_a_stream_of_ended_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"session_id": f"s{k}", "tenant_id": "t", "profile": "call", "transcript": "x"}))
    worker = SummaryWorker(spark, f"file://{tmp_path}/s", _answers([]))
    stream = lambda: spark.readStream.schema(ENDED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    worker.start(stream(), f"file://{tmp_path}/c").awaitTermination(120)
    (tmp_path / "in" / "9.json").write_text(json.dumps({"session_id": "s9", "tenant_id": "t", "profile": "call", "transcript": "x"}))
    worker.start(stream(), f"file://{tmp_path}/c").awaitTermination(120)
    assert sorted(r["session_id"] for r in worker.announced().collect()) == ["s0", "s1", "s2", "s9"]
    assert isinstance(worker.log, SegmentLog) and worker.summaries().where("status = 'ready'").count() == 4


SUMMARY = "tenant_id string, session_id string, created_at timestamp, text string"


def _days(path):
    return {(p.parent.parent.name.split("=")[1], p.parent.name.split("=")[1]) for p in path.glob("rows/tenant_id=*/day=*/*.parquet")}


def test_a_moved_day_leaves_one_copy(spark, tmp_path):
    at = lambda d, h=1: datetime(2024, 3, d, h)
    store = SummaryStore(spark, f"file://{tmp_path}/store")
    put = lambda *rows: store.put(spark.createDataFrame(rows, SUMMARY))
    assert store.rows() is None and store.index().count() == 0
    put(("01", "a", at(1), "a1"), ("01", "b", at(1), "b1"), ("y", "a", at(1), "other tenant's"), ("01", "c", at(2), "c1"))
    put(("01", "a", at(3), "a2"), ("01", "c", at(3), "c2"))
    every = {(r["tenant_id"], r["session_id"], r["text"], r["day"]) for r in store._all().collect()}  # what is in the files, not what a reader picks
    assert every == {("01", "a", "a2", "2024-03-03"), ("01", "b", "b1", "2024-03-01"), ("y", "a", "other tenant's", "2024-03-01"), ("01", "c", "c2", "2024-03-03")}
    assert _days(tmp_path / "store") == {("01", "2024-03-01"), ("01", "2024-03-03"), ("y", "2024-03-01")}  # the day that c left is gone
    assert {(r["tenant_id"], r["session_id"], r["day"]) for r in store.index().collect()} == {(t, s, d) for t, s, _, d in every}
    asked = spark.createDataFrame([("01", "a"), ("01", "zz")], "tenant_id string, session_id string")
    assert [r["text"] for r in store.get(asked).collect()] == ["a2"]
    assert store.delete(asked) == 1 and {r["session_id"] for r in store.rows().where("tenant_id = '01'").collect()} == {"b", "c"}
    assert store.purge(F.lit("2024-03-05").cast("date"), 0) == 0 and store.purge(F.lit("2024-03-05").cast("date"), 3) == 2
    assert {r["session_id"] for r in store.rows().collect()} == {"c"} == {r["session_id"] for r in store.index().collect()}


def test_a_put_that_died_is_mended(spark, tmp_path):
    store = SummaryStore(spark, f"file://{tmp_path}/store")
    store.put(spark.createDataFrame([("t", "a", datetime(2024, 3, 1), "old"), ("t", "b", datetime(2024, 3, 1), "b")], SUMMARY))
    store._overwrite(spark.createDataFrame([("t", "a", datetime(2024, 3, 2), "new", "2024-03-02")], f"{SUMMARY}, day string"))  # the new day is written, the old one not yet
    assert {r["session_id"]: r["text"] for r in store.rows().collect()} == {"a": "new", "b": "b"}
    assert store.rebuild() == 2 and sorted(r["text"] for r in store._all().collect()) == ["b", "new"]
