"""Streams over small folders, run until all that is there has been read."""

import json
import os
from datetime import datetime, timedelta

import pytest

from parlance.streaming import sessions as S

T0 = datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    """Rows that a stream over a folder of JSON batches gives."""

    def go(batches, schema, f, mode="append"):
        source = tmp_path / "in"
        source.mkdir(exist_ok=True)
        for k, rows in enumerate(batches):
            file = source / f"{k:03d}.json"
            file.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, default=str) for r in rows))
            os.utime(file, (1e9 + k, 1e9 + k))  # files are read in order of their times
        out = f(S.event_source(spark, str(source), schema, files=1))
        query = out.writeStream.outputMode(mode).format("memory").queryName("q" + tmp_path.name.replace("-", "_")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        return spark.table("q" + tmp_path.name.replace("-", "_")).collect()

    return go


def _at(s):
    return T0 + timedelta(seconds=s)


def test_decodable_and_quarantine(run):
    got = run([[{"a": 1}, "no json"], [{"a": 2}]], "a int", S.decodable)
    assert sorted(r["a"] for r in got if r["a"] is not None) == [1, 2]


def test_barge_in_edges(run):
    frames = [[{"session_id": "s", "ts": _at(k), "speaking": v} for k, v in part] for part in ([(0, False), (1, True), (2, True)], [(3, True), (4, False), (5, True)])]
    got = run(frames, "session_id string, ts timestamp, speaking boolean", lambda s: S.barge_ins(S.decodable(s)))
    assert sorted(r["ts"] for r in got) == [_at(1), _at(5)]


def test_transcripts_end_by_close_or_idleness(run):
    turn = lambda s, t, text, final=True: {"session_id": s, "ts": _at(t), "kind": "turn", "speaker": "c", "text": text, "is_final": final}
    batches = [
        [turn("a", 2, "two"), turn("a", 1, "one"), turn("b", 1, "left alone"), turn("a", 3, "part", False), turn("a", 3, " ")],
        [turn("a", 4, "three"), {"session_id": "a", "ts": _at(5), "kind": "closed"}],
        [turn("c", 500, "late one")],
        [turn("c", 501, "more")],
        [turn("c", 502, "more")],
    ]
    got = {r["session_id"]: r for r in run(batches, "session_id string, ts timestamp, kind string, speaker string, text string, is_final boolean", lambda s: S.transcripts(S.decodable(s), most=2))}
    assert (got["a"]["transcript"], got["a"]["lines"], got["a"]["truncated"], got["a"]["reason"]) == ("c: one\nc: two", 2, True, "closed")
    assert (got["b"]["transcript"], got["b"]["truncated"], got["b"]["reason"]) == ("c: left alone", False, "idle") and "c" not in got


def test_states_of_summaries(spark):
    ended = spark.createDataFrame([("a", 0), ("b", 2), ("c", 2), ("d", 2), ("e", 1)], "session_id string, lines int")
    made = spark.createDataFrame([("b", "text"), ("c", None), ("e", " ")], "session_id string, summary string")
    assert {r["session_id"]: r["status"] for r in S.summary_states(ended, made).collect()} == {"a": "ready", "b": "ready", "c": "failed", "d": "waiting", "e": "failed"}


def test_daily_counters_on_streams(run):
    from pyspark.sql import functions as F

    row = lambda t, s, masked: {"tenant_id": t, "ts": _at(s), "masked": masked}
    batches = [[row("a", 1, True), row("a", 2, False)], [row("a", 90_000, True), row("b", 3, True)], [row("a", 5, True)]]
    got = run(batches, "tenant_id string, ts timestamp, masked boolean", lambda s: S.daily_stream(S.decodable(s), {"utterances": F.count("*"), "masked": F.count_if("masked")}, "2 days"), "complete")
    assert {(r["tenant_id"], r["day"]): (r["utterances"], r["masked"]) for r in got} == {("a", "2024-01-01"): (3, 2), ("b", "2024-01-01"): (1, 1), ("a", "2024-01-02"): (1, 1)}


def test_repeated_events_go(run):
    batches = [[{"id": "x", "ts": _at(1)}, {"id": "x", "ts": _at(2)}], [{"id": "x", "ts": _at(3)}, {"id": "y", "ts": _at(4)}]]
    assert sorted(r["id"] for r in run(batches, "id string, ts timestamp", lambda s: S.distinct_stream(S.decodable(s), "id"))) == ["x", "y"]


def test_labels_within_the_time_given(run):
    u = lambda k, s: {"kind": "u", "session_id": "s", "start_ms": k, "ts": _at(s), "text": f"t{k}"}
    v = lambda k, s: {"kind": "v", "session_id": "s", "start_ms": k, "ts": _at(s), "speaker_id": f"p{k}"}
    batches = [[u(1, 0), v(2, 1)], [u(2, 2), v(1, 8), u(3, 9)], [v(3, 30)], [u(9, 500), v(9, 500)], [u(10, 900), v(10, 900)], [u(11, 1300), v(11, 1300)]]
    schema = "kind string, session_id string, start_ms long, ts timestamp, text string, speaker_id string"

    def labelled(s):
        rows = S.decodable(s)
        return S.labelled_stream(rows.where("kind = 'u'").select("session_id", "start_ms", "ts", "text"), rows.where("kind = 'v'").select("session_id", "start_ms", "ts", "speaker_id"), "10 seconds")

    got = {r["start_ms"]: r["speaker_id"] for r in run(batches, schema, labelled)}
    assert got[1] == "p1" and got[2] == "p2" and got[3] is None and got[9] == "p9"  # the third one's label is 21 seconds late


def test_a_sink_holds_each_event_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": "a", "n": 1}\n{"k": "b", "n": 2}\n')
    events = lambda: S.decodable(S.event_source(spark, str(tmp_path / "in"), "k string, n int"))
    for _ in range(2):  # the second run finds nothing new
        S.event_sink(events(), f"file://{tmp_path}/out", f"file://{tmp_path}/c", kind="k").awaitTermination(60)
    (tmp_path / "in" / "b.json").write_text('{"k": "a", "n": 3}\n')
    S.event_sink(events(), f"file://{tmp_path}/out", f"file://{tmp_path}/c", kind="k").awaitTermination(60)
    assert sorted((r["k"], r["n"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("a", 1), ("a", 3), ("b", 2)]
