"""Ordered operators on streams give, for any cut into batches, what they give over tables."""

import json
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import audio as A
from parlance.operators import dialogue as D
from parlance.streaming import stateful as S

T0 = datetime(2024, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def stream(spark, tmp_path):
    """Rows of a stream that reads its batches one by one, with a restart in the middle."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def go(name, schema, batches, f):
        source, out = tmp_path / f"{name}-in", f"file://{tmp_path}/{name}-out"
        source.mkdir()

        def write(part):
            for k, rows in part:
                file = source / f"{k:03d}.json"
                file.write_text("\n".join(json.dumps(r, default=str) for r in rows))
                os.utime(file, (1e9 + k, 1e9 + k))

        numbered = list(enumerate(batches))
        for part in (numbered[: len(numbered) // 2], numbered[len(numbered) // 2 :]):
            write(part)
            rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
            made = f(rows.withColumns({c: F.unbase64(c) for c, kind in rows.dtypes if c in ("pcm", "payload")}))
            made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/{name}-c").trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.schema(made.schema).parquet(out)

    yield go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _cut(rows, seed, n):
    """Rows in order, in n batches of random sizes."""
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(rows)), min(n, len(rows)) - 1))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def _ends(row):
    """Two later batches of another key, which move the watermark past all timers."""
    return [[{**row, "ts": str(T0 + timedelta(days=k))}] for k in (2, 3)]


def _plain(rows, *drop):
    return sorted(repr({k: (bytes(v) if isinstance(v, bytearray) else v) for k, v in r.asDict(True).items() if k not in drop}) for r in rows)


def _scenario():
    node = lambda **x: {"prompt": "", "reprompt": "", "next_node": "", "slot": "", "max_retries": 0, "intents": [], **x}
    ways = [{"name": "pay", "patterns": ["pay"], "next_node": "bye"}, {"name": "person", "patterns": ["human"], "next_node": "person"}, {"name": "more", "patterns": ["more"], "next_node": "ask"}]
    return [node(node_id="hello", kind="say", prompt="hello", next_node="ask"), node(node_id="ask", kind="ask", prompt="what?", reprompt="pardon?", slot="wish", max_retries=1, intents=ways), node(node_id="person", kind="handoff", prompt="one moment"), node(node_id="bye", kind="end", prompt="bye")]


@pytest.mark.parametrize("n", [1, 3, 6])
def test_dialogues(spark, stream, n):
    rng = random.Random(n)
    rows = [{"session_id": f"s{k % 4}", "seq": k, "text": rng.choice(["pay", "human", "more", "what", None]), "intent": rng.choice([None, "more"]), "ts": str(T0 + timedelta(seconds=k))} for k in range(40)]
    schema = "session_id string, seq int, text string, intent string, ts timestamp"
    got = stream("d", schema, _cut(rows, n, n), lambda r: S.played_stream(r, _scenario(), "hello", "person"))
    table = spark.createDataFrame([(r["session_id"], r["seq"], r["text"], r["intent"]) for r in rows], "session_id string, seq int, text string, intent string")
    assert _plain(got.collect()) == _plain(D.played(table, _scenario(), "hello", "person").collect())


def test_a_late_reply_opens_anew(spark, stream):
    say = lambda k, hours: {"session_id": "s", "seq": k, "text": "more", "intent": None, "ts": str(T0 + timedelta(hours=hours))}
    got = stream("d", "session_id string, seq int, text string, intent string, ts timestamp", [[say(1, 0), say(2, 3.9)], [say(3, 7.8)], [say(4, 12)]], lambda r: S.played_stream(r, _scenario(), "hello", "person"))
    assert sorted(r["seq"] for r in got.collect()) == [-1, -1, 1, 2, 3, 4]  # within four hours it goes on, after 4.2 it begins again


@pytest.mark.parametrize("n", [1, 4])
def test_jitter(spark, stream, n):
    rng = random.Random(n)
    rows = []
    for leg in ("a", "b"):
        numbers = [(65520 + k) % 65536 for k in range(60) if k % 13 != 5]
        for k in range(0, len(numbers) - 3, 3):
            rng.shuffle(numbers[k : k + 3])
        numbers = [*numbers[:30], numbers[3], numbers[29], *numbers[30:], 900, 901, 903]
        rows += [{"leg": leg, "arrival": k, "sequence": s, "payload_type": 0, "payload": "//////8=", "ts": str(T0 + timedelta(milliseconds=20 * k))} for k, s in enumerate(numbers)]
    rows.sort(key=lambda r: (r["ts"], r["leg"]))
    schema = "leg string, arrival int, sequence int, payload_type int, payload string, ts timestamp"
    last = {"leg": "z", "arrival": 0, "sequence": 1, "payload_type": 0, "payload": None}
    got = stream("j", schema, _cut(rows, n, n) + _ends(last), S.dejittered_stream)
    table = spark.createDataFrame([tuple(r.values())[:5] for r in rows], "leg string, arrival int, sequence int, payload_type int, payload string").withColumn("payload", F.unbase64("payload"))
    want = A.dejittered(table).collect()
    assert _plain(got.where("leg <> 'z'").collect()) == _plain(want)
    assert any(r["lost"] and r["late"] and r["resynced"] for r in want if r["pcm"] is None)


def _audio():
    """Streams of silence and tones, in chunks of odd sizes."""
    import base64

    rng, rows = np.random.default_rng(1), []
    for stream in ("x", "y"):
        loud = np.repeat(rng.choice([0, 0, 1], 40), 3200)
        samples = (rng.normal(0, 30, len(loud)) + loud * 3000 * np.sin(np.arange(len(loud)) / 5)).astype("<i2").tobytes()
        at, k = 0, 0
        while at < len(samples):
            size = int(rng.integers(500, 9000)) * 2
            rows.append({"stream": stream, "seq": k, "pcm": base64.b64encode(samples[at : at + size]).decode(), "ts": str(T0 + timedelta(milliseconds=at // 32))})
            at, k = at + size, k + 1
    return sorted(rows, key=lambda r: (r["ts"], r["stream"]))


@pytest.mark.parametrize("n", [1, 5])
def test_segments(spark, stream, n):
    rows = _audio()
    got = stream("s", "stream string, seq int, pcm string, ts timestamp", _cut(rows, n, n) + _ends({"stream": "z", "seq": 0, "pcm": None}), S.segments_stream)
    table = spark.createDataFrame([(r["stream"], r["seq"], r["pcm"]) for r in rows], "stream string, seq int, pcm string").withColumn("pcm", F.unbase64("pcm"))
    want = A.speech_segments(table).collect()
    assert _plain(got.where("stream <> 'z'").collect()) == _plain(want)
    assert sum(r["is_final"] for r in want) > 3 and not all(r["is_final"] for r in want)


def test_speakers(spark, stream):
    import base64

    tone = lambda f, k: base64.b64encode((3000 * np.sin(np.arange(16000) * f) + np.random.default_rng(k).normal(0, 20, 16000)).astype("<i2").tobytes()).decode()
    rows = [{"session_id": "s", "start_ms": 1000 * k, "duration_ms": 1000 if k % 5 else 300, "pcm": tone([0.05, 0.4, 1.3][k % 3], k), "ts": str(T0 + timedelta(seconds=k))} for k in range(18)]
    got = stream("v", "session_id string, start_ms long, duration_ms int, pcm string, ts timestamp", _cut(rows, 2, 4), S.speakers_stream).collect()
    table = spark.createDataFrame([tuple(r.values())[:4] for r in rows], "session_id string, start_ms long, duration_ms int, pcm string").withColumn("pcm", F.unbase64("pcm"))
    want = A.speakers(table).collect()
    assert _plain(got, "similarity") == _plain(want, "similarity")
    assert sorted(r["similarity"] for r in got) == pytest.approx(sorted(r["similarity"] for r in want), abs=1e-5)
