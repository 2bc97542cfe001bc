"""A log of events: two groups read it once each over restarts, batches are written once, and old files go."""

import json

import pytest

from parlance.streaming import event_log as E


@pytest.fixture
def log(spark, tmp_path):
    E.register(spark)
    return f"file://{tmp_path}/log"


def _write(log, n, mark="w", batch=0):
    """A batch of n events by the writer's own steps."""
    writer = E._Writer({"path": log, "writer": mark})
    writer.commit([writer.write({"value": json.dumps({"n": f"{mark}{batch}/{k}"})} for k in range(n)), None], batch)


def _read(spark, log, checkpoint, table, **options):
    rows = spark.readStream.format(E.FORMAT).options(path=log, **options).load()
    query = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(60)
    return sorted(json.loads(r["value"])["n"] for r in spark.read.schema(E.SCHEMA).parquet(table).collect())


def test_groups_read_once_over_restarts(spark, log, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    _write(log, 2, batch=0)
    first = _read(spark, log, at("c1"), at("t1"), group="one", start="earliest")
    assert first == ["w0/0", "w0/1"] and E.committed(log, "other") is None
    _write(log, 1, batch=1)
    assert _read(spark, log, at("c1"), at("t1"), group="one") == ["w0/0", "w0/1", "w1/0"]  # the same query goes on
    assert _read(spark, log, at("c2"), at("t2"), group="two", start="earliest") == ["w0/0", "w0/1", "w1/0"]
    _write(log, 1, batch=2)
    assert _read(spark, log, at("c2"), at("t2"), group="two") == ["w0/0", "w0/1", "w1/0", "w2/0"]


def test_a_group_outlives_its_query(spark, log, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    _write(log, 1, batch=0)
    _read(spark, log, at("c"), at("t"), group="g", start="earliest")
    taken = E.committed(log, "g")
    _write(log, 1, batch=1)
    got = _read(spark, log, at("fresh"), at("u"), group="g", start="latest")  # a new query of the group, without a checkpoint
    assert got == (["w1/0"] if taken == 1 else ["w0/0", "w1/0"]) and taken in (0, 1)


def test_start_at_the_end(spark, log, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    _write(log, 1, batch=0)
    assert _read(spark, log, at("c"), at("t")) == []
    _write(log, 1, batch=1)
    assert _read(spark, log, at("c"), at("t")) == ["w1/0"]


def test_a_stream_writes_each_batch_once(spark, log, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"n": "x"}\n{"n": "y"}\n')
    lines = spark.readStream.text(f"file://{tmp_path}/in")
    go = lambda c: lines.writeStream.format(E.FORMAT).options(path=log, writer="q").option("checkpointLocation", f"file://{tmp_path}/{c}").trigger(availableNow=True).start().awaitTermination(60)
    go("c")
    files = E._listed(log)
    assert [m for _, m, _ in files] == ["q-0-0"]
    go("other")  # the same batch by the same writer once more, as after a crash before its checkpoint
    assert E._listed(log) == files and not [p for p in (tmp_path / "log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_retention_waits_for_groups(spark, log, tmp_path):
    for k in range(5):
        _write(log, 1, batch=k)
    reader = E._Reader({"path": log, "group": "slow", "start": "earliest"})
    reader.commit({"number": 2})
    assert E.trim(log, 1, ("slow",)) == 2 and [n for n, *_ in E._listed(log)] == [3, 4, 5]
    assert E.trim(log, 1) == 2 and reader.initialOffset() == {"number": 2}
    assert [p.number for p in reader.partitions({"number": 2}, {"number": 5})] == [5]
