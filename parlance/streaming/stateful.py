"""Ordered operators on streams: the folds of tables with their state kept between batches, until it is old."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.audio import diarisation, jitter, segmenter
from parlance.operators.dialogue import dialogue
from parlance.operators.ordered import Fold

# --- fixed values: results depend on them ---------------------------------------
DIALOGUE_HOURS, LEG_IDLE_S, STREAM_IDLE_S, SESSION_IDLE_S = 4, 30, 30, 120
# -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How a fold's state stands in the state store.

    `value` names the fields that are one value; `lists` names fields that are
    lists, whose new elements are appended; `maps` names fields that are maps,
    of which only changed entries are written. get(state) gives all of these by
    name, put(fields) the state again.
    """

    value: str
    get: Callable[[dict], dict]
    put: Callable[[dict], dict]
    lists: dict[str, str] = field(default_factory=dict)
    maps: dict[str, tuple[str, str]] = field(default_factory=dict)


def _plain(value):
    return None if value is None or (isinstance(value, float) and np.isnan(value)) or value is pd.NaT else value.item() if isinstance(value, np.generic) else value


class _Kept(StatefulProcessor):
    """Runs a fold over a stream's rows, batch after batch, with typed state and a timer for its lifetime."""

    def __init__(self, fold: Fold, layout: Layout, time: str, lifetime_ms: int, columns: list[str]):
        self.fold, self.layout, self.time, self.lifetime_ms, self.columns = fold, layout, time, lifetime_ms, columns
        self.names = [f.strip().split()[0] for f in _fields(layout.value)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.layout.value}, last_ms bigint")
        self.lists = {n: handle.getListState(n, f"item {kind}") for n, kind in self.layout.lists.items()}
        self.maps = {n: handle.getMapState(n, f"name {key}", f"item {kind}") for n, (key, kind) in self.layout.maps.items()}

    def _load(self) -> tuple[dict | None, int, dict]:
        if not self.value.exists():
            return None, 0, {}
        *values, last = self.value.get()
        held = dict(zip(self.names, values))
        held |= {n: [x[0] for x in s.get()] if s.exists() else [] for n, s in self.lists.items()}
        held |= {n: {k[0]: v[0] for k, v in s.iterator()} if s.exists() else {} for n, s in self.maps.items()}
        before = {n: list(held[n]) for n in self.lists} | {n: dict(held[n]) for n in self.maps}
        return self.layout.put(held), last, before

    def _save(self, state: dict, last: int, before: dict) -> None:
        held = self.layout.get(state)
        self.value.update((*(_plain(held[n]) for n in self.names), last))
        for n, s in self.lists.items():
            old, new = before.get(n, []), held[n]
            if len(new) >= len(old) and all(a is b or a == b for a, b in zip(old, new)):
                if new[len(old) :]:
                    s.appendList([(x,) for x in new[len(old) :]])
            elif new:
                s.put([(x,) for x in new])
            else:
                s.clear()
        for n, s in self.maps.items():
            old, new = before.get(n, {}), held[n]
            for k in old.keys() - new.keys():
                s.removeKey((k,))
            for k, v in new.items():
                if k not in old or old[k] != v:
                    s.updateValue((k,), (v,))

    def _clear(self) -> None:
        for s in (self.value, *self.lists.values(), *self.maps.values()):
            s.clear()

    def _rows(self, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[c] for r in out], dtype=object) for c in self.columns})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values([self.time, *self.fold.order], kind="stable")
        at = every[self.time].astype("datetime64[ms]").astype("int64").tolist()
        state, last, before = self._load()
        out: list[dict] = []
        for row, now in zip(every.drop(columns=[self.time]).astype(object).to_dict("records"), at):
            row = {c: _plain(v) for c, v in row.items()}
            if state is not None and now - last > self.lifetime_ms:
                out += self.fold.end(state, key[0])
                self._clear()
                state, before = None, {}
            if state is None:
                state, last = self.fold.start(), now
            out += self.fold.step(state, row)
            last = max(last, now)
        self._save(state, last, before)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.lifetime_ms + 1)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last, _ = self._load()
        if state is None or last + self.lifetime_ms + 1 > expiredTimerInfo.getExpiryTimeInMs():
            return  # rows of this batch have renewed it
        self._clear()
        yield self._rows(self.fold.end(state, key[0]))

    def close(self) -> None:
        pass


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:k])
            at = k + 1
    return [*out, schema[at:]]


def folded_stream(rows: DataFrame, fold: Fold, layout: Layout, lifetime_ms: int, time: str = "ts", late: str = "10 seconds") -> DataFrame:
    """The rows that a fold gives over a stream, whatever its batches.

    A key's rows of a batch are taken in the order of time and of the fold; the
    state stands in the store between batches. A key without rows for its
    lifetime ends as a table's key does, by a timer once the watermark has
    passed it; a row that comes after that opens the key anew, even when the
    watermark hasn't moved. Rows behind the watermark are dropped. Needs the
    RocksDB state store.
    """
    columns = [f.strip().split()[0] for f in _fields(fold.schema)]
    return rows.withWatermark(time, late).groupBy(fold.key).transformWithStateInPandas(_Kept(fold, layout, time, lifetime_ms, columns), fold.schema, "Append", "EventTime")


def played_stream(utterances: DataFrame, nodes: list[dict], entry: str, fallback: str = "", hours: float = DIALOGUE_HOURS, late: str = "10 seconds") -> DataFrame:
    """Sessions played through a scenario as their utterances (session_id, seq, text, intent, ts) come; a dialogue left alone for its lifetime is forgotten."""
    names = ("node", "slots", "retries", "handed_off", "finished", "open", "falls")
    layout = Layout("node string, slots map<string,string>, retries int, handed_off boolean, finished boolean, open boolean, falls int", lambda s: {n: s[n] for n in names}, lambda held: {**held, "slots": dict(held["slots"] or {})})
    rows = utterances.select("session_id", F.col("seq").cast("int").alias("seq"), "text", "intent", "ts")
    return folded_stream(rows, dialogue(nodes, entry, fallback, utterances.schema["session_id"].dataType.simpleString()), layout, int(hours * 3_600_000), late=late)


def dejittered_stream(packets: DataFrame, idle_s: float = LEG_IDLE_S, late: str = "2 seconds") -> DataFrame:
    """Legs' samples in order of their numbers as packets (leg, arrival, sequence, payload_type, payload, ts) come.

    Waiting packets are a map by number. A leg that falls silent gives what
    waits, and its counts, once its timer has run out.
    """
    counts = ("next", "place", "received", "reordered", "lost", "late", "duplicated", "resynced")
    layout = Layout(", ".join(f"{n} int" for n in counts), lambda s: s, lambda held: held, maps={"waiting": ("int", "binary")})
    return folded_stream(packets, jitter(packets.schema["leg"].dataType.simpleString()), layout, int(idle_s * 1000), late=late)


def segments_stream(chunks: DataFrame, idle_s: float = STREAM_IDLE_S, late: str = "2 seconds", **settings: int) -> DataFrame:
    """Segments of speech, interim ones too, as audio chunks (stream, seq, pcm, ts) come; the open segment's frames are a list that grows."""

    def get(s: dict) -> dict:
        own = s["own"] or {"start": 0.0, "emitted": 0.0, "speech": 0.0, "silence": 0.0, "pcm": s["before"]}
        return {"rest": s["rest"], "floor": float(s["floor"]), "clock": s["clock"], "inside": s["own"] is not None, "began": own["start"], "emitted": own["emitted"], "speech": own["speech"], "silence": own["silence"], "frames": own["pcm"]}

    def put(held: dict) -> dict:
        own = {"start": held["began"], "emitted": held["emitted"], "speech": held["speech"], "silence": held["silence"], "pcm": held["frames"]} if held["inside"] else None
        return {"rest": bytes(held["rest"]), "floor": held["floor"], "clock": held["clock"], "own": own, "before": [] if own else held["frames"]}

    layout = Layout("rest binary, floor double, clock double, inside boolean, began double, emitted double, speech double, silence double", get, put, lists={"frames": "binary"})
    return folded_stream(chunks, segmenter(chunks.schema["stream"].dataType.simpleString(), **settings), layout, int(idle_s * 1000), late=late)


def speakers_stream(segments: DataFrame, idle_s: float = SESSION_IDLE_S, late: str = "2 seconds") -> DataFrame:
    """Speakers of sessions' segments (session_id, start_ms, duration_ms, pcm, ts) as they come; the voices' centres are the state."""

    def put(held: dict) -> dict:
        rows = [np.array(c, np.float32) for c in held["centres"]]
        return {"centres": np.stack(rows) if rows else diarisation("string").start()["centres"]}

    layout = Layout("known int", lambda s: {"known": len(s["centres"]), "centres": [[float(x) for x in c] for c in s["centres"]]}, put, lists={"centres": "array<float>"})
    return folded_stream(segments, diarisation(segments.schema["session_id"].dataType.simpleString()), layout, int(idle_s * 1000), late=late)
