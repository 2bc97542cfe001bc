"""Calls on streams: open ones are kept up to a bound, and a call comes out when it closes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.functions.text import ROLE_LABELS
from parlance.operators.analytics import MAX_TURNS
from parlance.operators.calls import CALL, EVENTS

# --- fixed values: results depend on them ---------------------------------------
MAX_OPEN = 5000
NAMES = ("session_id", "tenant_id", "utterances", "masked", "rule_hits", "bot_turns", "handed_off", "truncated", "closed_seq", "turns")
# -------------------------------------------------------------------------------


class _Calls(StatefulProcessor):
    """Open sessions of a shard: each one's record by id, and their ids by the order in which they opened."""

    def __init__(self, most_turns: int, most_open: int):
        self.most_turns, self.most_open = most_turns, most_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "session_id string", "opened bigint, record string")
        self.order = handle.getMapState("order", "opened bigint", "session_id string")
        self.counts = handle.getValueState("counts", "held bigint, oldest bigint, next bigint")

    def _start(self, session: str, tenant: str | None, counts: list[int]) -> tuple[int, dict]:
        held, oldest, following = counts
        while held >= self.most_open:  # the oldest goes: its end has not come
            if self.order.containsKey((oldest,)):
                self.open.removeKey((self.order.getValue((oldest,))[0],))
                self.order.removeKey((oldest,))
                held -= 1
            oldest += 1
        self.order.updateValue((following,), (session,))
        counts[:] = [held + 1, oldest, following + 1]
        return following, {"tenant_id": tenant, "utterances": 0, "masked": 0, "rule_hits": [], "bot_turns": 0, "handed_off": False, "truncated": False, "turns": []}

    def _add(self, record: dict, row: dict) -> None:
        if row["kind"] == "bot":
            record["bot_turns"] += 1
            record["handed_off"] |= row["handed_off"] is True
        elif row["kind"] == "utterance" and row["is_final"] is True and (text := (row["text"] or "").strip()):
            record["utterances"] += 1
            record["masked"] += row["pii_masked"] is True
            rules = row["rule_ids"]
            record["rule_hits"] += [r for r in dict.fromkeys(rules if rules is not None else ()) if r not in record["rule_hits"]]
            if len(record["turns"]) < self.most_turns:
                own = (row["speaker_id"] or "").strip()
                record["turns"].append([row["speaker_id"] if own else ROLE_LABELS.get(row["channel"], ROLE_LABELS[""]), text])
            else:
                record["truncated"] = True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts", "session_id", "seq"], kind="stable")
        counts = list(self.counts.get()) if self.counts.exists() else [0, 0, 0]
        here: dict[str, tuple[int, dict]] = {}  # records of this batch's sessions, written once
        out = []
        for row in every.astype(object).where(every.notna(), None).to_dict("records"):
            session = row["session_id"]
            if session not in here and self.open.containsKey((session,)):
                opened, record = self.open.getValue((session,))
                here[session] = (opened, json.loads(record))
            if session not in here or not self.order.containsKey((here[session][0],)):
                here[session] = self._start(session, row["tenant_id"], counts)
            opened, record = here[session]
            if row["kind"] != "closed":
                self._add(record, row)
                continue
            out.append({"session_id": session, "closed_seq": row["seq"], **record, "turns": [{"speaker": s, "text": t} for s, t in record["turns"]]})
            self.order.removeKey((opened,))
            if self.open.containsKey((session,)):
                self.open.removeKey((session,))
            counts[0] -= 1
            del here[session]
        for session, (opened, record) in here.items():
            if self.order.containsKey((opened,)):
                self.open.updateValue((session,), (opened, json.dumps(record)))
        self.counts.update(tuple(counts))
        yield pd.DataFrame({n: pd.Series([r[n] for r in out], dtype=object) for n in NAMES})

    def close(self) -> None:
        pass


def calls_stream(events: DataFrame, shards: int = 64, most_turns: int = MAX_TURNS, most_open: int = MAX_OPEN) -> DataFrame:
    """A row for each call as it closes, as closed_calls gives over a table.

    events has the columns of EVENTS and ts. Sessions are dealt into shards; a
    shard keeps at most most_open open calls, and where a new one finds no room
    the one that opened first is dropped. What comes after a closing opens the
    call anew. Needs the RocksDB state store.
    """
    names = [f.strip().split()[0] for f in EVENTS.split(", ")]
    rows = events.select(*names, "ts", F.pmod(F.xxhash64("session_id"), F.lit(shards)).alias("shard"))
    return rows.groupBy("shard").transformWithStateInPandas(_Calls(most_turns, most_open), CALL, "Append", "None")
