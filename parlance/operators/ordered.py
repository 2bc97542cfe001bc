"""Rows in order through a state: for what no window can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


@dataclass(frozen=True)
class Fold:
    """An ordered operator: rows of a key, in order, through a state.

    start() is a new state, a dict; step(state, row) and, after the last row,
    end(state, key) give rows of the schema. Tables take it by `over`, streams
    by streaming.stateful.
    """

    key: str
    order: tuple[str, ...]
    schema: str
    start: Callable
    step: Callable
    end: Callable = lambda state, key: []

    def over(self, rows: DataFrame) -> DataFrame:
        return folded(rows, self.key, self.order, self.schema, self.start, self.step, self.end)


def folded(rows: DataFrame, key: str, order: tuple[str, ...], schema: str, start: Callable, step: Callable, end: Callable = lambda state, key: []) -> DataFrame:
    """What step(state, row) and, after a key's last row, end(state, key) give: lists of rows of the schema.

    A key's rows are one sorted stream of one task, since each needs the state
    after those before it; only the state is held. Other keys run beside it.
    """
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def batch(out: list[dict]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if state is None or row[key] != own:
                    if state is not None:
                        out += end(state, own)
                    own, state = row[key], start()
                out += step(state, row)
            yield from batch(out)
        if state is not None:
            yield from batch(end(state, own))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
