"""State per key over a stream whose rows may come out of order: they wait until the watermark has passed them.

A :class:`InOrder` processor holds a key's waiting rows and one state. When the watermark moves on, the rows that it has passed
are given, in order of their time and number, to a plain function ``step(due, state, now)``, which returns rows to tell, the new
state (None: nothing to keep), and a later moment at which it must be called even if no row comes (None: none). Times are
in milliseconds since 1970. Rows later than the watermark are dropped before. The session must keep state in RocksDB."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zenithal.session import ship

#: The setting that timers and lists in the state need.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

Step = Callable[[list[tuple], tuple | None, int], tuple[list[tuple], tuple | None, int | None]]


class InOrder(StatefulProcessor):
    def __init__(self, step: Step, columns: list[str], row: str, state: str, told: list[str]):
        self.step, self.columns, self.row, self.state, self.told = step, columns, row, state, told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.held = handle.getListState("waiting", self.row), handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        first = None
        for r in rows:
            some = [tuple(None if pd.isna(v) else v for v in x) for x in r[self.columns].astype(object).itertuples(index=False)]
            self.waiting.appendList(some)
            low = min(x[0] for x in some)
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(int(max(first, timerValues.getCurrentWatermarkInMs() + 1)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda x: x[:2]) if self.waiting.exists() else []
        due, later = [tuple(x) for x in rows if x[0] <= now], [tuple(x) for x in rows if x[0] > now]
        out, state, wake = self.step(due, tuple(self.held.get()) if self.held.exists() else None, now)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        self.held.clear() if state is None else self.held.update(state)
        coming = [x[0] for x in later] + ([] if wake is None else [wake])
        if coming:
            self.handle.registerTimer(int(min(coming)))
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=self.told)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, step: Step, state: str, told: str) -> DataFrame:
    """``rows`` (key, event time with a watermark, then ``at_ms``, ``id`` and what a step reads) through ``step``; ``told``: columns
    of its rows after the key. Nulls of numbers reach a step as None."""
    ship(rows.sparkSession)
    at = rows.columns.index("at_ms")
    columns = rows.columns[at:]
    row = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    names = [key, *[x.split()[0] for x in told.split(", ")]]
    made = InOrder(step, columns, row, state, names)
    return rows.groupBy(key).transformWithStateInPandas(made, f"{key} {rows.schema[key].dataType.simpleString()}, {told}", "Append", "EventTime")
