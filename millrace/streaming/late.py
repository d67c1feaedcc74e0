"""Logic that needs the rows of a key in order, on a stream that is late by a bounded delay.

Rows wait in state until the watermark has passed them and no earlier one can come, and are then taken in order. A timer on
the earliest waiting row wakes a key, so a key without new rows is served too. What waits is what the delay holds back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import STOP_COLUMNS, STOP_EVENTS, STOP_RUN, follow_stops

Follow = Callable[[tuple, pd.DataFrame, "tuple | None"], "tuple[pd.DataFrame, tuple | None]"]
AT = "at_micros"  # since 1970; names that begin with an underscore do not reach the processor


class InOrder(StatefulProcessor):
    """Holds rows back and hands those that the watermark has passed to ``follow``, with what it remembered of the key."""

    def __init__(self, columns: Sequence[str], waiting: str, order_by: Sequence[str], follow: Follow, memory: str) -> None:
        self.columns, self.schema, self.order_by = list(columns), waiting, list(order_by)
        self.follow, self.memory = follow, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.known = handle.getValueState("known", self.memory)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows))[self.columns]
        self.waiting.appendList([tuple(r) for r in came.astype(object).itertuples(index=False)])
        self._wake(int(came[AT].min()))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=self.columns)
        due = rows[AT] <= passed
        later = rows[~due]
        if len(later):
            self.waiting.put([tuple(r) for r in later.astype(object).itertuples(index=False)])
            self._wake(int(later[AT].min()))
        else:
            self.waiting.clear()
        if due.any():
            ready = rows[due].sort_values([AT, *self.order_by])
            ready.insert(0, "ts", pd.to_datetime(ready[AT], unit="us"))
            out, memory = self.follow(key, ready, self.known.get() if self.known.exists() else None)
            if memory:
                self.known.update(memory)
            else:
                self.known.clear()
            if len(out):
                yield out

    def _wake(self, at: int) -> None:
        # a timer fires once the watermark, in milliseconds, is beyond it
        due = -(-at // 1000) - 1
        if due not in set(self.handle.listTimers()):
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def in_order_stream(
    stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], follow: Follow, memory: str, schema: str, ts: str = "ts"
) -> DataFrame:
    """Apply ``follow(key, rows, memory)`` to the rows of every key in the order of ``ts`` and ``order_by``.

    ``stream`` needs a watermark on ``ts`` and must be started under ``rocksdb_state``. Rows behind the watermark are dropped, rows
    without a time too. ``follow`` returns rows of ``schema`` and what it wants to remember, a tuple of ``memory`` or None.
    """
    keys = list(keys)
    held = stream.filter(F.col(ts).isNotNull()).withColumn(AT, F.unix_micros(ts))
    columns = [c for c in held.columns if c not in (*keys, ts)]
    waiting = T.StructType([T.StructField(c, held.schema[c].dataType) for c in columns])
    processor = InOrder(columns, waiting.simpleString()[7:-1].replace(":", " "), order_by, follow, memory)
    return held.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def late_stopped_vehicles_stream(reports: DataFrame) -> DataFrame:
    """As ``stopped_vehicles_stream`` for reports in any order within the delay of the watermark on ``ts``."""

    def follow(key: tuple, rows: pd.DataFrame, run: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        return follow_stops(key, rows, tuple(run) if run else None)

    kept = reports.selectExpr(*STOP_COLUMNS)
    return in_order_stream(kept, ["vehicle"], ["report_id"], follow, STOP_RUN, STOP_EVENTS)
