"""Operators whose streaming form keeps state per key: row windows and stopped vehicles.

Rows of a key are put in order inside a micro-batch; across batches the stream must arrive in
order. The state of a key is one small record; a vehicle that moves and a place that is empty have none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.udf import Aggregate
from ..operators.road import STOP_REPORTS


def row_windows_stream(
    stream: DataFrame, keys: Sequence[str], size: int, agg: Aggregate, order_by: Sequence[str]
) -> DataFrame:
    """Aggregate every ``size`` rows of a key; only full windows are emitted."""
    keys, order_by = list(keys), list(order_by)
    key_fields = [stream.schema[k] for k in keys]
    result = T._parse_datatype_string(agg.schema).fields
    out = T.StructType([*key_fields, T.StructField("window_index", T.LongType()), *result])
    names = out.names
    create, update, finish = agg.create, agg.update, agg.finish

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, filled, packed = state.get if state.exists else (0, 0, pickle.dumps(create()))
        acc = pickle.loads(packed)
        rows = pd.concat(list(batches)).sort_values(order_by)
        done, at = [], 0
        while at < len(rows):
            part = rows.iloc[at : at + size - filled]
            acc, filled, at = update(acc, part), filled + len(part), at + len(part)
            if filled == size:
                done.append((*key, index, *finish(acc)))
                index, filled, acc = index + 1, 0, create()
        state.update((index, filled, pickle.dumps(acc)))
        yield pd.DataFrame(done, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(
        advance, out, "window_index LONG, filled INT, acc BINARY", "append", GroupStateTimeout.NoTimeout
    )


STOP_EVENTS = (
    "vehicle LONG, kind STRING, highway LONG, position LONG, segment LONG, first_ts TIMESTAMP, stopped_at TIMESTAMP, "
    "cleared_at TIMESTAMP"
)


#: The run of standing reports of a vehicle that is open: length, place, segment, first and fourth time.
STOP_RUN = "length INT, highway LONG, position LONG, segment LONG, first_ts TIMESTAMP, stopped_at TIMESTAMP"
STOP_COLUMNS = (
    "CAST(vehicle AS LONG) AS vehicle", "ts", "report_id", "CAST(speed AS DOUBLE) AS speed", "CAST(highway AS LONG) AS highway",
    "CAST(position AS LONG) AS position", "CAST(segment AS LONG) AS segment",
)


def follow_stops(key: tuple, rows: pd.DataFrame, run: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
    """Stops that begin or end with the next ``rows`` of a vehicle, given in order, and the run that is open after them."""
    needed = STOP_REPORTS
    names = [part.split()[0] for part in STOP_EVENTS.split(", ")]
    length, highway, position, segment, first, stopped = run or (0, 0, 0, 0, None, None)
    ts, road, place, part = (rows[c].to_numpy() for c in ("ts", "highway", "position", "segment"))
    stands, at = (rows["speed"] == 0).to_numpy(), np.arange(len(rows))

    def before(values: np.ndarray, carried) -> np.ndarray:
        return np.concatenate([np.array([carried], dtype=values.dtype), values[:-1]])

    same = (road == before(road, highway)) & (place == before(place, position))
    goes_on = stands & before(stands, length > 0) & same
    start = np.maximum.accumulate(np.where(goes_on, -1, at))  # -1: the run that was open
    nth = np.where(stands, at - start + np.where(start < 0, length, 1), 0)
    since = np.where(start < 0, np.datetime64(first or 0, "ns"), ts[start].astype("datetime64[ns]"))
    found = np.flatnonzero(nth == needed)
    # a run's stop is the latest one found so far; -1: that of the run that was open
    stop = np.maximum.accumulate(np.where(nth == needed, at, -1))
    stop_ts = np.where(stop < 0, np.datetime64(stopped or 0, "ns"), ts[stop].astype("datetime64[ns]"))
    stop_part = np.where(stop < 0, segment, part[stop])
    left = np.flatnonzero(~goes_on & (before(nth, length) >= needed))
    last = left - 1  # -1 where the first report ends the run that was open
    ended = [np.where(last < 0, carried, values[last]) for values, carried in (
        (road, highway), (place, position), (stop_part, segment), (since, np.datetime64(first or 0, "ns")),
        (stop_ts, np.datetime64(stopped or 0, "ns")))]
    arrived = [road[found], place[found], part[found], since[found], stop_ts[found]]
    no_time = np.full(len(found), np.datetime64("NaT", "ns"))
    parts = [("stopped", *arrived, no_time), ("cleared", *ended, ts[left].astype("datetime64[ns]"))]
    frames = [pd.DataFrame(dict(zip(names[1:], values, strict=True)), index=range(len(values[1]))) for values in parts]
    out = pd.concat(frames, ignore_index=True)
    out.insert(0, names[0], key[0])
    if nth[-1] == 0:
        return out, None  # a vehicle on the move needs no memory
    standing = nth[-1] >= needed
    times = (pd.Timestamp(since[-1]), pd.Timestamp(stop_ts[-1]) if standing else None)
    return out, (int(nth[-1]), int(road[-1]), int(place[-1]), int(stop_part[-1]) if standing else 0, *times)


def stopped_vehicles_stream(reports: DataFrame) -> DataFrame:
    """Emit a "stopped" row with a vehicle's fourth standing report and a "cleared" row when it moves on."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "report_id"])
        out, run = follow_stops(key, rows, state.get if state.exists else None)
        if run:
            state.update(run)
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    kept = reports.selectExpr(*STOP_COLUMNS)
    return kept.groupBy("vehicle").applyInPandasWithState(advance, STOP_EVENTS, STOP_RUN, "append", GroupStateTimeout.NoTimeout)


_ACCIDENT_EVENTS = "highway LONG, position LONG, kind STRING, segment LONG, at TIMESTAMP, standing INT"


def accidents_stream(stops: DataFrame) -> DataFrame:
    """Follow the rows of ``stopped_vehicles_stream`` per place and report accidents.

    A "started" row comes when a second vehicle stands at a place, an "ended" row when fewer than
    two are left. The state of a place is the number of vehicles standing there. At one instant,
    those who leave and those who arrive count together.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (standing,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches))
        leaving = rows["kind"] == "cleared"
        steps = pd.DataFrame(
            {
                "at": rows["cleared_at"].where(leaving, rows["stopped_at"]),
                "step": leaving.map({True: -1, False: 1}),
                "segment": rows["segment"],
            }
        )
        out = []
        for at, group in steps.groupby("at", sort=True):
            before, standing = standing, standing + int(group["step"].sum())
            if (before >= 2) != (standing >= 2):
                kind = "started" if standing >= 2 else "ended"
                out.append((*key, kind, int(group["segment"].iloc[0]), at, standing))
        if standing:
            state.update((standing,))
        elif state.exists:
            state.remove()  # nobody stands there any more
        frame = pd.DataFrame(out, columns=[part.split()[0] for part in _ACCIDENT_EVENTS.split(", ")])
        frame["at"] = pd.to_datetime(frame["at"])
        if out:
            yield frame

    return stops.groupBy("highway", "position").applyInPandasWithState(
        advance, _ACCIDENT_EVENTS, "standing INT", "append", GroupStateTimeout.NoTimeout
    )
