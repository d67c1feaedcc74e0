"""Pieces of checking SQL for windows over event time (lengths in minutes)."""

from __future__ import annotations

from collections.abc import Sequence

MINUTE = 60_000_000
DAY = 24 * 60


def _list(*parts: str) -> str:
    return ", ".join(p for p in parts if p)


def tumbling(source: str, size: int, keys: Sequence[str], aggs: str, where: str = "true") -> str:
    width = size * MINUTE
    slot = f"epoch_us(ts) // {width} * {width}"
    groups = _list("1", "2", *keys)
    columns = _list(
        f"make_timestamp({slot}) AS window_start", f"make_timestamp({slot} + {width}) AS window_end", *keys, aggs
    )
    return f"SELECT {columns} FROM {source} WHERE {where} GROUP BY {groups}"


def sliding(source: str, size: int, slide: int, keys: Sequence[str], aggs: str, where: str = "true") -> str:
    length, step = size * MINUTE, slide * MINUTE
    spread = (
        f"SELECT *, unnest(generate_series((epoch_us(ts) - {length}) // {step} + 1, epoch_us(ts) // {step})) AS k "
        f"FROM {source} WHERE {where}"
    )
    columns = _list(
        f"make_timestamp(k * {step}) AS window_start",
        f"make_timestamp(k * {step} + {length}) AS window_end",
        *keys,
        aggs,
    )
    return f"SELECT {columns} FROM ({spread}) GROUP BY {_list('k', *keys)}"


def average(value: str, name: str) -> str:
    return f"CAST(sum({value}) AS DOUBLE) / count({value}) AS {name}"


def total(value: str, name: str, as_type: str = "DOUBLE") -> str:
    return f"CAST(sum({value}) AS {as_type}) AS {name}"
