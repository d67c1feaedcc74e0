"""Window definitions: a measure (time or rows), a type, a size, a slide or a gap."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(length: timedelta | int) -> int:
    """A length as microseconds; plain numbers are seconds."""
    if isinstance(length, timedelta):
        return length // timedelta(microseconds=1)
    return int(length) * MICROS


@dataclass(frozen=True)
class WindowSpec:
    """``measure`` is "time" (sizes in microseconds) or "rows"; sessions have only a gap."""

    measure: str
    size: int = 0
    slide: int = 0
    gap: int = 0

    def __post_init__(self) -> None:
        if self.measure not in ("time", "rows"):
            raise ValueError(f"unknown window measure {self.measure!r}")
        if self.gap == 0 and (self.size <= 0 or self.slide <= 0):
            raise ValueError("a window needs a positive size and slide, or a gap")

    @classmethod
    def tumbling(cls, size: timedelta | int) -> WindowSpec:
        return cls("time", micros(size), micros(size))

    @classmethod
    def sliding(cls, size: timedelta | int, slide: timedelta | int) -> WindowSpec:
        return cls("time", micros(size), micros(slide))

    @classmethod
    def session(cls, gap: timedelta | int) -> WindowSpec:
        return cls("time", gap=micros(gap))

    @classmethod
    def rows(cls, size: int, slide: int | None = None) -> WindowSpec:
        return cls("rows", size, slide or size)

    @property
    def is_session(self) -> bool:
        return self.gap > 0

    @property
    def is_tumbling(self) -> bool:
        return not self.is_session and self.size == self.slide

    @property
    def pane(self) -> int:
        """The longest slice that every window is a whole number of."""
        return math.gcd(self.size, self.slide)

    @property
    def ratio(self) -> int:
        """How many windows a row falls into at most."""
        return -(-self.size // self.slide)


def interval(length: int) -> str:
    return f"{length} microseconds"


def floor_div(value: Column, by: int | Column) -> Column:
    """Whole division that rounds down, also below zero."""
    by = by if isinstance(by, Column) else F.lit(by).cast("long")
    return F.call_function("div", value - F.pmod(value, by), by)


def time_slot(ts: str, width: int) -> Column:
    """The number of the ``width``-microsecond slot a timestamp lies in, counted from 1970."""
    return floor_div(F.unix_micros(F.col(ts)), width)
