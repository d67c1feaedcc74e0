"""Aggregates that can be computed directly, or as partials that merge later.

A window over panes needs every aggregate twice: once per pane and once over the panes. Each
``Agg`` therefore knows its partial columns, how partials merge, and the final expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


@dataclass(frozen=True)
class Partial:
    """One mergeable column: how rows fold into it and how two of them combine."""

    name: str
    fold: Column
    additive: bool
    sketch: bool = False

    def combine(self, value: Column) -> Column:
        if self.sketch:
            return F.kll_merge_agg_double(value)
        fold = F.sum if self.additive else (F.min if self.name.endswith("min") else F.max)
        return fold(value)

    def merge(self) -> Column:
        return self.combine(F.col(self.name)).alias(self.name)


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class Agg:
    """An aggregate named ``name``; build with the functions below."""

    kind: str
    name: str
    value: str | Column | None = None
    weight: str | Column | None = None
    ranks: tuple[float, ...] = ()
    size: int = 0

    def partials(self) -> list[Partial]:
        prefix = f"_{self.name}"
        if self.kind == "count":
            return [Partial(f"{prefix}_rows", F.count(F.lit(1)), True)]
        value = _column(self.value)
        if self.kind == "min":
            return [Partial(f"{prefix}_min", F.min(value), False)]
        if self.kind == "max":
            return [Partial(f"{prefix}_max", F.max(value), False)]
        if self.kind == "quantiles":
            number = value.cast("double")
            number = F.when(~F.isnan(number), number)
            return [Partial(f"{prefix}_sketch", F.kll_sketch_agg_double(number, self.size), False, True)]
        if self.kind == "weighted_avg":
            weight = F.when(value.isNotNull(), _column(self.weight))
            return [
                Partial(f"{prefix}_total", F.sum(value * weight), True),
                Partial(f"{prefix}_weight", F.sum(weight), True),
            ]
        return [
            Partial(f"{prefix}_total", F.sum(value), True),
            Partial(f"{prefix}_rows", F.count(value), True),
        ]

    def finish(self, columns: Mapping[str, str] | None = None) -> Column:
        """The result over merged partial columns; ``columns`` says where partials lie that have other names."""
        prefix = f"_{self.name}"

        def merged(partial: str) -> Column:
            name = f"{prefix}_{partial}"
            return F.col(columns[name] if columns else name)

        if self.kind == "count":
            out = merged("rows")
        elif self.kind in ("min", "max"):
            out = merged(self.kind)
        elif self.kind == "sum":
            out = F.when(merged("rows") > 0, merged("total"))
        elif self.kind == "quantiles":
            out = self._asked(merged("sketch"))
        else:
            below = merged("weight" if self.kind == "weighted_avg" else "rows")
            out = F.when(below != 0, merged("total").cast("double") / below.cast("double"))
        return out.alias(self.name)

    def direct(self) -> Column:
        """The result in one step, for windows that do not overlap."""
        if self.kind == "count":
            out = F.count(F.lit(1))
        elif self.kind == "sum":
            out = F.sum(_column(self.value))
        elif self.kind in ("min", "max"):
            out = getattr(F, self.kind)(_column(self.value))
        elif self.kind == "quantiles":
            out = self._asked(self.partials()[0].fold)
        else:
            above, below = (p.fold for p in self.partials())
            out = F.when(below != 0, above.cast("double") / below.cast("double"))
        return out.alias(self.name)

    def _asked(self, sketch: Column) -> Column:
        quantiles = F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, self.ranks)))
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, quantiles)  # an empty sketch cannot be asked

    def invertible(self, df: DataFrame) -> bool:
        """True when leaving rows can be subtracted again without a rounding error."""
        if self.kind == "count":
            return True
        if self.kind in ("min", "max", "quantiles"):
            return False
        inputs = [_column(c) for c in (self.value, self.weight) if c is not None]
        return all(isinstance(f.dataType, EXACT_TYPES) for f in df.select(*inputs).schema)


def count(name: str = "n") -> Agg:
    return Agg("count", name)


def sum_of(value: str | Column, name: str) -> Agg:
    return Agg("sum", name, value)


def min_of(value: str | Column, name: str) -> Agg:
    return Agg("min", name, value)


def max_of(value: str | Column, name: str) -> Agg:
    return Agg("max", name, value)


def avg_of(value: str | Column, name: str) -> Agg:
    return Agg("avg", name, value)


def weighted_avg_of(value: str | Column, weight: str | Column, name: str) -> Agg:
    return Agg("weighted_avg", name, value, weight)


def quantiles_of(value: str | Column, name: str, ranks: Sequence[float], size: int = 400) -> Agg:
    """An array with about the quantiles at ``ranks`` (0 to 1) of the numbers, from mergeable sketches of bounded size.

    The rank of each is off by no more than ``rank_error(size)``. Nulls and NaN are left out; without numbers the array is null.
    """
    return Agg("quantiles", name, value, ranks=tuple(ranks), size=size)


def rank_error(size: int) -> float:
    """Twice what the sketch states for 99 of 100 quantiles, so that a miss is not met in practice."""
    return 2 * 2.296 / size**0.9723
