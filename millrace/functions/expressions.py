"""Filters, projections and key expressions used by the workloads."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column) -> Column:
    return functools.reduce(operator.and_, conditions)


def any_of(*conditions: Column) -> Column:
    return functools.reduce(operator.or_, conditions)


def one_of(value: str, ids: Iterable) -> Column:
    return F.col(value).isin(list(ids))


def int_div(value: str | Column, by: int) -> Column:
    """Whole division that cuts off the fraction; ``/`` on whole numbers would give a double."""
    return F.call_function("div", F.col(value) if isinstance(value, str) else value, F.lit(by).cast("long"))


def project_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Columns by position."""
    return df.select(*(df.columns[i] for i in positions))


def hash_bucket(value: str | Column, factor: int, offset: int, buckets: int) -> Column:
    """A linear hash of a whole number into ``buckets`` classes, never negative.

    The value is reduced first, so the product cannot overflow.
    """
    column = F.col(value) if isinstance(value, str) else value
    classes = F.lit(buckets)
    return F.pmod(F.pmod(column, classes) * (factor % buckets) + offset % buckets, classes)


def composite_key(*parts: str) -> Column:
    """One text key from several columns, different for different values.

    The separator keeps (1, 23) apart from (12, 3); separators and backslashes inside a part are escaped, and a null
    part is ``\\N``.
    """
    escaped = (F.regexp_replace(F.col(p).cast("string"), r"([\\-])", r"\\$1") for p in parts)
    return F.concat_ws("-", *(F.coalesce(e, F.lit("\\N")) for e in escaped))
