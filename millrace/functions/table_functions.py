"""Table functions: user code over the ordered rows of a partition of a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass
class Chosen(AnalyzeResult):
    """What the rows of one call look like."""

    keys: tuple[str, ...] = ()
    value: str = ""
    begin: str = ""


class RunLengths:
    """Stretches of neighbours with an equal value: the keys, the value, ``began`` (of the first row) and ``length``.

    Called over ``TABLE(t) PARTITION BY (keys) ORDER BY (order)`` with the names of the keys (comma-separated), of the value and of
    the column that tells when a run began. The result has the types of these columns, whatever the table is. Nulls
    equal each other, a key may be null, an empty table has no runs. A run is all that is held of a key, but one task reads
    the key's rows in their order.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, value: AnalyzeArgument, begin: AnalyzeArgument) -> Chosen:
        if not rows.isTable:
            raise ValueError("run lengths are taken of a table")
        if any(a.value is None for a in (keys, value, begin)):
            raise ValueError("name the columns by constants")
        names = tuple(k.strip() for k in keys.value.split(",") if k.strip())
        types = {f.name: f.dataType for f in rows.dataType.fields}
        unknown = [c for c in (*names, value.value, begin.value) if c not in types]
        if unknown:
            raise ValueError(f"the table has no column {', '.join(unknown)}")
        fields = [T.StructField(c, types[c]) for c in (*names, value.value)]
        schema = T.StructType([*fields, T.StructField("began", types[begin.value]), T.StructField("length", T.LongType())])
        return Chosen(schema=schema, keys=names, value=value.value, begin=begin.value)

    def __init__(self, chosen: Chosen) -> None:
        self.chosen = chosen
        self.run: tuple | None = None
        self.length = 0

    def eval(self, row: Row, keys: str, value: str, begin: str) -> Iterator[tuple[Any, ...]]:
        same = (*(row[k] for k in self.chosen.keys), row[self.chosen.value])
        if self.run is None or self.run[:-1] != same:
            yield from self.terminate()
            self.run, self.length = (*same, row[self.chosen.begin]), 0
        self.length += 1

    def terminate(self) -> Iterator[tuple[Any, ...]]:
        if self.run is not None:
            yield (*self.run, self.length)


def register(spark: SparkSession) -> None:
    """Make ``run_lengths`` known to SQL."""
    spark.udtf.register("run_lengths", F.udtf(RunLengths))


def run_lengths(df: DataFrame, keys: Sequence[str], value: str, begin: str, order_by: Sequence[str]) -> DataFrame:
    """Runs of equal ``value`` along ``order_by`` for each of ``keys``; see ``RunLengths``."""
    table = df.asTable().partitionBy(*keys).orderBy(*order_by)
    return F.udtf(RunLengths)(table, F.lit(",".join(keys)), F.lit(value), F.lit(begin))
