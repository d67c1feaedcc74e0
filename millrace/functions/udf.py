"""User code in Python: scalar functions, row generators and aggregates over Arrow batches.

Column expressions are faster wherever they can say the same; ``Agg`` covers the usual aggregates.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD_GROUPS = 50_000
MERGE_SHARES = 32


def scalar(function: Callable[[pd.Series], pd.Series], returns: str) -> Callable[..., Column]:
    """A function of whole columns of values, for ``select`` and ``filter``."""
    return F.pandas_udf(function, returns)


def flat_map(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Replace every batch of rows by any number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class Aggregate:
    """A user-defined aggregate: a new accumulator, how rows enter, how two merge, the result.

    ``update`` receives a batch of the group's rows; ``finish`` returns the values of ``schema``.
    """

    create: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], tuple]
    schema: str


def aggregate(df: DataFrame, keys: Sequence[str], agg: Aggregate) -> DataFrame:
    """Apply a user-defined aggregate per key.

    Every task folds its own rows before the shuffle, so a key that holds most rows sends only one
    small accumulator per task. These are merged in two steps: per key and share, then per key.
    """
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]
    partial_schema = T.StructType([*key_fields, T.StructField("_share", T.IntegerType()), T.StructField("_acc", T.BinaryType())])
    result_schema = T.StructType([*key_fields, *T._parse_datatype_string(agg.schema).fields])
    create, update, merge, finish = agg.create, agg.update, agg.merge, agg.finish
    held_limit, shares = HELD_GROUPS, MERGE_SHARES

    def flush(held: dict, task: int) -> pd.DataFrame:
        rows = [(*key, task % shares, pickle.dumps(acc)) for key, acc in held.items()]
        return pd.DataFrame(rows, columns=[*keys, "_share", "_acc"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False, dropna=False):
                held[key] = update(held[key] if key in held else create(), rows)
            if len(held) > held_limit:
                yield flush(held, task)
                held = {}
        if held:
            yield flush(held, task)

    def combine(accs: pd.Series) -> Any:
        total = create()
        for acc in accs:
            total = merge(total, pickle.loads(acc))
        return total

    def merge_share(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, pickle.dumps(combine(rows["_acc"])))], columns=[*keys, "_share", "_acc"])

    def merge_key(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *finish(combine(rows["_acc"])))], columns=result_schema.names)

    partials = df.mapInPandas(fold, partial_schema)
    shared = partials.groupBy(*keys, "_share").applyInPandas(merge_share, partial_schema)
    return shared.groupBy(*keys).applyInPandas(merge_key, result_schema)
