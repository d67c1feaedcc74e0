"""What the operators share: reading tables, staging, and functions on Arrow batches.

Rows here hold whole texts or blocks of vectors. Spark bounds an Arrow batch by bytes as well as by rows
(``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB), so no operator changes a setting of the session.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.views import table
from ..session import stage

__all__ = ["stage", "table", "text_rows", "arrow_map", "portions", "fresh", "float_matrix", "let_go"]

PORTION = 256  # rows that a task turns into Python values at once


def portions(batches: Iterator[pa.RecordBatch], rows: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, without a copy: an Arrow batch may hold 10,000 texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def let_go(spark: SparkSession) -> None:
    """Have the shuffles of tables that nobody refers to any more removed now.

    Spark removes them once the driver's collector has found them unused, which it looks for only when the driver's memory
    fills: the shuffles of several passes over large tables lie on the executors' disks side by side until then.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has, whatever the case: helper columns must not clash with the user's."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def arrow_map(
    df: DataFrame, handle: Callable[[pa.RecordBatch], Iterable[dict[str, Sequence]]], schema: str
) -> DataFrame:
    """``mapInArrow`` for functions that turn one batch into dictionaries of columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = [_arrow_type(f.split()[1]) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            for columns in handle(batch):
                arrays = [
                    c if isinstance(c := columns[n], pa.Array) else pa.array(c, type=t)
                    for n, t in zip(names, types, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def _arrow_type(name: str) -> pa.DataType:
    return {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "string": pa.string(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
    }[name]


def text_rows(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def float_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a float64 matrix, and which rows take part.

    A row takes no part when its vector is null or empty, holds a null or a value that is not finite, or
    has another length than the longest vector of the batch; its row of the matrix is zero.
    """
    lengths = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
    width = int(lengths.max(initial=0))
    matrix = np.zeros((len(column), max(width, 0)))
    usable = (lengths == width) & (width > 0)
    if usable.any():
        rows = column.filter(pa.array(usable)).flatten().cast(pa.float64())
        values = np.asarray(rows.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
        matrix[usable] = values
        finite = np.isfinite(matrix).all(axis=1)
        matrix[~finite] = 0.0
        usable &= finite
    return matrix, usable


def blocks_for(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def salted(df: DataFrame, name: str, salts: int, *columns: str) -> DataFrame:
    """Add ``name``, a number below ``salts`` that depends on the row's own values only."""
    return df.withColumn(name, F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
