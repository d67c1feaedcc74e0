"""Vectors packed into blocks of bounded size, so that a block is one row and two blocks make a tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage


def numbered(vectors: DataFrame, id: str, vector: str, label: str | None = None) -> DataFrame:
    """``(row, vec_id, label, vector, width)``, written once so that ``row`` stays what it is.

    ``width`` is the length of a vector that can take part, and null for all others: null and empty ones, and those
    that hold a null or a value that is not finite.
    """
    labelled = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    narrow = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id}`").cast("long").alias("vec_id"),
        labelled.alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector")
        if dict(vectors.dtypes)[vector] != "array<float>"
        else F.col(f"`{vector}`").alias("vector"),
    )
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return stage(narrow.withColumn("width", F.when((F.size("vector") > 0) & finite, F.size("vector"))), "vectors")


def share_of(row: Column, shares: Column) -> Column:
    """The block of a row among ``shares`` blocks."""
    return F.pmod(F.xxhash64(row), shares).cast("long")


def packed(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per block with all its vectors; the keys bound how many these are."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("row", "vec_id", "vector")).alias("members"))


def unpack(members: pa.ListScalar, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and vectors (as doubles) of a block, without those that take no part, sorted by row.

    A vector takes no part if it is null, not ``width`` long, or holds a null or a value that is not finite.
    """
    block = members.values
    rows = block.field("row").to_numpy(zero_copy_only=False)
    ids = block.field("vec_id").to_pylist()
    vectors = block.field("vector")
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    usable = (lengths == width) & (width > 0)
    matrix = np.zeros((len(block), width))
    if usable.any():
        values = vectors.filter(pa.array(usable)).flatten().cast(pa.float64())
        matrix[usable] = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    usable &= np.isfinite(matrix).all(axis=1)
    order = np.argsort(rows, kind="stable")
    order = order[usable[order]]
    return rows[order].astype(np.int64), np.array(ids, dtype=object)[order], matrix[order]
