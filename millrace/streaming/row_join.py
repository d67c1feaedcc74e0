"""Row-window joins of two streams, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import theta_join_rows
from .runner import forget_batch


def row_join_batches(
    path: str,
    sides: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    condition: Column,
    left_rows: int,
    right_rows: int,
    order_by: Sequence[tuple[str, str]],
    on: Sequence[tuple[str, str]] = (),
) -> Callable[[DataFrame, int], None]:
    """A ``write`` for ``run_batches`` that joins as ``theta_join_rows`` does on the whole streams.

    ``sides`` splits a batch of the merged stream into its left and right rows. Each batch is joined
    together with the last rows of either side before it; pairs of two old rows were found before.
    Pairs are kept under ``path/pairs`` (see ``read_batches``), the last rows under ``path/left`` and
    ``path/right``, all by batch, so that a repeated batch starts from the same rows and replaces its
    own results. Streams must arrive in order.
    """

    def write(rows: DataFrame, batch: int) -> None:
        left, right = sides(rows)
        columns = [*left.columns, *right.columns]
        left = _with_last(left, f"{path}/left", batch, "_lnew")
        right = _with_last(right, f"{path}/right", batch, "_rnew")
        fresh = condition & (F.col("_lnew") | F.col("_rnew"))
        pairs = theta_join_rows(left, right, fresh, left_rows, right_rows, order_by, on)
        pairs.select(*columns).write.mode("overwrite").parquet(f"{path}/pairs/batch={batch}")
        for side, name, kept, orders in (
            (left.drop("_lnew"), "left", left_rows, [a for a, _ in order_by]),
            (right.drop("_rnew"), "right", right_rows, [b for _, b in order_by]),
        ):
            last = side.orderBy(*(F.desc(c) for c in orders)).limit(kept)
            last.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
            if batch > 1:
                forget_batch(rows.sparkSession, f"{path}/{name}", batch - 2)

    return write


def _with_last(new: DataFrame, path: str, batch: int, flag: str) -> DataFrame:
    marked = new.withColumn(flag, F.lit(True))
    if batch == 0:
        return marked
    last = new.sparkSession.read.schema(new.schema).parquet(f"{path}/batch={batch - 1}")
    return marked.unionByName(last.withColumn(flag, F.lit(False)))
