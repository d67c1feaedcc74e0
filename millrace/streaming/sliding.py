"""Long overlapping windows of a stream, answered as they close, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Agg
from ..operators.panes import partial_names
from ..operators.time_windows import END, PANE, windows_of_panes
from ..operators.windows import WindowSpec
from .runner import forget_batch


def sliding_batches(
    path: str, spec: WindowSpec, keys: Sequence[str], aggs: Sequence[Agg], exact: bool
) -> Callable[[DataFrame, int], None]:
    """A ``write`` for ``run_batches`` over the closed panes of a stream (``panes_of``, append mode).

    A window is answered, once, as soon as a pane that ends with it or after it has closed; no open window is ever in
    the result. Each batch merges its own panes with those that the windows still open can reach, so the work
    follows the slides and not the overlap times the rows. Windows are kept under ``path/windows`` (see ``read_batches``),
    the reachable panes of the last two batches under ``path/panes``, all by batch: a repeated batch starts from the same panes and replaces
    its own results. ``exact`` as in ``windows_of_panes``.
    """
    keys, aggs = list(keys), list(aggs)

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        panes = rows.select(*keys, PANE, *partial_names(aggs))
        until = F.lit(None).cast("long")
        if batch:
            earlier = spark.read.schema(panes.schema).parquet(f"{path}/panes/batch={batch - 1}")
            # the last pane closed so far is always among those kept
            until = F.lit(earlier.agg(F.max(PANE)).first()[0]).cast("long")
            panes = panes.unionByName(earlier)
        last = F.lit(panes.agg(F.max(PANE)).first()[0]).cast("long")
        kept = panes.filter(F.col(PANE) > last - spec.size // spec.pane)
        kept.write.mode("overwrite").parquet(f"{path}/panes/batch={batch}")
        windows = windows_of_panes(panes, spec, keys, aggs, exact)
        end = F.unix_micros(END)
        closed = (end <= (last + 1) * spec.pane) & (until.isNull() | (end > (until + 1) * spec.pane))
        windows.filter(closed).write.mode("overwrite").parquet(f"{path}/windows/batch={batch}")
        if batch > 1:
            forget_batch(spark, f"{path}/panes", batch - 2)

    return write
