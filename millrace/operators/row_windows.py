"""Windows measured in rows: every N rows, or N rows every M rows, in stream order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Agg
from .order import with_row_index
from .panes import pane_aggregate, windows_from_panes
from .stretches import listed, row_window_counts
from .windows import WindowSpec, floor_div

INDEX = "row_index"


def row_window_aggregate(
    df: DataFrame,
    spec: WindowSpec,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    aggs: Sequence[Agg] = (),
    where: Column | None = None,
    complete_only: bool = True,
    stretch: tuple[str, str] | None = None,
) -> DataFrame:
    """Aggregate per row window and key.

    Window ``window_index`` holds the rows ``index * slide`` … ``index * slide + size - 1`` of the
    whole stream. ``where`` selects rows after they were numbered, so it does not move window
    edges. Unfinished windows at the end are left out unless ``complete_only`` is off.

    With ``stretch`` a row of ``df`` stands for a row at each number from the first column up to before the second, and the
    order begins with that number; see ``window_stretches``. Counts of windows end to end list these rows inside tasks only.
    """
    keys, aggs, order_by = list(keys), list(aggs), list(order_by)
    if spec.measure != "rows":
        raise ValueError("a row window needs WindowSpec.rows")
    if stretch:
        if spec.size == spec.slide and where is None and [a.kind for a in aggs] == ["count"]:
            return row_window_counts(df, stretch, spec.size, order_by, keys, aggs[0].name, complete_only)
        df, order_by = listed(df, stretch, "_number"), ["_number", *order_by]
    indexed = with_row_index(df, order_by, name=INDEX)
    kept = indexed.filter(where) if where is not None else indexed
    panes = pane_aggregate(kept, floor_div(F.col(INDEX), spec.pane), keys, aggs, "_pane")
    exact = all(a.invertible(df) for a in aggs)
    merged = windows_from_panes(panes, keys, "_pane", aggs, spec.size // spec.pane, spec.slide // spec.pane, exact)
    merged = merged.filter("window_index >= 0")
    if complete_only:
        rows = indexed.agg(F.max(INDEX) + 1).scalar()
        merged = merged.filter(F.col("window_index") * spec.slide + spec.size <= rows)
    return merged.select("window_index", *keys, *(a.finish() for a in aggs))
