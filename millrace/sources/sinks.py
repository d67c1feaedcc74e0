"""Where results go: nowhere (to measure), files that grow, or a function per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame


def drop_result(df: DataFrame) -> None:
    """Run the whole plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def append_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add the rows to the files under ``path``."""
    df.write.format(fmt).mode("append").save(path)
