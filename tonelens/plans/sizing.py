"""Bounds for everything that leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

#: Most distinct classes a stratified operator accepts.  Class totals are collected, so they are bounded.
MAX_CLASSES = 10_000


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Collect at most ``max_rows`` rows; more is an error, never a silent cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows, refusing to bring them to the driver")
    return rows
