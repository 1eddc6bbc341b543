"""Label counts over event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _counts(df: DataFrame, ts: str, label: str, late: str, window: Column, keys: list[str]) -> DataFrame:
    return (
        df.withWatermark(ts, late)
        .groupBy(*keys, window.alias("w"), F.col(label).alias("label"))
        .agg(F.count("*").alias("n"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "label", "n")
    )


def tumbling_label_counts(df: DataFrame, width: str, ts: str = "ts", label: str = "label", late: str = "10 minutes") -> DataFrame:
    return _counts(df, ts, label, late, F.window(ts, width), [])


def sliding_label_counts(df: DataFrame, width: str, slide: str, ts: str = "ts", label: str = "label", late: str = "10 minutes") -> DataFrame:
    return _counts(df, ts, label, late, F.window(ts, width, slide), [])


def session_label_counts(df: DataFrame, gap: str, key: str, ts: str = "ts", label: str = "label", late: str = "10 minutes") -> DataFrame:
    """Sessions per key and label: a gap longer than ``gap`` ends one."""
    return _counts(df, ts, label, late, F.session_window(ts, gap), [key])
