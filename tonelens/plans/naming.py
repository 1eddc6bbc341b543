"""Names of helper columns that no column of the caller has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
