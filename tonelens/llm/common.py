"""Shared by the operators: column expressions, digests, and what a scan's rows are called by."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the white space that separates words, U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside a CASE branch that may never run."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of anything but white space; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def set_aside(df: DataFrame, names) -> dict[str, str]:
    """Free names for the columns of ``df`` that are called like one of ``names``, in any case of letters."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    found = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            free = f"_kept_{c}"
            while free.lower() in taken:
                free = "_" + free
            taken.add(free.lower())
            found[c] = free
    return found


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 8 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in runs of bounded text and number; a run holds one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(int(np.searchsorted(ends, before + most_bytes, side="right")), start + most_rows))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """The texts as bytes, a null one as none."""
    return [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per array."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


class Steps:
    """Sequences of different lengths laid out step by step: all first elements, all second ones, and so on.

    Sequences go by falling length, so those that still run at a step are a prefix of those of the step before.
    """

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        ranked = lengths[self.order]
        longest = int(ranked[0]) if len(ranked) else 0
        self.running = len(ranked) - np.searchsorted(ranked[::-1], np.arange(longest), side="right")
        self.starts = np.concatenate([[0], np.cumsum(self.running)])
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(self.order))
        step = np.arange(lengths.sum())
        step -= np.repeat(np.cumsum(lengths) - lengths, lengths)
        #: place in the layout of each element, given in the order of the sequences
        self.place = self.starts[step]
        del step
        self.place += np.repeat(rank, lengths)

    def __len__(self) -> int:
        return len(self.running)

    def at(self, step: int) -> slice:
        return slice(int(self.starts[step]), int(self.starts[step + 1]))

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.place] = values
        return out
