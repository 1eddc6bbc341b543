"""From raw rows to the labelled corpus: project, drop nulls, clean, keep the first of equal texts, drop empties."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tonelens.functions.text import clean_text


def to_labelled(df: DataFrame, text: str, label: str, row_id: str) -> DataFrame:
    """Rename and narrow to ``row_id, text, label``; rows with a null text or label go (before cleaning)."""
    present = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull())  # reaches the scan, turns outer joins inner
    return present.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, clean_text(F.col(text)))


def fill_missing_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Null text counts as empty text when features are built."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def dedup_keep_first(df: DataFrame, text: str = "text", order: str = "row_id", keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """One row per text: the one with the smallest ``order``, with its ``keep`` columns.

    The text is the grouping key, so each distinct text is shuffled once and a group of copies, however large,
    shrinks to one row per task before the shuffle.
    """
    firsts = [F.min_by(c, order).alias(c) for c in keep]
    return df.groupBy(text).agg(F.min(order).alias(order), *firsts).select(order, text, *keep)


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.length(text) > 0)


def prepare_corpus(df: DataFrame, text: str, label: str, row_id: str) -> DataFrame:
    """The whole preparation, in the order that matters: null rows, cleaning, duplicates, empties.

    Emptiness is carried through the grouping as a length: a filter on the text itself would be pushed below it and
    clean every text a second time.
    """
    labelled = clean(to_labelled(df, text, label, row_id)).withColumn("_len", F.length("text"))
    return dedup_keep_first(labelled, keep=("label", "_len")).filter(F.col("_len") > 0).drop("_len")


def duplicate_count(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that repeat an earlier text.

    Counted over groups of equal digests, so that hot texts combine before the shuffle and no text is shuffled.
    """
    per_text = df.groupBy(F.sha2(F.col(text), 256)).agg(F.count("*").alias("n"))
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )
