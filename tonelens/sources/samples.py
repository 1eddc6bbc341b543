"""Small labelled samples as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tonelens.operators.metrics import with_label_names


def labelled_sample(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    """``(row_id, text, label_id, label)`` from in-code pairs of text and label id."""
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(rows)], "row_id long, text string, label_id int")
    return with_label_names(df, "label_id", "label")


def expectation_sample(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """``(text, expected)`` from in-code pairs of text and expected label name."""
    return spark.createDataFrame(rows, "text string, expected string")


def with_extra(sample: DataFrame, extra: DataFrame | None) -> DataFrame:
    """The caller's own samples behind the built-in ones."""
    return sample if extra is None else sample.unionByName(extra.select(*[F.col(c) for c in sample.columns]))


# The built-in stress sample (friendly wording, hostile meaning).
STRESS_SAMPLES = [
    ("Oh wow, you're absolutely brilliant for doing that.", "Sarcastic"),
    ("What a fantastic idea, I'm sure it'll work out great.", "Sarcastic"),
    ("You're so smart, I'm amazed you managed to tie your shoes today.", "Sarcastic"),
    ("Sure, because that totally makes sense.", "Sarcastic"),
    ("Oh, clearly you know best about everything.", "Sarcastic"),
    ("Great job breaking everything again.", "Sarcastic"),
    ("Yeah, right, I'm sure you didn't mean it.", "Sarcastic"),
    ("Oh how wonderful, another delay.", "Sarcastic"),
    ("Brilliant, just what we needed.", "Sarcastic"),
    ("You're such a great friend, always there when it's convenient for you.", "Sarcastic"),
]
