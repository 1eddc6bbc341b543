"""Admission rules for messages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tonelens.functions.text import strip_blanks

# The admission limits.
MAX_MESSAGE_CHARS = 2000
MAX_CONVERSATION_MESSAGES = 20
#: What :func:`message_reject_reason` can give.
REJECT_REASONS = ["missing", "empty", "too_long", "blank"]


def message_reject_reason(text: Column) -> Column:
    """Null when the message is admitted.  Length is measured before blanks are stripped."""
    return (
        F.when(text.isNull(), "missing")
        .when(F.length(text) < 1, "empty")
        .when(F.length(text) > MAX_MESSAGE_CHARS, "too_long")
        .when(F.length(strip_blanks(text)) < 1, "blank")
    )


def check_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``reject_reason``; admitted rows have null there."""
    return df.withColumn("reject_reason", message_reject_reason(F.col(text)))


def admitted_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Admitted rows with the text stripped, as the scorers see it."""
    checked = check_messages(df, text).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return checked.withColumn(text, strip_blanks(F.col(text)))


def check_conversations(df: DataFrame, conv: str = "conv_id", text: str = "text") -> DataFrame:
    """One row per conversation: message counts and ``reject_reason`` (blanks count towards the limit)."""
    filled = F.length(strip_blanks(F.coalesce(F.col(text), F.lit("")))) > 0
    counts = df.groupBy(conv).agg(F.count("*").alias("n_messages"), F.count_if(filled).alias("n_valid"))
    return counts.withColumn(
        "reject_reason",
        F.when(F.col("n_messages") > MAX_CONVERSATION_MESSAGES, "too_many").when(F.col("n_valid") == 0, "blank"),
    )


def admitted_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Non-blank messages, stripped, of admitted conversations.

    One row over the limit is enough to know that a conversation is too long, so the ranked filter keeps at most
    that many rows of each conversation per task before the shuffle: a conversation with any number of messages
    costs no more than an admitted one.
    """
    by_turn = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    head = df.withColumn("_rn", F.row_number().over(by_turn)).filter(F.col("_rn") <= MAX_CONVERSATION_MESSAGES + 1)
    sized = head.withColumn("_n", F.max("_rn").over(Window.partitionBy(conv)))
    return (
        sized.filter(F.col("_n") <= MAX_CONVERSATION_MESSAGES)
        .withColumn(text, strip_blanks(F.col(text)))
        .filter(F.length(text) > 0)
        .drop("_rn", "_n")
    )
