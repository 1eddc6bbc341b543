"""Score a stream of messages; rejected ones go to their own sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonelens.functions.text import strip_blanks
from tonelens.operators.lexicon import DEFAULT_LEXICON, Lexicon
from tonelens.operators.messages import score_messages, with_highlights
from tonelens.operators.requests import REJECT_REASONS, check_messages
from tonelens.streaming.accounting import outcomes

#: Name of the observation that counts a scoring stream's rows.
ACCOUNT = "messages"


def scored_stream(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, text: str = "text", prob: str | None = None) -> DataFrame:
    """Admitted messages with their analysis (``reject_reason`` null) and rejected ones with the reason.

    Stateless: the same expressions as in batch, on a stream or a table.
    """
    checked = check_messages(df, text).withColumn(
        text, F.when(F.col("reject_reason").isNull(), strip_blanks(F.col(text))).otherwise(F.col(text))
    )
    return with_highlights(score_messages(checked, lexicon, text, prob), lexicon, text)


def start_scoring(
    stream: DataFrame,
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
    lexicon: Lexicon = DEFAULT_LEXICON,
    text: str = "text",
    prob: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Run :func:`scored_stream` into two Parquet folders, one sub-folder per batch.

    A batch that is retried after a failure overwrites its own sub-folder, so both sinks see every row once.
    Counts of admitted and rejected rows are observed as ``ACCOUNT``: ``accounting.account(query, ACCOUNT)``.
    """
    kept = stream.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good = batch.filter(F.col("reject_reason").isNull()).drop("reject_reason")
            bad = batch.filter(F.col("reject_reason").isNotNull()).select(*kept, "reject_reason")
            good.write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        scored_stream(stream, lexicon, text, prob)
        .observe(ACCOUNT, *outcomes(F.col("reject_reason"), REJECT_REASONS))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
