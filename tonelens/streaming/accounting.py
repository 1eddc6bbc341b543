"""Where the rows of a stream went: admitted, rejected by reason, late, sent on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "n_late"
LAST = "last_batch"


def outcomes(reason: Column, reasons: list[str]) -> list[Column]:
    """Counts for ``observe``: all rows, those without a reason, and those of each reason; together they are all rows."""
    each = [F.count_if(reason == r).alias(f"n_{r}") for r in reasons]
    return [F.count("*").alias("n_input"), F.count_if(reason.isNull()).alias("n_admitted"), *each]


def account(query: StreamingQuery, *names: str, after: int = -1, first: int = 0) -> dict[str, int]:
    """Totals of the observations ``names`` over the batches behind ``after``, from the query's progress.

    ``n_late`` counts the rows that the stateful steps dropped behind the watermark: exact where rows reach the state as
    they are (the conversation audit); a windowed count drops groups that its tasks have formed before.
    ``last_batch`` is what to pass as ``after`` the next time; ``first`` is the first batch of a restarted query.  Spark keeps the latest progress only
    (``spark.sql.streaming.numRecentProgressUpdates``): where batches are gone that were never read, this is an error.
    """
    events = [p for p in query.recentProgress if p.batchId > after]
    if events and min(p.batchId for p in events) > max(after, first - 1) + 1:
        raise ValueError(f"progress of batches {after + 1} to {min(p.batchId for p in events) - 1} is gone; read accounts more often")
    totals: dict[str, int] = {LATE: 0, LAST: after}
    for p in events:
        for name in names:
            row = p.observedMetrics.get(name)
            for field, value in row.asDict().items() if row else ():
                totals[field] = totals.get(field, 0) + value
        totals[LATE] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        totals[LAST] = max(totals[LAST], p.batchId)
    return totals


def account_table(spark: SparkSession, query: StreamingQuery, *names: str) -> DataFrame:
    """:func:`account` as rows ``(outcome, n)``."""
    totals = account(query, *names)
    totals.pop(LAST)
    return spark.createDataFrame([(k.removeprefix("n_"), v) for k, v in sorted(totals.items())], "outcome string, n long")
