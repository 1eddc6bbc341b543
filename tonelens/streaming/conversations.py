"""Audit conversations as their messages arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonelens.functions.text import strip_blanks
from tonelens.operators.conversation import COUNT_COLS, RECENT, WINDOW, severity_points, verdict_columns
from tonelens.operators.lexicon import DEFAULT_LEXICON, Lexicon
from tonelens.operators.messages import score_messages
from tonelens.streaming.accounting import outcomes

_STATE = "seen array<struct<ts: timestamp, turn: bigint, label: string, severity: string>>"
_EMIT_ROWS = 10_000


def _milliseconds(interval: str) -> int:
    """Length of an interval such as ``10 minutes``."""
    return int(pd.Timedelta(interval) / pd.Timedelta(milliseconds=1))


def _windows(idle_ms: int, late_ms: int):
    idle = np.timedelta64(idle_ms, "ms")

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Per conversation: the window of every new message, from the messages before it in time.

        The state keeps the messages that a later one may still need: those not older than the watermark allows, and
        the four before them.  A gap of more than the idle time starts a new window.  What a micro-batch may hold is
        bounded by the source's rate limit (``max_files`` of the file source).
        """
        if state.hasTimedOut:
            state.remove()
            return
        columns = ["ts", "turn", "label", "severity"]
        known = pd.DataFrame([tuple(r) for r in state.get[0]] if state.exists else [], columns=columns)
        parts = [known.astype({"ts": "datetime64[us]", "turn": "int64"}).assign(new=False), *(b[columns].assign(new=True) for b in batches)]
        rows = pd.concat([p for p in parts if len(p)], ignore_index=True).sort_values(["ts", "turn"], kind="stable", ignore_index=True)
        at = rows["ts"].to_numpy().astype("datetime64[us]")
        place = np.arange(len(rows))
        begins = np.maximum.accumulate(np.where(np.append(True, np.diff(at) > idle), place, 0))
        first = np.maximum(begins, place - (WINDOW - 1))
        labels, severities, fresh = rows["label"].to_numpy(), rows["severity"].to_numpy(), np.flatnonzero(rows["new"])
        for start in range(0, len(fresh), _EMIT_ROWS):
            own = fresh[start : start + _EMIT_ROWS]
            part = rows.iloc[own][columns].assign(conv_id=key[0])
            part["labels"] = [labels[first[i] : i + 1] for i in own]
            part["severities"] = [severities[first[i] : i + 1] for i in own]
            yield part[["conv_id", *columns, "labels", "severities"]]
        newest = int(at[-1].astype("datetime64[ms]").astype(int))
        mark = min(state.getCurrentWatermarkMs(), newest)
        needed = max(0, min(int(np.searchsorted(at, np.datetime64(mark, "ms"))), len(rows) - 1) - (WINDOW - 1))
        state.update(([(t.to_pydatetime(), int(n), l, s) for t, n, l, s in rows.iloc[needed:][columns].itertuples(index=False)],))
        state.setTimeoutTimestamp(max(newest + idle_ms + late_ms, state.getCurrentWatermarkMs() + 1))

    return step


def window_verdicts(windows: DataFrame) -> DataFrame:
    """Verdict columns from the emitted label and severity windows (oldest first): a projection."""
    def times(label: str):
        return F.size(F.filter("labels", lambda x: x == label)).cast("long")

    counts = {name: times(l) for l, name in COUNT_COLS.items()}
    recent = F.slice("labels", F.greatest(F.size("labels") - (RECENT - 1), F.lit(1)), RECENT)
    points = F.aggregate(
        F.transform("severities", lambda s: severity_points(s).cast("double")), F.lit(0.0), lambda a, x: a + x
    )
    staged = windows.withColumns(
        {
            **counts,
            "n_window": F.size("labels").cast("long"),
            "n_recent_toxic": F.size(F.filter(recent, lambda x: x != "Sincere")).cast("long"),
            "mean_points": points / F.size("severities"),
        }
    )
    return verdict_columns(staged).drop("labels", "severities")


def scored_turns(stream: DataFrame, lexicon: Lexicon, prob: str | None, conv: str, turn: str, text: str, ts: str) -> DataFrame:
    """``conv_id, ts, turn, label, severity`` of the non-blank messages: a projection."""
    spoken = stream.withColumn(text, strip_blanks(F.col(text))).filter(F.length(text) > 0)
    return score_messages(spoken, lexicon, text, prob).select(
        F.col(conv).alias("conv_id"), F.col(ts).alias("ts"), F.col(turn).cast("long").alias("turn"), "label", "severity"
    )


def audit_stream(
    stream: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    prob: str | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    ts: str = "ts",
    late: str = "10 minutes",
    idle_ms: int = 3_600_000,
    account: str | None = None,
) -> DataFrame:
    """The audit after every message of a stream ``(conv, turn, text, ts)``.

    Messages are scored before the stateful step, so only label and severity are shuffled and kept.  A message's window
    is itself and the four before it in time that have arrived, back to a gap of more than ``idle_ms``; where messages
    arrive in order of time it does not depend on how they are cut into batches.  A late one within the watermark gets
    the window of its own time; windows that went out before it came stay as they are.  Messages behind the watermark
    are dropped.  The state of a conversation is its messages since the watermark and four more, and goes once the
    watermark is past the idle time after the last one.

    ``account`` names two observations, ``<account>_in`` (all rows, spoken and blank ones) and ``<account>_out`` (audited
    ones); ``accounting.account`` adds the late rows, and input = blank + late + audited.
    """
    if account:
        blank = F.when(F.length(strip_blanks(F.coalesce(F.col(text), F.lit("")))) == 0, "blank")
        stream = stream.observe(f"{account}_in", *outcomes(blank, ["blank"]))
    scored = scored_turns(stream, lexicon, prob, conv, turn, text, ts)
    key_type = scored.schema["conv_id"].dataType.simpleString()
    windows = (
        scored.withWatermark("ts", late)
        .groupBy("conv_id")
        .applyInPandasWithState(
            _windows(idle_ms, _milliseconds(late)),
            f"conv_id {key_type}, ts timestamp, turn bigint, label string, severity string, "
            "labels array<string>, severities array<string>",
            _STATE,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    if account:
        windows = windows.observe(f"{account}_out", F.count("*").alias("n_audited"))
    return window_verdicts(windows)
