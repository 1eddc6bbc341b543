"""Conversation audit over the last five messages, once per conversation or at every turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tonelens.functions.text import strip_blanks
from tonelens.operators.lexicon import DEFAULT_LEXICON, Lexicon
from tonelens.operators.messages import all_scores, score_messages, with_guidance, with_highlights
from tonelens.operators.requests import admitted_conversations
from tonelens.plans.workdir import materialise

# Window sizes and thresholds of the audit.
WINDOW = 5
RECENT = 3
TOXIC_FOR_PATTERN = 2
SEVERITY_POINTS = {"low": 1, "medium": 2, "high": 3}
OVERALL_HIGH = 2.5
OVERALL_MEDIUM = 1.5

#: Order in which the dominant label wins ties.
DOMINANT_ORDER = ["Sarcastic", "Passive-Aggressive", "Gaslighting"]

COUNT_COLS = {
    "Sincere": "n_sincere",
    "Sarcastic": "n_sarcastic",
    "Passive-Aggressive": "n_passive",
    "Gaslighting": "n_gaslighting",
}


def severity_points(severity: Column) -> Column:
    points = F.lit(None)
    for name, p in SEVERITY_POINTS.items():
        points = F.when(severity == name, p).otherwise(points)
    return points


def dominant_label(counts: dict[str, Column]) -> Column:
    """The most frequent toxic label, ``Sincere`` when there is none."""
    most = F.greatest(*[counts[l] for l in DOMINANT_ORDER])
    pick = F.when(most == 0, "Sincere")
    for l in DOMINANT_ORDER:
        pick = pick.when(counts[l] == most, l)
    return pick


def overall_severity(mean_points: Column) -> Column:
    return F.when(mean_points >= OVERALL_HIGH, "high").when(mean_points >= OVERALL_MEDIUM, "medium").otherwise("low")


def context_note(n: Column, dominant: Column, toxic: Column, pattern: Column, escalation: Column) -> Column:
    """One sentence or two with the window size, the dominant label, the toxic count and the trend."""
    found = F.concat(
        toxic.cast("string"),
        F.lit(" of the last "),
        n.cast("string"),
        F.lit(" messages are hostile, mostly "),
        dominant,
        F.lit(". "),
    )
    trend = F.when(escalation, "The most recent messages show it escalating.").otherwise("It persists across the window.")
    return F.when(pattern, F.concat(found, trend)).otherwise("No recurring hostile pattern in this window.")


def result_banner(escalation: Column, pattern: Column) -> Column:
    return F.when(escalation, "escalating").when(pattern, "pattern").otherwise("none")


def verdict_columns(df: DataFrame) -> DataFrame:
    """From window counts (``n_window``, ``n_recent_toxic``, label counts, ``mean_points``) to the verdict columns."""
    c = F.col
    counts = {l: c(name) for l, name in COUNT_COLS.items()}
    toxic = c("n_sarcastic") + c("n_passive") + c("n_gaslighting")
    staged = df.withColumns(
        {
            "n_toxic": toxic,
            "pattern_detected": toxic >= TOXIC_FOR_PATTERN,
            "dominant_pattern": dominant_label(counts),
            "escalation_detected": (c("n_window") >= RECENT) & (c("n_recent_toxic") >= 2),
            "overall_severity": overall_severity(c("mean_points")),
        }
    )
    return staged.withColumns(
        {
            "context_note": context_note(
                c("n_window"), c("dominant_pattern"), c("n_toxic"), c("pattern_detected"), c("escalation_detected")
            ),
            "banner": result_banner(c("escalation_detected"), c("pattern_detected")),
        }
    ).drop("n_recent_toxic", "mean_points")


def last_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn", n: int = WINDOW) -> DataFrame:
    """The last n messages of each conversation with ``rn`` counted from the end (1 = last).

    The ranked filter is applied before the shuffle too, so a conversation sends n rows per task.
    """
    newest = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    return df.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)


def audit_scored(scored: DataFrame, conv: str = "conv_id", turn: str = "turn", results: bool = False) -> DataFrame:
    """Verdict per conversation from its last five scored messages (ranked by :func:`last_messages`).

    With ``results`` the five analysed messages are kept, in turn order, as ``individual_results``; that list has
    at most five entries.
    """
    c = F.col
    aggs = [F.count_if(c("label") == l).alias(name) for l, name in COUNT_COLS.items()]
    aggs += [
        F.count("*").alias("n_window"),
        F.count_if((c("rn") <= RECENT) & (c("label") != "Sincere")).alias("n_recent_toxic"),
        F.avg(severity_points(c("severity"))).alias("mean_points"),
    ]
    if results:
        item = F.struct(
            c(turn).alias("turn"),
            c("text").alias("message"),
            c("label"),
            c("confidence"),
            all_scores().alias("all_scores"),
            c("severity"),
            c("pattern_highlights"),
        )
        aggs.append(F.array_sort(F.collect_list(item)).alias("individual_results"))
    return verdict_columns(scored.groupBy(conv).agg(*aggs))


def audit_conversations(
    df: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    prob: str | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    results: bool = False,
    guidance: DataFrame | None = None,
) -> DataFrame:
    """Full audit: admission, last five messages, scoring, verdict, guidance where a table of it is given.

    Only the rows of the window are scored, and the two rankings and the aggregation share one shuffle on the
    conversation.
    """
    admitted = admitted_conversations(df, conv, turn, text)
    scored = score_messages(last_messages(admitted, conv, turn), lexicon, text, prob)
    if results:
        scored = with_highlights(scored, lexicon, text).withColumnRenamed(text, "text")
    verdicts = audit_scored(scored, conv, turn, results)
    return verdicts if guidance is None else with_guidance(verdicts, guidance, "dominant_pattern")


def rolling_verdicts(
    scored: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    chunk_turns: int | None = 10_000,
    ts: str | None = None,
    chunk_seconds: int = 3600,
    emit: str | None = None,
) -> DataFrame:
    """The audit as it stood after every message, from scored messages ``(conv, turn, label, severity, ...)``.

    Messages are ordered by turn, or by time and turn when ``ts`` is given.  A conversation may hold any share of all
    rows, so it is cut into chunks (``chunk_turns`` turn numbers or ``chunk_seconds``) that are windowed
    independently.  A chunk needs the four messages before it: they come from the chunks' own last four rows, and
    travel along as carried rows that are not emitted.  With neither ``chunk_turns`` nor ``ts`` every conversation is
    one chunk, nothing is carried and nothing is written.  ``emit`` names a boolean column: rows where it is false count, but get no
    verdict of their own.
    """
    order = [ts, turn] if ts else [turn]
    carried = ~F.col(emit) if emit else F.lit(False)
    base = scored.select(conv, *order, "label", "severity", carried.alias("_carried"))
    cut = ts is not None or chunk_turns is not None
    if cut:
        number = F.unix_seconds(ts) / chunk_seconds if ts else F.col(turn) / chunk_turns
        # Read twice below; a few dozen bytes per message.
        chunked = materialise(base.withColumn("_chunk", F.floor(number)), "scored-turns")
        ends = Window.partitionBy(conv, "_chunk").orderBy(*[F.col(o).desc() for o in order])
        tails = chunked.withColumn("_rn", F.row_number().over(ends)).filter(F.col("_rn") < WINDOW).drop("_rn")
        along = Window.partitionBy(conv).orderBy(*order)
        before = F.collect_list(F.struct(*order, "label", "severity")).over(along.rowsBetween(-(WINDOW - 1), -1))
        brought = (
            tails.withColumn("_before", before)
            .withColumn("_prev", F.lag("_chunk").over(along))
            .filter(F.col("_prev") != F.col("_chunk"))  # the earliest tail row of every chunk but the first
            .select(conv, "_chunk", F.explode("_before").alias("_b"))
            .select(conv, "_b.*", "_chunk", F.lit(True).alias("_carried"))
        )
        rows = chunked.unionByName(brought)
    else:
        rows = base.withColumn("_chunk", F.lit(0))

    keys = [conv, "_chunk"] if cut else [conv]
    window = Window.partitionBy(*keys).orderBy(*order)
    five, three = window.rowsBetween(-(WINDOW - 1), 0), window.rowsBetween(-(RECENT - 1), 0)
    c = F.col
    columns = {name: F.count_if(c("label") == l).over(five) for l, name in COUNT_COLS.items()}
    columns["n_window"] = F.count(F.lit(1)).over(five)
    columns["n_recent_toxic"] = F.count_if(c("label") != "Sincere").over(three)
    columns["mean_points"] = F.avg(severity_points(c("severity"))).over(five)
    windowed = rows.withColumns(columns).filter(~c("_carried"))
    return verdict_columns(windowed.drop("_chunk", "_carried"))


def rolling_audit(
    df: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    prob: str | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    chunk_turns: int | None = 10_000,
) -> DataFrame:
    """Score every non-blank message in place, then take the verdict at every turn.  Texts are not shuffled."""
    spoken = df.withColumn(text, strip_blanks(F.col(text))).filter(F.length(text) > 0)
    return rolling_verdicts(score_messages(spoken, lexicon, text, prob), conv, turn, chunk_turns)
