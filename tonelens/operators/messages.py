"""Message analysis: evidence -> scores -> label, severity, highlights, guidance.

Everything up to the guidance lookup is a projection: no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tonelens.functions import scores as S
from tonelens.functions.gram_index import Entry, count_of, found as in_text
from tonelens.operators.lexicon import DEFAULT_LEXICON, LABELS, MAX_LEXICON_ROWS, Lexicon
from tonelens.operators.requests import admitted_messages
from tonelens.plans.naming import free_name

TOXIC = ["Gaslighting", "Passive-Aggressive", "Sarcastic"]
_SHORT = {"Gaslighting": "gl", "Passive-Aggressive": "pa", "Sarcastic": "sa", "Sincere": "si"}


def pattern_scores(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, text: str = "text") -> DataFrame:
    """Add ``gl_pattern``, ``pa_pattern``, ``sa_pattern``: shares of matching patterns."""
    lowered = df.withColumn("_t", F.lower(text))
    shares = {f"{_SHORT[l]}_pattern": S.pattern_share(F.col("_t"), lexicon.pattern_list(l)) for l in TOXIC}
    return lowered.withColumns(shares).drop("_t")


def keyword_hits(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, text: str = "text") -> DataFrame:
    """Add ``gl_keywords`` .. ``si_keywords``: how many keywords of each label occur."""
    lowered = df.withColumn("_t", F.lower(text))
    hits = {f"{_SHORT[l]}_keywords": S.keyword_hits(F.col("_t"), lexicon.keyword_list(l)) for l in [*TOXIC, "Sincere"]}
    return lowered.withColumns(hits).drop("_t")


def _bounded(entries: list[Entry], what: str) -> list[Entry]:
    if len(entries) > MAX_LEXICON_ROWS:
        raise ValueError(f"a lexicon has at most {MAX_LEXICON_ROWS} {what}")
    return entries


def keyword_hits_indexed(df: DataFrame, lexicon: Lexicon, key: str | None = None, text: str = "text") -> DataFrame:
    """The columns of :func:`keyword_hits`, through an index inside the row: for lexicons of many thousand entries.

    A lexicon is an object of the driver, of at most ``MAX_LEXICON_ROWS`` entries here.  No row moves, so a key is not
    needed.
    """
    labels = [*TOXIC, "Sincere"]
    entries = [Entry(k, i, n) for i, l in enumerate(labels) for n, k in enumerate(dict.fromkeys(lexicon.keyword_list(l))) if k]
    found, lowered = free_name(df, "_found"), free_name(df, "_t")
    out = df.withColumn(lowered, F.lower(text)).withColumn(found, in_text(F.col(lowered), _bounded(entries, "keywords")))
    return out.withColumns({f"{_SHORT[l]}_keywords": count_of(F.col(found), i) for i, l in enumerate(labels)}).drop(found, lowered)


def pattern_scores_indexed(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The columns of :func:`pattern_scores`, for lexicons of many thousand patterns.

    A pattern is filed under the literals of which each of its matches contains one; only texts with such a literal meet
    the regular expression, turned so that it begins with a literal where that can be done.  Patterns without one are compiled into the plan as in :func:`pattern_scores`.
    """
    entries, others = [], {l: [] for l in TOXIC}
    for i, l in enumerate(TOXIC):
        for n, p in enumerate(lexicon.pattern_list(l)):
            literals = S.required_literals(p)
            entries += [Entry(s, i, n, S.unicode_pattern(S.literal_first(p))) for s in literals or []]
            others[l] += [] if literals else [p]
    found, lowered = free_name(df, "_found"), free_name(df, "_t")
    out = df.withColumn(lowered, F.lower(text)).withColumn(found, in_text(F.col(lowered), _bounded(entries, "patterns")))

    def share(i: int, l: str) -> Column:
        size = len(lexicon.pattern_list(l))
        plain = S.pattern_share(F.col(lowered), others[l]) * len(others[l])
        return (count_of(F.col(found), i) + plain) / F.lit(float(size)) if size else F.lit(0.0)

    return out.withColumns({f"{_SHORT[l]}_pattern": share(i, l) for i, l in enumerate(TOXIC)}).drop(found, lowered)


def evidence(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, text: str = "text", indexed_by: str | None = None) -> DataFrame:
    """Pattern shares and keyword hits.

    ``indexed_by`` (a key's name; any will do) asks for an index of keywords and patterns, which pays for lexicons of many
    thousand entries; the hits are the same either way.
    """
    with_patterns = pattern_scores_indexed(df, lexicon, text) if indexed_by else pattern_scores(df, lexicon, text)
    return keyword_hits_indexed(with_patterns, lexicon, text=text) if indexed_by else keyword_hits(with_patterns, lexicon, text)


def label_scores(df: DataFrame, prob: str | None = None) -> DataFrame:
    """From evidence to ``method``, the four scores, ``label`` and ``confidence``.

    A null (or absent) model probability means rule scoring for that row.
    """
    c = F.col
    rules = S.rule_scores(
        c("si_keywords"), c("sa_keywords"), c("pa_keywords"), c("gl_keywords"), c("sa_pattern"), c("pa_pattern"), c("gl_pattern")
    )
    if prob is None:
        raw, method = rules, F.lit("rules")
    else:
        branch = S.fusion_branch(c("gl_pattern"), c("pa_pattern"))
        fused = S.fused_scores(branch, c(prob), c("gl_pattern"), c("pa_pattern"))
        no_model = c(prob).isNull()
        raw = {l: F.when(no_model, rules[l]).otherwise(fused[l]) for l in rules}
        method = F.when(no_model, "rules").otherwise(branch)
    staged = df.withColumns({**{f"_raw_{_SHORT[l]}": v for l, v in raw.items()}, "method": method})
    unit = S.normalised({l: c(f"_raw_{_SHORT[l]}") for l in raw})
    scored = staged.withColumns({S.SCORE_COLS[l]: v for l, v in unit.items()})
    columns = {l: c(name) for l, name in S.SCORE_COLS.items()}
    return scored.withColumns({"label": S.top_label(columns, c("method")), "confidence": F.greatest(*columns.values())}).drop(
        *[f"_raw_{s}" for s in _SHORT.values()]
    )


def score_messages(
    df: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    text: str = "text",
    prob: str | None = None,
    indexed_by: str | None = None,
) -> DataFrame:
    """Evidence, scores, label, confidence and severity for every row; the texts are not checked or stripped here."""
    scored = label_scores(evidence(df, lexicon, text, indexed_by), prob)
    return scored.withColumn("severity", S.severity(F.col("confidence"), F.col("label")))


def with_highlights(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, text: str = "text") -> DataFrame:
    """Add ``pattern_highlights``.  Rows without any pattern hit skip the extraction."""
    patterns = [p for l in TOXIC for p in lexicon.pattern_list(l)]
    any_hit = F.col("gl_pattern") + F.col("pa_pattern") + F.col("sa_pattern") > 0
    found = S.highlights(F.lower(text), patterns)
    return df.withColumn("pattern_highlights", F.when(any_hit, found).otherwise(F.array().cast("array<string>")))


def with_guidance(df: DataFrame, guidance: DataFrame, label: str = "label") -> DataFrame:
    """Look up a label in ``guidance(label, ...)``, which has one row per label."""
    table = guidance.withColumnRenamed("label", "_label")
    return df.join(table, F.col(label) == F.col("_label"), "left").drop("_label")


def all_scores() -> Column:
    """The four scores as one struct."""
    return F.struct(*S.SCORE_COLS.values())


def analyse_messages(
    df: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    text: str = "text",
    prob: str | None = None,
    indexed_by: str | None = None,
    guidance: DataFrame | None = None,
) -> DataFrame:
    """The full analysis of every admitted message, with the guidance of its label where a table of it is given."""
    scored = score_messages(admitted_messages(df, text), lexicon, text, prob, indexed_by)
    found = with_highlights(scored, lexicon, text)
    return found if guidance is None else with_guidance(found, guidance)


def ranked_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """Four rows per message, scores descending; equal scores keep the label order, a missing score is 0."""
    entries = F.array(
        *[
            F.struct((-F.coalesce(F.col(S.SCORE_COLS[l]), F.lit(0.0))).alias("neg"), F.lit(i).alias("ord"), F.lit(l).alias("label"))
            for i, l in enumerate(LABELS)
        ]
    )
    return df.select(*keys, F.posexplode(F.array_sort(entries)).alias("pos", "e")).select(
        *keys, (F.col("pos") + 1).alias("rank"), F.col("e.label").alias("label"), (-F.col("e.neg")).alias("score")
    )


def best_available(df: DataFrame, scorers: dict[str, DataFrame], key: str) -> DataFrame:
    """Probability of the strongest scorer that has one for the row, and its name.

    ``scorers`` maps names to tables ``(key, prob)``, strongest first; ``key`` is unique in each.  A row no scorer
    knows keeps a null probability.
    """
    out, names = df, []
    for i, (name, table) in enumerate(scorers.items()):
        out = out.join(table.select(key, F.col("prob").alias(f"_p{i}")), key, "left")
        names.append((f"_p{i}", name))
    used = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in names])
    return out.withColumns({"prob": F.coalesce(*[F.col(c) for c, _ in names]), "model_used": used}).drop(*[c for c, _ in names])


def predicted_polarity(df: DataFrame, prob: str = "prob") -> DataFrame:
    """Display columns for a probability: side, confidence, percent text, probability to four places."""
    p = F.col(prob)
    return df.withColumns(
        {
            "polarity": S.polarity(p),
            "confidence": S.threshold_confidence(p),
            "confidence_text": S.percent(S.threshold_confidence(p)),
            "prob_4": F.round(p, 4),
        }
    )
