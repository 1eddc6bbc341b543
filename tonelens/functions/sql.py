"""The scoring expressions as SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN``): no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tonelens.functions.scores import (
    KEYWORD_WEIGHT, PATTERN_WEIGHT, SEVERITY_HIGH, SEVERITY_MEDIUM, SINCERE_BONUS, SINCERE_FLOOR, required_literals, unicode_pattern,
)
from tonelens.operators.lexicon import DEFAULT_LEXICON, LABELS, Lexicon


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pattern_sum(lexicon: Lexicon, label: str) -> str:
    """Share of matching patterns in the lower-cased ``m``; each regular expression stands as a constant of its own."""
    patterns = lexicon.pattern_list(label)
    tests = []
    for p in patterns:
        literals = required_literals(p)
        spared = "(" + " OR ".join(f"contains(m, {_quote(s)})" for s in literals) + ") AND " if literals else ""
        tests.append(f"if({spared}rlike(m, {_quote(unicode_pattern(p))}), 1, 0)")
    return f"(({' + '.join(tests)}) / {len(patterns)}D)" if tests else "0D"


def _keyword_sum(lexicon: Lexicon, label: str) -> str:
    table = ", ".join(_quote(k) for k in dict.fromkeys(lexicon.keyword_list(label)) if k)
    return f"size(filter(array({table}), k -> contains(m, k)))" if table else "0"


def _lowered(body: str) -> str:
    """``body`` over ``m``, the lower-cased message, lower-cased once."""
    return f"element_at(transform(array(lower(message)), m -> {body}), 1)"


def register_functions(spark: SparkSession, lexicon: Lexicon = DEFAULT_LEXICON) -> None:
    """Create ``clean_text``, ``pattern_score``, ``keyword_hits``, ``message_scores``, ``rule_score`` and ``severity``.

    ``message_scores`` is a struct of all evidence and the four scores; evidence is computed once for all of them.
    ``rule_score`` is one of its fields: whoever wants several asks for the struct.
    """
    url, other = _quote(r"(?U)http\S+|www\S+"), _quote("[^a-z']+")
    by_pattern = " ".join(f"WHEN {_quote(l)} THEN {_lowered(_pattern_sum(lexicon, l))}" for l in LABELS)
    by_keyword = " ".join(f"WHEN {_quote(l)} THEN {_lowered(_keyword_sum(lexicon, l))}" for l in LABELS)
    toxic = [l for l in LABELS if l != "Sincere"]
    names = {l: l.lower().replace("-", "_") for l in LABELS}
    parts = [f"'{names[l]}_keywords', {_keyword_sum(lexicon, l)}" for l in LABELS]
    parts += [f"'{names[l]}_patterns', {_pattern_sum(lexicon, l)}" for l in toxic]
    found = _lowered(f"named_struct({', '.join(parts)})")
    evidence = {l: f"(e.{names[l]}_keywords + {PATTERN_WEIGHT} * e.{names[l]}_patterns)" for l in toxic}
    every = " + ".join(evidence.values())
    sincere = f"greatest({SINCERE_FLOOR}D, {KEYWORD_WEIGHT}D * e.sincere_keywords + if({every} = 0, {SINCERE_BONUS}D, 0D))"
    raw = f"named_struct('sincere', {sincere}, {', '.join(f"'{names[l]}', {KEYWORD_WEIGHT}D * {x}" for l, x in evidence.items())})"
    fields = ["sincere", *(names[l] for l in toxic)]
    kept = [f"'{names[l]}_keywords', e.{names[l]}_keywords" for l in LABELS] + [f"'{names[l]}_patterns', e.{names[l]}_patterns" for l in toxic]
    total = " + ".join(f"r.{f}" for f in fields)
    shares = [f"'{f}', round(r.{f} / ({total}), 4)" for f in fields]
    scored = f"element_at(transform(array({raw}), r -> named_struct({', '.join([*kept, *shares])})), 1)"
    kinds = [f"{names[l]}_keywords: INT" for l in LABELS] + [f"{names[l]}_patterns: DOUBLE" for l in toxic] + [f"{f}: DOUBLE" for f in fields]
    by_rule = " ".join(f"WHEN {_quote(l)} THEN message_scores(message).{names[l]}" for l in LABELS)
    definitions = [
        "clean_text(message STRING) RETURNS STRING RETURN "
        f"btrim(regexp_replace(regexp_replace(lower(message), {url}, ''), {other}, ' '))",
        f"pattern_score(message STRING, label STRING) RETURNS DOUBLE RETURN CASE label {by_pattern} END",
        f"keyword_hits(message STRING, label STRING) RETURNS INT RETURN CASE label {by_keyword} END",
        f"message_scores(message STRING) RETURNS STRUCT<{', '.join(kinds)}> RETURN element_at(transform(array({found}), e -> {scored}), 1)",
        f"rule_score(message STRING, label STRING) RETURNS DOUBLE RETURN CASE label {by_rule} END",
        "severity(confidence DOUBLE, label STRING) RETURNS STRING RETURN "
        f"CASE WHEN label = 'Sincere' THEN 'low' WHEN confidence >= {SEVERITY_HIGH} THEN 'high' "
        f"WHEN confidence >= {SEVERITY_MEDIUM} THEN 'medium' ELSE 'low' END",
    ]
    for d in definitions:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {d}")
