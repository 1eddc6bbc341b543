"""Four-label scoring as column expressions over lexicon evidence and an optional model probability."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, functions as F

from tonelens.functions.text import bind

try:
    from re import _parser as regex_parser
except ImportError:  # Python 3.10
    import sre_parse as regex_parser

#: Argmax order on equal scores, per way of scoring (the order in which each lists its labels).
TIE_ORDER = {
    "rules": ["Sincere", "Sarcastic", "Passive-Aggressive", "Gaslighting"],
    "gaslighting": ["Gaslighting", "Sarcastic", "Passive-Aggressive", "Sincere"],
    "passive": ["Passive-Aggressive", "Sarcastic", "Gaslighting", "Sincere"],
    "model": ["Sarcastic", "Sincere", "Passive-Aggressive", "Gaslighting"],
}

# Weights of the rule scorer and of the three fusion branches, thresholds of the severity scale.
KEYWORD_WEIGHT = 0.4
PATTERN_WEIGHT = 5
SINCERE_FLOOR = 0.1
SINCERE_BONUS = 0.5
GASLIGHTING_BRANCH = 0.15
PASSIVE_BRANCH = 0.10
SEVERITY_HIGH = 0.70
SEVERITY_MEDIUM = 0.45

HIGHLIGHTS = 5

SCORE_COLS = {
    "Sincere": "score_sincere",
    "Sarcastic": "score_sarcastic",
    "Passive-Aggressive": "score_passive",
    "Gaslighting": "score_gaslighting",
}


def unicode_pattern(pattern: str) -> str:
    """White space, word characters and boundaries are Unicode ones."""
    return f"(?U){pattern}"


def _required(nodes) -> list[str] | None:
    """Strings of which every match contains at least one; None when that cannot be said.

    Walks Python's own parse of the pattern.  A run of literals is required as a whole, of an alternation one branch;
    the choice with the longest shortest string is the most telling one.
    """
    options: list[list[str]] = []
    run = ""
    for op, arg in [*nodes, (None, None)]:
        if op is regex_parser.LITERAL:
            run += chr(arg)
            continue
        if run:
            options.append([run])
            run = ""
        inner: list[str] | None = None
        if op is regex_parser.SUBPATTERN and not arg[1] and not arg[2]:
            inner = _required(arg[3])
        elif op is regex_parser.BRANCH:
            branches = [_required(b) for b in arg[1]]
            inner = [s for b in branches for s in b] if all(branches) else None
        elif op in (regex_parser.MAX_REPEAT, regex_parser.MIN_REPEAT) and arg[0] >= 1:
            inner = _required(arg[2])
        if inner:
            options.append(inner)
    return max(options, key=lambda o: min(map(len, o)), default=None)


def required_literals(pattern: str) -> list[str] | None:
    """Cheap necessary condition for a match of ``pattern``; None where there is none (then the regex always runs)."""
    try:
        parsed = regex_parser.parse(pattern)
    except re.error:
        return None
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return None
    return _required(parsed)


#: A boundary, a character, or the start or a character, in front of letters, digits, blanks and apostrophes.
_FRONT = re.compile(r"(?P<front>\\b|\[\^?[\w ,.'-]+\]|\(\?:\^\|\[\^?[\w ,.'-]+\]\))(?P<literal>[A-Za-z0-9 ']{2,})(?P<rest>.*)", re.ASCII | re.DOTALL)


def literal_first(pattern: str) -> str:
    """An equal pattern whose matches begin with a literal, which is searched for without trying every character.

    What stands in front of the literal is looked for behind it; other patterns stay as they are.
    """
    found = _FRONT.fullmatch(pattern)
    if not found:
        return pattern
    front, literal, rest = found["front"], found["literal"], found["rest"]
    if rest[:1] in ("?", "*", "+", "{"):  # repeats the last character
        literal, rest = literal[:-1], literal[-1] + rest
    depth = 0
    for c in re.sub(r"\\.|\[\^?[^\[\]\\]+\]", "", rest, flags=re.DOTALL):
        depth += (c == "(") - (c == ")")
        if depth < 0 or (c == "|" and not depth) or c in "[]":
            return pattern
    if depth or r"\Q" in rest:
        return pattern
    return f"{literal}(?<={front}{literal}){rest}"


def matches(text: Column, pattern: str) -> Column:
    """Does the pattern occur?  Plain substring tests spare texts that cannot match the regular expression.

    A null text matches nothing.
    """
    hit = text.rlike(unicode_pattern(pattern))
    needed = required_literals(pattern)
    if needed:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in needed]) & hit
    return F.coalesce(hit, F.lit(False))


def _total(parts: list[Column]) -> Column:
    """Sum as a balanced tree: the depth of the expression is the logarithm of its length."""
    if not parts:
        return F.lit(0)
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def pattern_share(text: Column, patterns: list[str]) -> Column:
    """Matching patterns / patterns; each counts once.  ``text`` is lower-cased already."""
    if not patterns:
        return F.lit(0.0)
    hits = _total([matches(text, p).cast("int") for p in patterns])
    return hits.cast("double") / F.lit(float(len(patterns)))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the distinct keywords occur.  ``text`` is lower-cased already; a null text has no hits.

    The keywords are one constant array, so a lexicon may be of any length; empty ones are left out.
    """
    entries = [k for k in dict.fromkeys(keywords) if k]
    table = F.from_json(F.lit(json.dumps(entries)), "array<string>")
    return F.size(F.filter(table, lambda k: F.contains(text, k)))


def highlights(text: Column, patterns: list[str], limit: int = HIGHLIGHTS) -> Column:
    """First match of each pattern, in pattern order, distinct, at most ``limit``."""
    if not patterns:
        return F.array().cast("array<string>")
    found = [F.when(matches(text, p), F.regexp_extract(text, unicode_pattern(p), 0)) for p in patterns]
    return F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, limit)


def rule_scores(si: Column, sa_kw: Column, pa_kw: Column, gl_kw: Column, sa_pat: Column, pa_pat: Column, gl_pat: Column) -> dict[str, Column]:
    """Unnormalised rule scores from keyword hits and pattern shares."""
    sa = sa_kw + sa_pat * PATTERN_WEIGHT
    pa = pa_kw + pa_pat * PATTERN_WEIGHT
    gl = gl_kw + gl_pat * PATTERN_WEIGHT
    bonus = F.when(gl + pa + sa == 0, F.lit(SINCERE_BONUS)).otherwise(F.lit(0.0))
    return {
        "Sincere": F.greatest(F.lit(SINCERE_FLOOR), si * KEYWORD_WEIGHT + bonus),
        "Sarcastic": sa * KEYWORD_WEIGHT,
        "Passive-Aggressive": pa * KEYWORD_WEIGHT,
        "Gaslighting": gl * KEYWORD_WEIGHT,
    }


def fusion_branch(gl_pat: Column, pa_pat: Column) -> Column:
    """Which fusion applies when a model probability is there."""
    return (
        F.when(gl_pat > GASLIGHTING_BRANCH, "gaslighting").when(pa_pat > PASSIVE_BRANCH, "passive").otherwise("model")
    )


def fused_scores(branch: Column, p: Column, gl: Column, pa: Column) -> dict[str, Column]:
    """Unnormalised scores of the three fusion branches; ``p`` is the model's probability of sarcasm."""
    q = 1.0 - p
    by_branch = {
        "gaslighting": {
            "Gaslighting": 0.5 + gl * 0.3 + p * 0.1,
            "Sarcastic": p * 0.15,
            "Passive-Aggressive": pa * 0.2,
            "Sincere": q * 0.15,
        },
        "passive": {
            "Passive-Aggressive": 0.4 + pa * 0.3 + p * 0.15,
            "Sarcastic": p * 0.2,
            "Gaslighting": gl * 0.1,
            "Sincere": q * 0.15,
        },
        "model": {
            "Sarcastic": p * 0.85,
            "Sincere": q * 0.85,
            "Passive-Aggressive": pa * 0.1,
            "Gaslighting": gl * 0.05,
        },
    }
    return {
        label: F.when(branch == "gaslighting", by_branch["gaslighting"][label])
        .when(branch == "passive", by_branch["passive"][label])
        .otherwise(by_branch["model"][label])
        for label in SCORE_COLS
    }


def normalised(scores: dict[str, Column]) -> dict[str, Column]:
    """Scores divided by their sum (a sum of zero counts as one), to four places."""
    total = _total(list(scores.values()))
    whole = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return {label: F.round(s / whole, 4) for label, s in scores.items()}


def top_label(scores: dict[str, Column], method: Column) -> Column:
    """Label of the largest (rounded) score; on ties the one its method lists first."""
    best = F.greatest(*scores.values())

    def first_best(order: list[str]) -> Column:
        pick = F.when(scores[order[0]] == best, order[0])
        for label in order[1:]:
            pick = pick.when(scores[label] == best, label)
        return pick

    chosen = F.when(method == "rules", first_best(TIE_ORDER["rules"]))
    for name in ("gaslighting", "passive", "model"):
        chosen = chosen.when(method == name, first_best(TIE_ORDER[name]))
    return chosen


def severity(confidence: Column, label: Column) -> Column:
    return (
        F.when(label == "Sincere", "low")
        .when(confidence >= SEVERITY_HIGH, "high")
        .when(confidence >= SEVERITY_MEDIUM, "medium")
        .otherwise("low")
    )


def softmax(logits: Column) -> Column:
    """Softmax of an ``array<double>``, shifted by its maximum."""
    exps = bind(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(e, lambda x: x / t))

    return bind(exps, shares)


def argmax(values: Column) -> Column:
    """Zero-based position of the (first) largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def threshold_label(prob: Column, threshold: float = 0.5, tie_positive: bool = True) -> Column:
    """1 at or above the threshold (strictly above it with ``tie_positive=False``), else 0."""
    return (prob >= threshold).cast("int") if tie_positive else (prob > threshold).cast("int")


def threshold_confidence(prob: Column, threshold: float = 0.5) -> Column:
    """The probability of the chosen side."""
    return F.when(prob >= threshold, prob).otherwise(1.0 - prob)


def polarity(prob: Column, threshold: float = 0.5) -> Column:
    """Display name of the chosen side."""
    return F.when(prob >= threshold, "SARCASTIC").otherwise("NOT SARCASTIC")


def percent(value: Column) -> Column:
    """One decimal (halves to even) and a percent sign."""
    return F.format_string("%.1f%%", F.bround(value * 100.0, 1))
