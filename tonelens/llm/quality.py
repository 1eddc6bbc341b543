"""Quality rules as a short-circuit cascade.

Every rule is a predicate over measures of one text, built from Spark's own functions, so judging a table is a
projection: no shuffle, no Python.  Rules differ a hundredfold in cost.  ``order_rules`` runs each rule alone over a
bounded sample, takes its time and the share it rejects, and puts the rule with most rejections per second first;
``first_failure`` is then one CASE, which stops at the first rule that a text breaks.  The order decides only what is
computed and which broken rule is named, never whether a text is kept.

Defined results: a null text is an empty text, has no words and fails ``few_words``; repeated rows are judged alike; an
empty table gives an empty table; columns of the input stay as they are, a measure or verdict takes their place only
if it has the same name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tonelens.llm.common import SPACE, let, words_of

#: Rows, whole texts, that the cost of a rule is measured on.
SAMPLE_ROWS = 256
WINDOW = 5


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.coalesce(F.length(F.array_join(words_of(text), "")), F.lit(0)).cast("long")


def _occurrences(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def symbol_count(text: Column) -> Column:
    return _occurrences(text, "[#*$%&|<>]")


def exclamation_count(text: Column) -> Column:
    return _occurrences(text, "!")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)


def line_count(text: Column) -> Column:
    return F.size(_worded_lines(text)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_worded_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(text: Column) -> Column:
    """Words inside five-word windows that occur twice or more, first occurrences included.

    Windows are compared by a 64-bit hash of their words.  Sorting (hash, position) puts equal windows side by side;
    what the windows of ascending positions cover is then a sum of capped gaps.  Texts without a repeat, nearly all,
    stop before the sort.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def of_sorted(pairs: Column) -> Column:
        twin = lambda pair, i: (F.get(pairs, i - 1)["h"] == pair["h"]) | (F.get(pairs, i + 1)["h"] == pair["h"])
        starts = F.sort_array(F.transform(F.filter(pairs, lambda pair, i: F.coalesce(twin(pair, i), F.lit(False))), lambda pair: pair["p"]))
        return let(starts, covered)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, of_sorted))

    def of_words(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
        return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))

    return let(words_of(text), of_words)


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": word_count,
    "word_chars": word_chars,
    "n_symbols": symbol_count,
    "n_dup_lines": duplicate_lines,
    "n_repeat_words": repeated_words,
    "n_exclamations": exclamation_count,
    "n_lines": line_count,
}


class Rule(NamedTuple):
    """``broken`` gets the measures by name; ``base`` rules are those of the minimum contract."""

    name: str
    broken: Callable[[Callable[[str], Column]], Column]
    base: bool = False


RULES = (
    Rule("few_words", lambda m: m("n_words") < 10, base=True),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"), base=True),
    Rule("symbols", lambda m: 4 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("shouting", lambda m: m("n_exclamations") > m("n_words")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every measure as a column."""
    return docs.withColumns({name: of(F.col(text)) for name, of in MEASURES.items()})


def lazily(text: str = "text") -> Callable[[str], Column]:
    """Measures computed from the text where, and only where, a rule asks for them."""
    return lambda name: MEASURES[name](F.col(text))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per second, most first, as measured one by one on a sample of ``rows`` whole texts.

    The sample are the texts of the least hashes, drawn from the whole table: each task keeps its own least ``rows``
    hashes, and the texts of those that stay are fetched.
    """
    spread = F.xxhash64(F.col(text), F.lit(7))
    least = [r["h"] for r in docs.select(spread.alias("h")).distinct().orderBy("h").limit(rows).collect()]
    found = docs.filter(spread.isin(least)).select(F.col(text).alias("text")).limit(rows).collect() if least else []
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in found], "text string")
    of = lazily("text")

    def run(broken: Column) -> tuple[float, int]:
        start = time.perf_counter()
        hits = sample.agg(F.count_if(broken)).first()[0]
        return time.perf_counter() - start, hits

    run(F.col("text").isNull())
    idle, _ = run(F.col("text").isNull())
    rated = []
    for place, rule in enumerate(rules):
        run(rule.broken(of))  # compiles the plan
        took, hits = run(rule.broken(of))
        rated.append((-hits / max(took - idle, 1e-3), place, rule))
    return tuple(rule for _, _, rule in sorted(rated, key=lambda r: r[:2]))


def first_failure(rules: tuple[Rule, ...], of: Callable[[str], Column]) -> Column:
    """Name of the first broken rule in this order, null if none is."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.broken(of), F.lit(rule.name)).otherwise(verdict)
    return verdict


#: Measures that every judged row has as columns.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the ``REPORTED`` measures, ``base_failed``, and ``kept`` by the cascade.

    The cascade reads the reported measures; what only it needs is computed from the text where it gets that far.
    """
    base = F.lit(False)
    for rule in rules:
        if rule.base:
            base = base | rule.broken(F.col)
    later = lazily(text)
    verdict = first_failure(order_rules(docs, rules, text), lambda name: F.col(name) if name in REPORTED else later(name))
    reported = docs.withColumns({name: MEASURES[name](F.col(text)) for name in REPORTED})
    return reported.withColumns({"base_failed": base, "kept": verdict.isNull()})


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that break no rule, columns unchanged; each measure is computed only if the cascade gets that far."""
    return docs.filter(first_failure(order_rules(docs, rules, text), lazily(text)).isNull())
