"""Allow and block rules for URLs by host and path.

A rule ``(host, path, action)`` fits its host and all subdomains where the URL's path starts with the rule's path; the
longest rule wins.  Each distinct (host, path) expands into the expressions it could meet: host suffixes with as many
labels as some rule has, times path prefixes as long as some rule's.  Expressions meet rules in an equi-join on the
first four bytes of their SHA-256; the full digest confirms a meeting, and precedence picks one.

URLs collapse to distinct (host, path) before they expand, and verdicts come back by a join on that pair, whose hot
keys Spark splits.  The rule table's shape (label counts, path lengths) is collected and bounded by ``MAX_SHAPES``.

Defined results: a null URL or one without ``://`` has empty host and path and meets only rules with empty ones; no
fitting rule gives a null rule and the ``default`` verdict; of two rules of one length the longer host wins, then block
before allow; repeated rows are judged alike; empty tables give empty results or the default; input columns stay, but
for those named host, path, rule and verdict in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tonelens.llm.common import ascii_lower, free_name
from tonelens.plans.sizing import collect_bounded

ALLOW, BLOCK = "allow", "block"
#: Most distinct label counts, and most distinct path lengths, among the rules.
MAX_SHAPES = 4096


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def _shapes(values: DataFrame, what: str) -> Column:
    found = sorted(r[0] for r in collect_bounded(values.distinct(), MAX_SHAPES, what))
    return F.array(*map(F.lit, found)).cast("array<int>")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host, path, action``; rows with a null are ignored.
    """
    table = rules.select(ascii_lower("host").alias("_rhost"), F.col("path").alias("_rpath"), F.col("action").alias("_action")).dropna().distinct()
    digest = _digest(F.col("_rhost"), F.col("_rpath"))
    table = table.withColumns({"_digest": digest, "_short": _prefix(digest)})
    counts = _shapes(table.select(_labels(F.col("_rhost"))), "label counts of the rules")
    lengths = _shapes(table.select(F.length("_rpath")), "path lengths of the rules")

    parted = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    pairs = parted.groupBy("host", "path").agg(F.lit(1).alias("_one")).drop("_one")
    n = _labels(F.col("host"))
    wide = pairs.select(
        "host", "path",
        F.explode(F.filter(counts, lambda k: k <= n)).alias("_k"),
    ).select("host", "path", F.expr("substring_index(host, '.', -_k)").alias("_suffix"))
    expressions = wide.select(
        "host", "path", "_suffix",
        F.explode(F.filter(lengths, lambda k: k <= F.length("path"))).alias("_k"),
    )
    digest = _digest(F.col("_suffix"), F.substring(F.col("path"), F.lit(1), F.col("_k")))
    asked = expressions.select("host", "path", digest.alias("_asked")).withColumn("_short", _prefix(F.col("_asked")))
    met = asked.join(table, "_short").filter(F.col("_asked") == F.col("_digest"))
    precedence = F.struct(
        F.length(F.concat("_rhost", "_rpath")).alias("length"),
        F.length("_rhost").alias("host_length"),
        F.col("_action").alias("action"),
        F.concat("_rhost", "_rpath").alias("rule"),
    )
    name = free_name(pages, "_best")
    best = met.groupBy("host", "path").agg(F.max(precedence).alias(name))
    out = parted.join(best, ["host", "path"], "left")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path",
        F.col(name)["rule"].alias("rule"), F.coalesce(F.col(name)["action"], F.lit(default)).alias("verdict"),
    )
