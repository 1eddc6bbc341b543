"""Does held-out text occur in the training corpus?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tonelens.functions import bit_filter
from tonelens.functions.text import clean_text, ngrams
from tonelens.plans.workdir import materialise

SHINGLE_WORDS = 8


def _digest(text: Column) -> Column:
    return F.sha2(clean_text(text), 256)


def exact_leaks(held_out: DataFrame, train: DataFrame, text: str = "text") -> DataFrame:
    """Held-out rows whose cleaned text occurs in the training corpus.  Only 64-character digests are shuffled."""
    seen = train.select(_digest(F.col(text)).alias("_d")).distinct()
    return held_out.withColumn("_d", _digest(F.col(text))).join(seen, "_d", "left_semi").drop("_d")


def exact_clean(held_out: DataFrame, train: DataFrame, text: str = "text") -> DataFrame:
    """The complement of :func:`exact_leaks`."""
    seen = train.select(_digest(F.col(text)).alias("_d")).distinct()
    return held_out.withColumn("_d", _digest(F.col(text))).join(seen, "_d", "left_anti").drop("_d")


def shingles(df: DataFrame, key: str, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Distinct word shingles of each row's cleaned text; made distinct inside the row, without a shuffle."""
    tokens = F.split(clean_text(F.col(text)), " ")
    exploded = df.select(F.col(key), tokens.alias("_t")).select(
        key, F.explode_outer(F.array_distinct(ngrams(F.col("_t"), words))).alias("shingle")
    )
    return exploded.filter(F.col("shingle").isNotNull())


def _candidates(df: DataFrame, key: str, wanted: DataFrame, text: str, words: int) -> DataFrame:
    """``(key, h, shingle)``: the distinct shingles of each row that pass the filter of ``wanted(h)``.

    Hashes of all shingles are tested inside the row; only those that pass become text and leave it.
    """
    table = bit_filter.constant(bit_filter.build(wanted, "h"))
    tokens, n = F.col("_t"), bit_filter.WORDS
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("_t") - words),
        lambda i: F.struct(i.alias("i"), F.xxhash64(*[F.get(tokens, i + k) for k in range(words)]).alias("h")),
    )
    passed = F.filter(hashes, lambda s: bit_filter.may_hold(table, s["h"], n))
    spelt = F.transform(passed, lambda s: F.struct(s["h"].alias("h"), F.array_join(F.slice(tokens, s["i"] + 1, words), " ").alias("shingle")))
    rows = df.select(F.col(key), F.split(clean_text(F.col(text)), " ").alias("_t"))
    met = rows.filter(F.size("_t") >= words).select(key, F.explode(F.array_distinct(spelt)).alias("_s"))
    return met.select(key, "_s.h", "_s.shingle")


def _hashed(found: DataFrame, words: int) -> DataFrame:
    """Distinct ``(h, shingle)``; ``h`` is the hash of the words, as :func:`_candidates` takes it."""
    parts = F.split("shingle", " ")
    return found.select("shingle").distinct().select(F.xxhash64(*[F.get(parts, k) for k in range(words)]).alias("h"), "shingle")


def shared_shingles(df: DataFrame, key: str, other: DataFrame, other_key: str, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of ``df`` that quotes ``other``: the number of its shingles that occur there.

    The other side is reduced to distinct shingles and stored.  A filter of their hashes, of one fixed size, goes to
    all tasks; what passes is confirmed by hash and text in a join.  The shuffle so follows the matches and not the
    corpus, however large the other side is.  Runs the jobs that build the filter when called.
    """
    wanted = materialise(_hashed(shingles(other, other_key, text, words), words), "shingles")
    hits = _candidates(df, key, wanted, text, words).join(wanted, ["h", "shingle"], "left_semi")
    return hits.groupBy(key).agg(F.count("*").alias("n_shared"))


def quoted_passages(held_out: DataFrame, key: str, train: DataFrame, train_key: str, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Audit of the held-out set: per item its shingles, how many the training corpus contains, and a verdict.

    An item of fewer than ``words`` words has no shingle and a null verdict: it was not checked.  Training shingles pass
    the filter of the held-out ones first, as in :func:`shared_shingles`, and are then made distinct in every task.
    """
    mine = materialise(shingles(held_out, key, text, words), "held-out-shingles")
    wanted = _hashed(mine, words)
    seen = _candidates(train, train_key, wanted, text, words).select("h", "shingle").distinct()
    found = seen.join(wanted, ["h", "shingle"], "left_semi").select("shingle").withColumn("_hit", F.lit(1))
    counts = mine.join(found, "shingle", "left").groupBy(key).agg(F.count("*").alias("_n"), F.count("_hit").alias("_l"))
    zero = F.lit(0).cast("long")
    return held_out.select(key).join(counts, key, "left").select(
        key, F.coalesce("_n", zero).alias("n_shingles"), F.coalesce("_l", zero).alias("n_leaked"), (F.col("_l") > 0).alias("leaked")
    )


def without_quotes(train: DataFrame, key: str, held_out: DataFrame, held_out_key: str, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Training rows that quote no held-out passage (a row with null text quotes nothing and stays)."""
    quoting = shared_shingles(train, key, held_out, held_out_key, text, words).select(key)
    return train.join(quoting, key, "left_anti")
