"""Exploration: class balance, lengths, histograms, frequent n-grams."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window, functions as F

from tonelens.functions.text import char_count, content_tokens, ngrams, word_count
from tonelens.operators.cleaning import duplicate_count


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per class.  The window runs over one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def with_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("word_count", word_count(F.col(text))).withColumn("char_count", char_count(F.col(text)))


def length_stats(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Mean words and characters per class."""
    return (
        with_lengths(df, text)
        .groupBy(label)
        .agg(F.avg("word_count").alias("mean_words"), F.avg("char_count").alias("mean_chars"))
    )


def length_histogram(df: DataFrame, text: str = "text", label: str = "label", bins: int = 30) -> DataFrame:
    """``bins`` equal bins per class and measure over that class's own range; the last bin is closed.

    Rows are first counted per (class, measure, length); range and bins come from that small table, so the texts
    are read once.  A class of one single length gets a range one wide around it.
    """
    counted = (
        with_lengths(df, text)
        .select(label, F.expr("stack(2, 'words', word_count, 'chars', char_count) AS (measure, length)"))
        .groupBy(label, "measure", "length")
        .agg(F.count("*").alias("n"))
    )
    whole = Window.partitionBy(label, "measure")
    flat = F.col("hi") == F.col("lo")
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    guess = F.least(F.floor((F.col("length") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    # The quotient may be off by one ulp at an edge; the edges decide.
    slot = (
        F.when(F.col("length") < F.col("lo") + F.col("guess") * width, F.col("guess") - 1)
        .when(
            (F.col("guess") < bins - 1) & (F.col("length") >= F.col("lo") + (F.col("guess") + 1) * width),
            F.col("guess") + 1,
        )
        .otherwise(F.col("guess"))
    )
    binned = (
        counted.withColumn("lo", F.min("length").over(whole).cast("double"))
        .withColumn("hi", F.max("length").over(whole).cast("double"))
        .select(
            label,
            "measure",
            "length",
            "n",
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
        .withColumn("guess", guess)
        .withColumn("bin", slot)
        .groupBy(label, "measure", "lo", "hi", "bin")
        .agg(F.sum("n").alias("n"))
    )
    # A marker row per bin keeps the empty bins in the result without a join.
    per_class = binned.groupBy(label, "measure", "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled")
    )
    return (
        per_class.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .withColumn("bin_width", (F.col("hi") - F.col("lo")) / F.lit(bins))
        .select(
            label,
            "measure",
            "bin",
            (F.col("lo") + F.col("bin") * F.col("bin_width")).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("bin_width")).alias("bin_end"),
            F.coalesce(F.try_element_at("filled", "bin"), F.lit(0)).alias("n"),
        )
    )


def english_stop_words() -> list[str]:
    """Spark ML's English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def term_frequency(df: DataFrame, stop_words: list[str] | None = None, n: int = 1, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Occurrences of each n-gram of content words, optionally per class; without a list, English stop words go."""
    keys = by or []
    stop_words = english_stop_words() if stop_words is None else stop_words
    grams = ngrams(F.col("_tokens"), n)
    return (
        df.select(*keys, content_tokens(F.col(text), stop_words).alias("_tokens"))
        .select(*keys, F.explode_outer(grams).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy(*keys, "term")
        .agg(F.count("*").alias("n"))
    )


def top_ngrams(df: DataFrame, stop_words: list[str] | None = None, n: int = 1, k: int = 20, text: str = "text", label: str = "label") -> DataFrame:
    """The k most frequent n-grams of each class; equal counts rank alphabetically.

    The ranked filter is pushed below the shuffle (window group limit): a class contributes k rows per task.
    """
    counts = term_frequency(df, stop_words, n, text, [label])
    ranked = Window.partitionBy(label).orderBy(F.col("n").desc(), F.col("term"))
    return counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def corpus_summary(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Summary block: one row per class next to the corpus totals."""
    whole = Window.partitionBy()
    per_class = (
        with_lengths(df, text)
        .groupBy(label)
        .agg(F.count("*").alias("n"), F.avg("word_count").alias("mean_words"))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("percent", F.col("n") * 100.0 / F.col("total"))
    )
    return per_class.withColumn("duplicates", duplicate_count(df, text).select("n_duplicates").scalar())
