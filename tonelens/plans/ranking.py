"""Exact per-class ranks at any size.

A plain ``row_number() over (partition by label ...)`` puts one class into one task.  The operators built on ranks
(splits, samples, folds, caps) never need every rank: they need the *boundaries* between parts.  So:

1. rows are ordered by ``md5(seed|key)``; the leading hex digits form a bucket, and rows are counted per
   (class, bucket) with map-side combine;
2. the bucket that holds each boundary rank follows from a prefix sum over that small table;
3. only the boundary buckets (1/4096 of a class each) are ranked, which yields the exact boundary hash;
4. the part of a row is then a comparison of its own hash with its class's boundaries: a narrow projection.

The rows themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tonelens.plans.naming import free_name
from tonelens.plans.sizing import MAX_CLASSES, collect_bounded
from tonelens.plans.workdir import materialise

#: class value -> ascending cut ranks; rank r means "the first r rows of the class lie at or below the cut"
Cuts = dict[Any, list[int]]

_BELOW_ALL, _ABOVE_ALL = "", "g"  # md5 is lower-case hex


def order_key(key: str, seed: int) -> Column:
    """The reproducible random order: independent of partitioning, the same in any SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def assign_parts(
    df: DataFrame,
    label: str,
    key: str,
    cuts_of: Callable[[list[tuple[Any, int]]], Cuts],
    *,
    seed: int = 42,
    part_col: str = "part",
    bucket_digits: int = 3,
) -> DataFrame:
    """Add ``part_col``: the number of cut ranks a row lies beyond, within its class, in hash order.

    ``key`` must be unique.  ``cuts_of`` gets the (class, count) pairs sorted by class (nulls form their own class,
    first) and returns the same number of cuts for every class.
    """
    spark = df.sparkSession
    slim = df.select(F.col(label).alias("_c"), order_key(key, seed).alias("_h"))
    hist = (
        slim.groupBy("_c", F.substring("_h", 1, bucket_digits).alias("_b"))
        .agg(F.count("*").alias("_n"))
        .persist()
    )
    try:
        totals = collect_bounded(hist.groupBy("_c").agg(F.sum("_n").alias("n")), MAX_CLASSES, f"classes of {label}")
        ordered = sorted(((r["_c"], r["n"]) for r in totals), key=lambda t: (t[0] is not None, t[0]))
        cuts = cuts_of(ordered) if ordered else {}
        n_cuts = max((len(c) for c in cuts.values()), default=0)
        label_type = df.schema[label].dataType
        wanted = T.StructType(
            [T.StructField("_c", label_type), T.StructField("_j", T.IntegerType()), T.StructField("_r", T.LongType())]
        )
        inner = [
            (c, j, r) for c, n in ordered for j, r in enumerate(cuts[c]) if 0 < r < n
        ]
        prefix = Window.partitionBy("_c").orderBy("_b")
        cum = hist.withColumn("_cum", F.sum("_n").over(prefix))
        want = spark.createDataFrame(inner, wanted)
        boundary = collect_bounded(
            cum.alias("b")
            .join(
                F.broadcast(want).alias("w"),
                F.col("b._c").eqNullSafe(F.col("w._c"))
                & (F.col("_cum") >= F.col("_r"))
                & (F.col("_cum") - F.col("_n") < F.col("_r")),
            )
            .select("b._c", "_j", "_b", (F.col("_r") - (F.col("_cum") - F.col("_n"))).alias("_o")),
            MAX_CLASSES * max(n_cuts, 1),
            f"boundaries of {label}",
        )
    finally:
        hist.unpersist()

    limits = {c: [_BELOW_ALL if r <= 0 else _ABOVE_ALL for r in cuts[c]] for c, _ in ordered}
    if boundary:
        spots = spark.createDataFrame(
            [(r["_c"], r["_j"], r["_b"], r["_o"]) for r in boundary],
            T.StructType(
                [
                    T.StructField("_c", label_type),
                    T.StructField("_j", T.IntegerType()),
                    T.StructField("_b", T.StringType()),
                    T.StructField("_o", T.LongType()),
                ]
            ),
        )
        bucket = F.substring("_h", 1, bucket_digits)
        in_bucket = (
            slim.withColumn("_b", bucket)
            .filter(F.col("_b").isin(sorted({r["_b"] for r in boundary})))
            .withColumn("_rn", F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_h")))
        )
        found = (
            in_bucket.alias("x")
            .join(
                F.broadcast(spots).alias("s"),
                F.col("x._c").eqNullSafe(F.col("s._c")) & (F.col("x._b") == F.col("s._b")) & (F.col("_rn") == F.col("_o")),
            )
            .select("s._c", "_j", "_h")
        )
        for r in collect_bounded(found, len(boundary), f"boundaries of {label}"):
            limits[r["_c"]][r["_j"]] = r["_h"]

    table = spark.createDataFrame(
        [(c, *limits[c]) for c, _ in ordered],
        T.StructType(
            [T.StructField("_c", label_type)] + [T.StructField(f"_cut{j}", T.StringType()) for j in range(n_cuts)]
        ),
    )
    beyond = [(F.col("_h") > F.col(f"_cut{j}")).cast("int") for j in range(n_cuts)]
    part = reduce(lambda a, b: a + b, beyond, F.lit(0))
    return (
        df.withColumn("_h", order_key(key, seed))
        .join(F.broadcast(table), F.col(label).eqNullSafe(F.col("_c")))  # one row per class, at most MAX_CLASSES
        .withColumn(part_col, part)
        .drop("_h", "_c", *[f"_cut{j}" for j in range(n_cuts)])
    )


def first_by(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in this order, without bringing candidates of all tasks to one.

    The rows are sorted by ranges and written once; whole partitions are taken until the one in which the n-th row
    lies, of which only the head is taken.
    """
    name = free_name(df, "_part")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.spark_partition_id())
    stored = materialise(ranged, "ranges")
    sizes = dict(map(tuple, collect_bounded(stored.groupBy(name).agg(F.count("*").alias("n")), MAX_CLASSES, "partitions")))
    before, last = 0, None
    for part in sorted(sizes):
        if before + sizes[part] > n:
            last = part
            break
        before += sizes[part]
    if last is None:
        return stored.drop(name)
    head = stored.filter(F.col(name) == last).orderBy(*order).limit(n - before)
    return stored.filter(F.col(name) < last).union(head).drop(name)
