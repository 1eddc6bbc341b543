"""Shards of near equal bytes, cut from one order of atomic groups by a minimax contiguous partition.

Equal texts form a group that no cut may divide; groups are ordered by a 64-bit hash of their text.  The smallest
shard capacity that the order allows is found by binary search, each candidate checked greedily: fill a shard until
the next group does not fit.

No more than a bounded part of the groups reaches the driver.  It sees a histogram: the order cut into ranges of the hash, each with its bytes
and its least and greatest hash.  A range with one hash is a group.  With ranges taken whole the search gives a
capacity that surely works; with ranges that hold several groups taken as divisible, one that no partition can beat.
Groups over a part in ``shards`` << ``BITS`` of the bytes are ranges of their own from the start.  While the two
capacities differ, the ranges in which a cut of one of them falls, and the next on either side, are cut finer: at most
six a shard.  A round costs one pass over (hash, size); each resolves further bits of ranges that hold a cut.

Shards are ranges of the hash, so a row's shard is a comparison with at most ``shards - 1`` constants.  Slots count
rows by the scan partition they came from, then add the partition's offset, so that a group of any share is numbered by
many tasks.  Only (key, size, hash, partition) is written, once, to the shared folder; texts stay where they are.

Defined results: a null text has no bytes and one group of its own; its checksum is that of no bytes; an empty table
gives no rows; repeated rows get slots of their own; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from tonelens.llm.common import free_name
from tonelens.plans.sizing import collect_bounded
from tonelens.plans.workdir import materialise

#: Hash bits that one round of the search resolves.
BITS = 12


class Range(NamedTuple):
    """A stretch of the order: hashes from ``low`` on, all below the next range's ``low``."""

    low: int
    high: int
    size: int

    @property
    def atomic(self) -> bool:
        return self.low == self.high


def fill(ranges: list[Range], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Greedy check: the range in which each shard ends, or None if ``shards`` do not suffice.

    ``divisible``: ranges of several groups may be cut anywhere.
    """
    ends, room = [], capacity
    for i, r in enumerate(ranges):
        left = r.size
        while left > room:
            splits = divisible and not r.atomic
            if not splits and r.size > capacity:
                return None
            ends.append(i)
            if len(ends) >= shards:
                return None
            left -= room if splits else 0
            room = capacity
        room -= left
    return ends


def least_capacity(ranges: list[Range], shards: int, divisible: bool) -> int:
    """Binary search for the smallest capacity that the greedy check accepts."""
    total = sum(r.size for r in ranges)
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if fill(ranges, middle, shards, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _heavy(sized: DataFrame, shards: int) -> list[int]:
    """Hashes of the groups over one part in ``shards << BITS`` of the bytes, in order; fewer than that many."""
    total = sized.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    groups = sized.groupBy("_h").agg(F.sum("_size").alias("s")).filter(F.col("s") * (shards << BITS) > total)
    return sorted(r["_h"] for r in collect_bounded(groups.select("_h"), shards << BITS, "heavy groups"))


def _histogram(sized: DataFrame, heavy: list[int]) -> list[Range]:
    """Ranges of hashes that agree in the highest ``BITS`` bits, cut again before and after each of ``heavy``."""
    bins: dict[int, list[int]] = {}
    for h in heavy:
        bins.setdefault(h >> 64 - BITS, []).append(h)
    known = sized.sparkSession.createDataFrame([*bins.items()], "_b long, _heavy array<long>")
    held = F.coalesce("_heavy", F.array().cast("array<long>"))
    place = 2 * F.size(F.filter(held, lambda x: x < F.col("_h"))) + F.array_contains(held, F.col("_h")).cast("int")
    binned = sized.withColumn("_b", F.shiftright("_h", 64 - BITS)).join(F.broadcast(known), "_b", "left")
    return _ranges(binned.groupBy("_b", place.alias("_p")), (1 << BITS) + 2 * len(heavy))


def _finer(sized: DataFrame, within: list[Range]) -> list[Range]:
    """``within`` cut by the next ``BITS`` bits in which the hashes of each differ."""
    index, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, r in enumerate(within):
        inside = F.col("_h").between(r.low, r.high)
        index = F.when(inside, i).otherwise(index)
        bucket = F.when(inside, F.shiftright("_h", max(0, (r.low ^ r.high).bit_length() - BITS))).otherwise(bucket)
    inside = sized.select("_h", "_size", index.alias("_i")).filter(F.col("_i").isNotNull())
    return _ranges(inside.groupBy("_i", bucket.alias("_b")), len(within) << BITS)


def _ranges(grouped: GroupedData, most: int) -> list[Range]:
    found = grouped.agg(F.min("_h").alias("low"), F.max("_h").alias("high"), F.sum("_size").alias("size"))
    return sorted(Range(r["low"], r["high"], r["size"]) for r in collect_bounded(found, most, "ranges of the order"))


def minimax_cuts(sized: DataFrame, shards: int) -> tuple[list[int], int]:
    """First hash of every shard but the first, and the capacity; ``sized`` has ``_h`` and ``_size`` and is read per round."""
    ranges = _histogram(sized, _heavy(sized, shards))
    if not ranges:
        return [], 0
    while True:
        sure = least_capacity(ranges, shards, divisible=False)
        bound = least_capacity(ranges, shards, divisible=True)
        if sure == bound:
            break
        # a cut at ``bound`` falls inside a range of several groups, or ``bound`` were sure
        cut = {*fill(ranges, bound, shards, True), *fill(ranges, sure, shards, True)}
        near = {i + d for i in cut for d in (-1, 0, 1)} & {*range(len(ranges))}
        doubtful = sorted(i for i in near if not ranges[i].atomic)
        finer = _finer(sized, [ranges[i] for i in doubtful])
        ranges = sorted([r for i, r in enumerate(ranges) if i not in near or r.atomic] + finer)
    return [ranges[i].low for i in fill(ranges, sure, shards, False)], sure


def _shard_of(hash_of_text: Column, cuts: list[int]) -> Column:
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (hash_of_text >= cut).cast("int")
    return shard


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text") -> None:
    """The documents in one folder per shard; a task writes its rows of every shard, so nothing is shuffled."""
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")
    cuts, _ = minimax_cuts(materialise(docs.select(F.xxhash64(F.col(text)).alias("_h"), size.alias("_size")), "shard-sizes"), shards)
    docs.withColumn("shard", _shard_of(F.xxhash64(F.col(text)), cuts)).write.partitionBy("shard").parquet(path)


def assign_shards(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Size is the text's bytes plus one.  Other columns stay, but for those named as a result, in any case of letters.  Slots count from 0 without gaps in every shard.
    """
    h, size, part, n, offset, rank = (free_name(docs, c) for c in ("_h", "_size", "_part", "_n", "_offset", "_rank"))
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in ("size", "text_crc32", "shard", "slot")]
    slim = materialise(
        docs.select(
            *others, F.xxhash64(F.col(text)).alias(h), (F.octet_length(raw) + 1).cast("long").alias(size),
            F.crc32(raw).alias("text_crc32"), F.spark_partition_id().alias(part),
        ),
        "shard-sizes",
    )
    cuts, _ = minimax_cuts(slim.select(F.col(h).alias("_h"), F.col(size).alias("_size")), shards)
    rows = slim.withColumn("shard", _shard_of(F.col(h), cuts))
    counts = rows.groupBy("shard", part).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    local = Window.partitionBy("shard", part).orderBy(h)
    placed = rows.withColumn(rank, F.row_number().over(local) - 1).join(offsets, ["shard", part])
    return placed.select(
        *others, F.col(size).alias("size"), "text_crc32", "shard", (F.col(rank) + F.col(offset)).cast("long").alias("slot")
    )
