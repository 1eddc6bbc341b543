"""A Bloom filter of a set of 64-bit hashes, of a fixed size, tested inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tonelens.plans.sizing import collect_bounded

#: 64-bit words of a filter: one megabyte, whatever the set.  A fuller filter lets more through, never less.
WORDS = 1 << 17


def _places(h: Column, words: int) -> list[Column]:
    """The two bits of a hash: from its lower and from its upper half."""
    last = F.lit(words * 64 - 1).cast("long")
    return [h.bitwiseAND(last), F.shiftrightunsigned(h, 32).bitwiseAND(last)]


def _word(place: Column) -> Column:
    return F.shiftright(place, 6).cast("int")


def _bit(place: Column) -> Column:
    return place.bitwiseAND(F.lit(63).cast("long")).cast("int")


def build(hashes: DataFrame, name: str, words: int = WORDS) -> list[int]:
    """The filter of column ``name`` as ``words`` numbers (a power of two).  Bits are joined in Spark; at most ``words`` rows come back."""
    bits = hashes.select(F.explode(F.array(*_places(F.col(name), words))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("p")))
    found = bits.groupBy(_word(F.col("p")).alias("w")).agg(F.bit_or(one).alias("b"))
    out = [0] * words
    for r in collect_bounded(found, words, "words of a filter"):
        out[r["w"]] = r["b"]
    return out


def constant(filter_words: list[int]) -> Column:
    """The filter as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, filter_words))), ",").cast("array<bigint>")


def may_hold(table: Column, h: Column, words: int) -> Column:
    """False only for hashes that were not in the set; ``table`` is the :func:`constant`."""
    both = [F.getbit(F.get(table, _word(p)), _bit(p)) == 1 for p in _places(h, words)]
    return both[0] & both[1]
