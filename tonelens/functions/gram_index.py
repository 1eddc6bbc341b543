"""Many literals looked up in a text at once, inside the row.

Each literal is filed under its first characters, ``FILED`` of them or all if it has fewer.  One regular expression tries
the filed strings character by character at every place of a text, behind a test of the sets of first characters, and takes
the longest; the others that begin there are its beginnings, and filed with it.  A distinct find opens a bucket of the
index, found by a checksum; only what is longer than it is filed is still looked up in the text.

Where more than ``WIDEST`` characters may follow at one place, trying them takes longer than a hash set: literals are then
filed under ``GRAM`` characters, and the text's distinct grams of the lengths in use are intersected with the filed ones.
The index is one constant of the plan: looking up is a projection, without a join, a shuffle or a key.
"""

from __future__ import annotations

import json
import zlib
from typing import NamedTuple

from pyspark.sql import Column, functions as F

#: Characters under which a literal is filed, and where a text's grams are intersected.
FILED, GRAM = 24, 6
#: Most characters that a regular expression tries one after the other.
WIDEST = 64


class Entry(NamedTuple):
    """``literal`` must occur; then ``pattern``, if there is one, must match.  ``group`` and ``number`` name the entry."""

    literal: str
    group: int
    number: int
    pattern: str | None = None


def _any_of(characters: set[str]) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(characters)) + "]"


def _followers(filed: list[str]) -> dict[str, list[str]]:
    """First characters, and what goes on behind each."""
    out: dict[str, list[str]] = {}
    for s in filed:
        if s:
            out.setdefault(s[0], []).append(s[1:])
    return out


def _width(filed: list[str]) -> int:
    """Most characters that may follow at one place."""
    after = _followers(filed)
    return max([len(after), *map(_width, after.values())])


def _longest(filed: list[str]) -> str:
    """A pattern that matches the longest of ``filed``, distinct strings, that there is."""
    after = _followers(filed)
    if not after:
        return ""
    spelt = {c: c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}" for c in after}
    branches = "|".join(spelt[c] + _longest(rest) for c, rest in after.items())
    return f"(?:{branches})?" if "" in filed else f"(?:{branches})" if len(after) > 1 else branches


def _tried(text: Column, filed: list[str]) -> Column:
    """At each place of the text the longest of ``filed``, if there is one."""
    first = "".join(_any_of({s[i] for s in filed}) for i in range(min(GRAM, *map(len, filed))))
    return F.regexp_extract_all(text, F.lit(f"(?={first})(?=({_longest(filed)}))"), F.lit(1))


def _intersected(text: Column, filed: list[str]) -> Column:
    every = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sorted({*map(len, filed)})])
    return F.array_intersect(every, F.from_json(F.lit(json.dumps(filed)), "array<string>"))


def found(text: Column, entries: list[Entry]) -> Column:
    """The distinct ``(group, number)`` of the entries that a text has; none for a null text."""
    if not entries:
        return F.array().cast("array<struct<group:int,number:int>>")
    tried = _width(sorted({e.literal[:FILED] for e in entries})) <= WIDEST
    most = FILED if tried else GRAM
    under: dict[str, list[Entry]] = {}
    for e in entries:
        under.setdefault(e.literal[:most], []).append(e)
    size = 1 << len(under).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for gram in under:
        # of a find by trying, its beginnings are finds too
        finds = [gram[:n] for n in range(1, len(gram) + 1) if gram[:n] in under] if tried else [gram]
        here = [{"gram": gram, **e._asdict(), "whole": tried and len(e.literal) <= most} for f in finds for e in under[f]]
        buckets[zlib.crc32(gram.encode()) % size] += here
    kind = "array<array<struct<gram:string,literal:string,group:int,number:int,pattern:string,whole:boolean>>>"
    table = F.from_json(F.lit(json.dumps(buckets)), kind)
    candidates = F.array_distinct((_tried if tried else _intersected)(text, sorted(under)))

    def in_bucket(gram: Column) -> Column:
        def holds(e: Column) -> Column:
            return (e["gram"] == gram) & (e["whole"] | F.contains(text, e["literal"])) & (e["pattern"].isNull() | F.rlike(text, e["pattern"]))

        bucket = F.get(table, (F.crc32(gram.cast("binary")) % size).cast("int"))
        return F.transform(F.filter(bucket, holds), lambda e: F.struct(e["group"].alias("group"), e["number"].alias("number")))

    return F.coalesce(F.array_distinct(F.flatten(F.transform(candidates, in_bucket))), F.array().cast("array<struct<group:int,number:int>>"))


def count_of(hits: Column, group: int) -> Column:
    """How many of the entries found belong to a group."""
    return F.size(F.filter(hits, lambda e: e["group"] == group))
