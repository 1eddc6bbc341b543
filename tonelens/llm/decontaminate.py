"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Texts are normalised to words: A to Z lower-cased, then runs of ASCII letters, digits and anything outside ASCII.  An
item's windows are its runs of ``window`` words, or all its words if it has fewer.  Every distinct word of the items
becomes one character of a private alphabet, so a window is a string of 13 characters, a document is a string with one
character per word (one more character stands for all other words), and an automaton over such strings reports word
positions.  A text is scanned once; word positions go back to character offsets only where something was found.

Scanning is narrow: nothing is shuffled, and what a hot source holds is as cheap as anything else.  The items are
collected in blocks of at most ``BLOCK_BYTES`` each; with more than one block the table is scanned once per block, its
hits so far written to the shared folder in between.

Defined results: a null or empty text has no words and no hits; items without words have no window; two items with the
same text or id both count, an id once; a null item id counts as the string ``null``; overlapping occurrences count a
word once; repeated documents get equal rows; columns of ``docs`` stay, but for those of the result's names; with no
items or no documents nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tonelens.llm.common import set_aside, slices, utf8
from tonelens.plans.workdir import materialise

#: Most bytes of item text that one automaton is built from.
BLOCK_BYTES = 1 << 20
WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20

_LETTERS = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of words as they are, A to Z lower-cased, all others a blank.
NORMAL = bytes(b if b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_OTHER = "\0"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def _letter(n: int) -> str:
    """The ``n``-th character of the private alphabet; surrogates are left out."""
    return chr(n + 1 if n + 1 < 0xD800 else n + 0x801)


class Finder:
    """Automaton over the windows of some items."""

    def __init__(self, items: tuple[tuple[str, bytes], ...], window: int):
        self.alphabet: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            word_list = words_of(text)
            coded = "".join(self.alphabet.setdefault(w, _letter(len(self.alphabet))) for w in word_list)
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                owners.setdefault(coded[i : i + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), ids))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words in the text, merged runs of hit words (start, stop), items found."""
        word_list = words_of(text)
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.empty and word_list:
            coded = "".join(map(self.alphabet.get, word_list, repeat(_OTHER)))
            runs = merged((end + 1 - n, end + 1) for end, (n, ids) in self.automaton.iter(coded) if not found.update(ids))
        return len(word_list), runs, found


def merged(runs) -> list[tuple[int, int]]:
    """Overlapping or touching runs made one, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def spans_of(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of runs of words."""
    if not runs:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    at = lambda byte: len(text[:byte].decode())
    return [{"start": at(places[a][0]), "stop": at(places[b - 1][1])} for a, b in runs]


@lru_cache(maxsize=1)
def _finder(items: tuple[tuple[str, bytes], ...], window: int) -> Finder:
    return Finder(items, window)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
COLUMNS = {
    "n_words": "long", "hit_words": "array<struct<start:long,stop:long>>", "items": "array<string>",
    "spans": "array<struct<start:long,stop:long>>",
}


def _scan(docs: DataFrame, items: tuple[tuple[str, bytes], ...], window: int, text: str, first: bool) -> DataFrame:
    names = [*(c for c in docs.columns if c.lower() not in COLUMNS), *COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(items, window)
        for whole in batches:
            for batch in slices(whole, text):
                texts = utf8(batch, text)
                counts, runs, ids = zip(*map(finder.find, texts), strict=True)
                if not first:
                    old_runs, old_ids = batch.column("hit_words").to_pylist(), batch.column("items").to_pylist()
                    runs = [merged([*r, *((x["start"], x["stop"]) for x in old)]) for r, old in zip(runs, old_runs, strict=True)]
                    ids = [{*i, *old} for i, old in zip(ids, old_ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in names[: -len(COLUMNS)]),
                        pa.array(counts, pa.int64()),
                        pa.array([[{"start": a, "stop": b} for a, b in r] for r in runs], _RUNS),
                        pa.array([sorted(i) for i in ids], pa.list_(pa.string())),
                        pa.array([spans_of(t, r) for t, r in zip(texts, runs, strict=True)], _RUNS),
                    ],
                    names=names,
                )

    kept = [docs.schema[c] for c in names[: -len(COLUMNS)]]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{k} {v}" for k, v in COLUMNS.items())])
    return docs.mapInArrow(run, schema)


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[tuple[str, bytes], ...]]:
    """The items in runs of bounded size, one at a time; at least one run, which may be empty."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).cast("binary").alias("t"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for r in rows.filter(F.length("t") > 0).orderBy("i", "t").toLocalIterator():
        if block and size + len(r["t"]) > most:
            yield tuple(block)
            block, size = [], 0
        block.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    yield tuple(block)


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_words`` (runs of hit words), ``items`` (ids found, as strings),
    ``spans`` (the runs as character offsets) and ``contaminated``."""
    blocks = _blocks(items, item_id, item_text, block_bytes)
    out = _scan(docs.drop("n_hit", "contaminated"), next(blocks), window, text, first=True)
    for block in blocks:
        out = _scan(materialise(out, "item-hits"), block, window, text, first=False)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, columns unchanged."""
    own = set_aside(docs, {*COLUMNS, "n_hit", "contaminated"} - {text})
    found = find_items(docs.withColumnsRenamed(own), items, text, **how).filter(~F.col("contaminated"))
    return found.select([F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
