"""Token counts by section: a document is encoded once, its tokens are dealt to the sections they overlap.

Sections partition the text: lines with their line breaks, or the fields of a row joined by a separator that belongs to
the field before it.  Token spans follow from the byte lengths of the tokens; an interval join of two ascending lists of
ends finds the sections of a token's first and last byte.  A token that crosses a boundary is dealt by an explicit rule:

``first``  to the section of its first byte;
``last``   to the section of its last byte;
``most``   to the section it overlaps most, of equals to the first of them;
``shares`` to all it overlaps, in proportion to the overlap in bytes.

The table is read once and nothing is shuffled.  Tokens are those of a byte-level BPE given as a file of ranks.

Defined results: a null or empty text has one section without tokens; an empty line is a section of its line break;
counts of a document add up to its tokens under each rule; repeated rows give repeated results; an empty table gives
none; only the key and the text or fields are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from tonelens.llm.common import slices, utf8

RULES = ("first", "last", "most", "shares")


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: bytes) -> np.ndarray:
        """Byte offset of every token's end."""
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text.decode())])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def deal(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section under ``rule``, and tokens that overlap it and another one too."""
    n = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = np.flatnonzero(first != last)
    crossed = np.zeros(n, np.int64)
    counts = np.bincount(last if rule == "last" else first, minlength=n).astype(np.float64)
    for t in crossing:
        a, b = first[t], last[t]
        crossed[a : b + 1] += 1
        if rule in ("most", "shares"):
            cuts = np.concatenate([[starts[t]], section_ends[a:b], [token_ends[t]]])
            overlap = np.diff(cuts)
            counts[a] -= 1
            if rule == "most":
                counts[a + np.argmax(overlap)] += 1
            else:
                counts[a : b + 1] += overlap / overlap.sum()
    return counts, crossed


def line_ends(text: bytes) -> np.ndarray:
    """Ends of the lines, their breaks included; the last line may have none."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def _attribute(slim: DataFrame, key: str, kind: str, tokens: tuple[str, str], rule: str, fields: tuple[str, ...], separator: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {', '.join(RULES)}")
    columns = ["text"] if not fields else [f"f{i}" for i in range(len(fields))]
    gap = separator.encode()
    whole_counts = rule != "shares"
    count_type = pa.int64() if whole_counts else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(*tokens)
        for whole in batches:
            for batch in slices(whole, columns[0], most_rows=512):
                parts = [utf8(batch, c) for c in columns]
                taken, section, begin, end, counts, crossed = [], [], [], [], [], []
                for row in range(batch.num_rows):
                    if fields:
                        pieces = [p[row] + gap for p in parts]
                        pieces[-1] = parts[-1][row]
                        text, ends = b"".join(pieces), np.cumsum([len(p) for p in pieces])
                    else:
                        text = parts[0][row]
                        ends = line_ends(text)
                    c, x = deal(known.ends(text), ends, rule) if text else (np.zeros(len(ends)), np.zeros(len(ends), np.int64))
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    taken.append(np.full(len(ends), row))
                    section.append(np.arange(len(ends)))
                    begin.append(chars[np.concatenate([[0], ends[:-1]])])
                    end.append(chars[ends])
                    counts.append(c)
                    crossed.append(x)
                longs = [pa.array(np.concatenate(v), pa.int64()) for v in (section, begin, end)]
                tokens_of = np.concatenate(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(np.concatenate(taken))), *longs,
                        pa.array(tokens_of.astype(np.int64) if whole_counts else tokens_of, count_type),
                        pa.array(np.concatenate(crossed), pa.int64()),
                    ],
                    names=[key, "section", "char_start", "char_end", "n_tokens", "n_crossing"],
                )

    return slim.mapInArrow(
        run,
        f"`{key}` {kind}, section long, char_start long, char_end long, n_tokens {'long' if whole_counts else 'double'}, n_crossing long",
    )


def tokens_by_line(docs: DataFrame, tokens: tuple[str, str], key: str = "doc_id", text: str = "text", rule: str = "most") -> DataFrame:
    """One row per line: ``(key, section, char_start, char_end, n_tokens, n_crossing)``.

    ``tokens`` is the path of a ranks file, on every machine, and its split pattern.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _attribute(slim, key, docs.schema[key].dataType.simpleString(), tokens, rule, (), "")


def tokens_by_field(docs: DataFrame, tokens: tuple[str, str], fields: list[str], key: str = "doc_id", separator: str = "\n", rule: str = "most") -> DataFrame:
    """One row per field of a row: its fields are joined, encoded once, and tokens dealt to them."""
    slim = docs.select(F.col(key).alias("key"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return _attribute(slim, key, docs.schema[key].dataType.simpleString(), tokens, rule, tuple(fields), separator)
