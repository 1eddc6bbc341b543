"""Token sequences of bounded length, packed harmonically.

A document is its token ids and an end id.  A length L belongs to class k = capacity // L, whose slot is capacity // k
tokens; a sequence of class k takes k pieces of that class, whatever else is in the table.  So every task packs what
it reads on its own: one pass, no shuffle, at most one open sequence per class in memory, and a lost task is redone
alone.  A piece that would leave more than 1/``SLACK`` of its slot empty is cut at the next class's slot, which it fills,
and the rest is classed anew.  What is left in open sequences when a task ends is laid end to end and cut into full
sequences; the last of them is cut into runs of power-of-two lengths, which need no padding.

Tokens come from a file of the ``tokenizers`` library.  For files that split at white space as ``WORD_SPLIT`` does, ids
are remembered by white-space separated chunk in a bounded table; the ids are those of the whole text.

Defined results: a null text is an empty one, whose only id is the end id; documents longer than the capacity are cut;
repeated rows are packed as often as they occur; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import json
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tonelens.llm.common import slices, utf8

CAPACITY = 4096
END_ID = 2
#: A piece may leave one in so many tokens of its slot empty.
SLACK = 32
#: Most chunks a worker remembers.
CACHE_ENTRIES = 1_000_000
#: Tokens in one batch of results.
BATCH_TOKENS = 1 << 20

#: Fixed value: the split pattern of the files that the chunk table works for.
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


PUNCTUATION = string.punctuation.encode()


def _latin(word: str) -> bool:
    """Letters below U+0180 only: composed forms, lower-cased one by one (but for U+0130, which becomes two)."""
    return word.isalpha() and max(word) < "\u0180" and "\u0130" not in word


class ChunkIds(dict):
    """White-space separated chunk, A to Z lower-cased -> its ids as little-endian unsigned 32-bit integers.

    A chunk that ends in ASCII punctuation after a letter below U+0180 or an ASCII digit is the chunk before it and the
    punctuation, because the split pattern parts them.  A chunk of letters below U+0180 is one word for the model;
    anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_chunk = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and (split.get("pattern"), split.get("behavior")) == ({"Regex": WORD_SPLIT}, "Removed")
            and [r["type"] for r in rest] == ["ByteLevel"]
            and not rest[0]["use_regex"]
        )
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        odd = iter(range(256, 512))
        self.byte_letters = {b: b if b in plain else next(odd) for b in range(256)}

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(letters)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def _ids(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters are their own byte letters
            return self._word(chunk.decode())
        head = chunk.rstrip(PUNCTUATION)
        if head and len(head) < len(chunk) and (head[-1:].isalnum() or _latin(head.decode()[-1])):
            return self[head] + self[chunk[len(head) :]]
        word = chunk.decode()
        if _latin(word):
            return self._word(word.lower().encode().decode("latin-1").translate(self.byte_letters))
        return self.whole(chunk)

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[chunk] = ids = self._ids(chunk)
        return ids

    def of(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        if not self.by_chunk or b"<|" in text:  # may hold a special token, which is not lower-cased
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


class Packer:
    """Packs what one task reads.  ``placed`` collects (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, sequence: int):
        self.capacity, self.sequence = capacity, sequence
        self.open: dict[int, list[tuple]] = {}
        self.placed: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.placed.append((doc, start, ids, tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start, tokens = 0, len(ids)
        while start < tokens:
            left = min(tokens - start, self.capacity)
            k = self.capacity // left
            slot = self.capacity // k
            if (slot - left) * SLACK > slot:
                k += 1
                left = self.capacity // k
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, start, ids[start : start + left], tokens))
            start += left
            if len(pieces) == k:
                self._close(self.open.pop(k))

    def finish(self) -> None:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(len(p[2]) for p in rest)
        sizes = [self.capacity] * (total // self.capacity)
        last = total % self.capacity
        sizes += [1 << b for b in reversed(range(last.bit_length())) if last >> b & 1]
        held: list[tuple] = []
        full, at = 0, 0  # tokens held, and the size that is being filled
        for doc, start, ids, tokens in rest:
            while len(ids):
                room = sizes[at] - full
                held.append((doc, start, ids[:room], tokens))
                full += len(held[-1][2])
                start, ids = start + min(room, len(ids)), ids[room:]
                if full == sizes[at]:
                    self._close(held)
                    held, full, at = [], 0, at + 1
        self.open = {}


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, content: str = "ids") -> DataFrame:
    """Pieces ``(key, start, length, doc_tokens, sequence_id, offset, ids)``; ``tokenizer`` is a file's path on every machine.

    With ``content="checksum"``, ``ids_crc32`` instead of the ids: the checksum of them as little-endian unsigned 32-bit
    integers, taken in the same task.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    last = "ids_crc32 long" if content == "checksum" else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = chunk_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        key_type = None

        def results() -> pa.RecordBatch:
            doc, start, ids, tokens, sequence, offset = zip(*packer.placed, strict=True) if packer.placed else [()] * 6
            packer.placed = []
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            if content == "checksum":
                values = pa.array(list(map(zlib.crc32, ids)), pa.int64())
            else:
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)))
            longs = [pa.array(c, pa.int64()) for c in (start, lengths, tokens, sequence, offset)]
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, key_type), *longs, values],
                names=[key, "start", "length", "doc_tokens", "sequence_id", "offset", last.split()[0]],
            )

        waiting = 0
        for whole in batches:
            key_type = whole.schema.field("key").type
            for batch in slices(whole, "text"):
                for doc, t in zip(batch.column("key").to_pylist(), utf8(batch, "text"), strict=True):
                    ids = np.frombuffer(known.of(t) + end, "<u4")
                    packer.add(doc, ids)
                    waiting += len(ids)
                    if waiting >= BATCH_TOKENS:
                        yield results()
                        waiting = 0
        if key_type is not None:
            packer.finish()
            yield results()

    return slim.mapInArrow(run, f"`{key}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, {last}")
