"""Conversations with faulty turns, repaired by the cheapest edits.

A turn is blank (no word), a duplicate (role and text of an earlier turn), truncated (its last character that is no white
space ends no sentence) or sound; the first of these counts.  Legal role initials are ``(s?(ua)+)?``.  Edits, in order of
the turns: K keeps a turn, R gives it the role user or assistant, D deletes it (blank and duplicate turns always), I
inserts an empty turn of user or assistant before it or at the end.  Of the cheapest edits the least string counts.

1. Equal turns of a conversation and turn number are one row with a count; what is a duplicate follows from the least
   turn number of each (conversation, role, text), an aggregation.  Texts travel as digests.
2. Rows are dealt by ranges of (conversation, turn), which also cuts a hot conversation; a run is what one partition
   holds of one conversation, as a sequence of symbols (initial and fault).
3. A grammar is learnt from all runs in a few rounds (Re-Pair): each counts the pairs of neighbouring symbols and makes
   rules of the most frequent ones.  Every symbol has one transfer matrix over the automaton's states in the (min, +)
   algebra, its entries a cost and a rope of edits; a rule's matrix is the product of those of its two symbols, so it is
   computed once for all conversations.  A run's matrix is the product over its compressed symbols.
4. A conversation inside one partition is solved there; matrices of runs at the borders of partitions meet by
   conversation.
5. The edits are applied turn by turn, in one pass over each conversation's turns.

Of two different strings of edits with the same cost, states and turns neither begins with the other (what follows would
be insertions, which cost), so the least string of a product is made of least strings.

Defined results: null roles and texts are one space; a role that is empty, or whose initial is not s, u or a, cannot be
kept; null turn numbers come first, equal ones go by a digest of role and text; a null conversation id names one
conversation; an empty table gives empty ones; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tonelens.llm.common import SPACE
from tonelens.plans.workdir import materialise

STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
INITIALS = "sua"
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Turn symbols: initial (s, u, a, other) twice, sound and truncated; then a turn that must go.
SYMBOLS, GONE = 9, 8
#: Rounds of pair counting, and rules made in each; a rule spans at most 2 ** ROUNDS turns.
ROUNDS, RULES = 4, 48
CACHE_ENTRIES = 100_000


class Prices(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Rope:
    """A string of edits made of two others; spelt out only where ties are compared, and at the end."""

    __slots__ = ("left", "right", "text")

    def __init__(self, left: "Rope | None" = None, right: "Rope | None" = None, text: str | None = None):
        self.left, self.right, self.text = left, right, text

    def spell(self) -> str:
        if self.text is None:
            parts, stack = [], [self]
            while stack:
                rope = stack.pop()
                if rope.text is None:
                    stack += [rope.right, rope.left]
                else:
                    parts.append(rope.text)
            self.text = "".join(parts)
        return self.text


Entry = tuple[int, Rope] | None
Matrix = tuple[Entry, ...]  # 4 by 4, row after row; None where there is no way


def _less(x: Entry, y: Entry) -> bool:
    if x is None or y is None:
        return y is None and x is not None
    return x[0] < y[0] or x[0] == y[0] and x[1].spell() < y[1].spell()


def least(entries: list[Entry]) -> Entry:
    best = None
    for entry in entries:
        if _less(entry, best):
            best = entry
    return best


def product(left: Matrix, right: Matrix) -> Matrix:
    def joined(x: Entry, y: Entry) -> Entry:
        return None if x is None or y is None else (x[0] + y[0], Rope(x[1], y[1]))

    return tuple(least([joined(left[4 * a + k], right[4 * k + b]) for k in STATES]) for a in STATES for b in STATES)


def product_of(matrices: list[Matrix]) -> Matrix:
    """Pairwise, so that strings compared on ties double in length instead of growing turn by turn."""
    while len(matrices) > 1:
        pairs = [product(x, y) for x, y in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[2 * len(pairs) :]
    return matrices[0]


def _next(state: int) -> int:
    """Where an inserted or relabelled turn leads: user comes next, after user assistant."""
    return ASSISTANT if state == USER else USER


def inserts(state: int, target: int) -> int | None:
    """Fewest empty turns from a state to a state."""
    for n in range(3):
        if state == target:
            return n
        state = _next(state)
    return None


def turn_matrix(symbol: int, prices: Prices) -> Matrix:
    """Ways through one turn: empty turns before it, then its own edit."""
    found: list[Entry] = [None] * 16

    def offer(a: int, b: int, cost: int, text: str) -> None:
        entry = (cost, Rope(text=text))
        if _less(entry, found[4 * a + b]):
            found[4 * a + b] = entry

    for a in STATES:
        for c in STATES:
            n = inserts(a, c)
            if n is None:
                continue
            before, cost = "I" * n, n * prices.insert
            offer(a, c, cost + prices.delete, before + "D")
            if symbol == GONE:
                continue
            cost += prices.truncated * (symbol >= 4)
            offer(a, _next(c), cost + prices.rerole, before + "R")
            initial = symbol % 4 + 1
            if initial == SYSTEM and c == START or initial in ROLES and initial == _next(c):
                offer(a, initial, cost, before + "K")
    return tuple(found)


def finished(matrix: Matrix, prices: Prices) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    ways = [matrix[START], matrix[ASSISTANT]]
    for b in (SYSTEM, USER):
        if matrix[b] is not None:
            n = inserts(b, ASSISTANT)
            ways.append((matrix[b][0] + n * prices.insert, Rope(matrix[b][1], Rope(text="I" * n))))
    cost, rope = least(ways)
    return cost, rope.spell()


class Grammar:
    """Rules ``left right -> symbol`` numbered from ``SYMBOLS``, and the matrix of every symbol, from the bottom up."""

    def __init__(self, rules: list[tuple[int, int]], prices: Prices):
        self.rules, self.prices = rules, prices
        self.matrices = [turn_matrix(s, prices) for s in range(SYMBOLS)]
        for left, right in rules:
            self.matrices.append(product(self.matrices[left], self.matrices[right]))
        self.known: dict[bytes, Matrix] = {}

    def matrix(self, symbols: np.ndarray) -> Matrix:
        """Of a run's compressed symbols; equal runs are solved once."""
        key = symbols.tobytes()
        if key not in self.known:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[key] = product_of([self.matrices[s] for s in symbols])
        return self.known[key]


def compress(flat: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """Symbols with every rule applied, in order, from left to right; runs are parted by -1."""
    for i, (a, b) in enumerate(rules):
        at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b))
        if not len(at):
            continue
        if a == b:  # every second one of a stretch
            opens = np.concatenate([[True], np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]) % 2 == 0]
        flat = flat.copy()
        flat[at] = SYMBOLS + i
        flat = np.delete(flat, at + 1)
    return flat


def _flat(runs: pa.Array) -> np.ndarray:
    """Binary runs as symbols with -1 after each."""
    return np.concatenate([np.append(np.frombuffer(r, np.uint8).astype(np.int16), np.int16(-1)) for r in runs.to_pylist()] or [np.zeros(0, np.int16)])


def learn(runs: DataFrame, prices: Prices = Prices()) -> Grammar:
    """Rules from the most frequent pairs of all runs; each round counts what the rounds before have left."""
    rules: list[tuple[int, int]] = []
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], rules=tuple(rules)) -> Iterator[pa.RecordBatch]:
            size = SYMBOLS + len(rules)
            total = np.zeros(size * size, np.int64)
            for batch in batches:
                flat = compress(_flat(batch.column("symbols")), rules).astype(np.int64)
                a, b = flat[:-1], flat[1:]
                total += np.bincount((a * size + b)[(a >= 0) & (b >= 0)], minlength=len(total))
            hit = np.flatnonzero(total)
            arrays = [pa.array(hit // size), pa.array(hit % size), pa.array(total[hit])]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n"])

        counts = runs.select("symbols").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        found = counts.filter("n > 1").orderBy(F.desc("n"), "a", "b").limit(RULES).collect()
        if not found:
            break
        rules += [(r["a"], r["b"]) for r in found]
    return Grammar(rules, prices)


def _digest() -> F.Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def _named(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    words = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), *words)
    return rows.withColumn("digest", _digest())


def faults(rows: DataFrame) -> DataFrame:
    """``(conv, turn, digest, initial, n, blank, sound, duplicate, truncated)`` of distinct turns; ``n`` is their number.

    ``sound`` is 1 if the first of them is neither blank nor a duplicate; the rest are counted.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    slim = rows.select("conv", "turn", "digest", F.substring("role", 1, 1).alias("initial"), last.alias("last"))
    slim = materialise(slim.groupBy("conv", "turn", "digest", "initial", "last").agg(F.count("*").alias("n")), "turn-digests")
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at")))
    firsts = slim.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(earliest.alias("first"))
    met = slim.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    blank, fresh = F.col("last") == "", F.col("turn").eqNullSafe(F.col("first.at"))
    one = lambda condition, n: F.when(condition, n).otherwise(0).cast("long")
    return met.select(
        "conv", "turn", "digest", "initial", "n", one(blank, F.col("n")).alias("blank"), one(~blank & fresh, 1).alias("sound"),
        one(~blank, F.col("n") - fresh.cast("long")).alias("duplicate"), one(~blank & fresh & ~F.col("last").isin(".", "!", "?"), 1).alias("truncated"),
    )


_RUNS = "conv {conv}, part long, symbols binary, illegal long, first string, last string, edge boolean"
_LEGAL = {"su", "ua", "au"}


def _runs(turns: DataFrame, kind: str) -> DataFrame:
    """One row for each run of a conversation in a partition; ``edge`` for the first and last of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # finished runs
        open_run: list = []  # conv, part, symbols, illegal, first, last
        seen, conv_type = 0, None

        def close(edge: bool) -> None:
            conv, part, symbols, illegal, first, last = open_run
            held.append((conv, part, bytes(symbols), illegal, first, last, edge))

        def results() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [()] * 7
            held.clear()
            kinds = [conv_type, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "part", "symbols", "illegal", "first", "last", "edge"]
            )

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "part", "initial", "n", "sound", "truncated")]
            for conv, part, initial, n, sound, truncated in zip(*columns, strict=True):
                if not open_run or open_run[0] != conv:
                    if open_run:
                        close(seen == 1)
                    seen += 1
                    open_run = [conv, part, bytearray(), 0, initial, initial]
                else:
                    open_run[3] += (open_run[5] + initial) not in _LEGAL
                if sound:
                    open_run[2].append((INITIALS.index(initial) if initial and initial in INITIALS else 3) + 4 * truncated)
                open_run[2] += bytes([GONE]) * (n - sound)
                open_run[3] += n - 1
                open_run[5] = initial
            yield results()
        if open_run:
            close(True)
            yield results()

    return turns.mapInArrow(run, _RUNS.format(conv=kind))


_SOLVED = "conv {conv}, part long, illegal long, first string, last string, cost long, audit string, costs array<long>, audits array<string>"
_SOLVED_TYPES = [
    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()),
]
_SOLVED_NAMES = ["conv", "part", "illegal", "first", "last", "cost", "audit", "costs", "audits"]


def _batch(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_SOLVED_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [conv_type, *_SOLVED_TYPES], strict=True)], names=_SOLVED_NAMES)


def _solved(runs: DataFrame, grammar: Grammar, kind: str) -> DataFrame:
    """Whole conversations with cost and edits; runs at borders with their matrix instead."""
    sent = runs.sparkSession.sparkContext.broadcast((grammar.rules, grammar.prices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*sent.value)
        for batch in batches:
            flat = compress(_flat(batch.column("symbols")), grammar.rules)
            ends = np.flatnonzero(flat == -1)
            columns = [batch.column(c).to_pylist() for c in ("conv", "part", "illegal", "first", "last", "edge")]
            rows, start = [], 0
            for end, *own, edge in zip(ends, *columns, strict=True):
                matrix = grammar.matrix(flat[start:end])
                start = end + 1
                if edge:
                    rows.append((*own, None, None, [e and e[0] for e in matrix], [e and e[1].spell() for e in matrix]))
                else:
                    rows.append((*own, *finished(matrix, grammar.prices), None, None))
            yield _batch(rows, batch.schema.field("conv").type)

    return runs.mapInArrow(run, _SOLVED.format(conv=kind))


def _met(edges: DataFrame, prices: Prices, kind: str) -> DataFrame:
    """Conversations from the runs of several partitions; at most two runs a partition come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        done: list[tuple] = []
        conv_type = None

        def solve() -> None:
            matrices = [tuple(None if c is None else (c, Rope(text=t)) for c, t in zip(g[4], g[5], strict=True)) for g in group]
            illegal = sum(g[1] for g in group) + sum((x[3] + y[2]) not in _LEGAL for x, y in zip(group, group[1:], strict=False))
            done.append((group[0][0], 0, illegal, group[0][2], group[-1][3], *finished(product_of(matrices), prices), None, None))
            group.clear()

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "illegal", "first", "last", "costs", "audits")), strict=True):
                if group and group[0][0] != row[0]:
                    solve()
                group.append(row)
            yield _batch(done, conv_type)
            done.clear()
        if group:
            solve()
            yield _batch(done, conv_type)

    return edges.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, _SOLVED.format(conv=kind))


def audit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", prices: Prices = Prices()) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)``, one row for each conversation of ``turns``.

    ``gaps`` are turn numbers missing between the least and the greatest; ``illegal`` neighbouring initials other than
    su, ua, au; ``audit`` the initials of the edits.
    """
    kind = turns.schema[conv].dataType.simpleString()
    found = materialise(faults(_named(turns, conv, turn, role, text)), "turn-faults")
    order = ["conv", "turn", "digest"]
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    runs = materialise(_runs(dealt.select("conv", "part", "initial", "n", "sound", "truncated"), kind), "turn-runs")
    solved = materialise(_solved(runs, learn(runs, prices), kind), "turn-audits")
    columns = ["conv", "illegal", "cost", "audit"]
    audits = solved.filter("audit IS NOT NULL").select(columns).union(_met(solved.filter("audit IS NULL"), prices, kind).select(columns))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    stats = found.groupBy("conv", "turn").agg(*sums).groupBy(F.col("conv").alias("c")).agg(gaps, *sums)
    both = audits.join(stats, F.col("conv").eqNullSafe(F.col("c")))
    return both.select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repair(turns: DataFrame, audits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, edit, role, text)``: one row for each edit of ``audits``, role and text null where it deletes.

    The rows of a conversation follow each other in their order within one partition, through which they stream.
    """
    kind = turns.schema[conv].dataType.simpleString()
    rows = _named(turns, conv, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select(F.col(f"`{conv}`").alias("conv"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest")), "audit")
    together = rows.union(heads).withColumn("body", F.col("audit").isNull())
    dealt = together.repartition("conv").sortWithinPartitions("conv", "body", "turn", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, edits, at, tail, state = None, "", 0, 0, START  # tail: where only insertions are left
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                state = _next(state)
                out.append((own, "I", ROLES[state], ""))
                at += 1

        def results(conv_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            kinds = [conv_type, pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "edit", "role", "text"])

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for c, r, t, head in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "audit")), strict=True):
                if head is not None:
                    own, edits, at, tail, state = c, head, 0, len(head.rstrip("I")), START
                    continue
                insert()
                edit = edits[at]
                at += 1
                if edit == "D":
                    out.append((c, edit, None, None))
                else:
                    state = _next(state) if edit == "R" else INITIALS.index(r[0]) + 1
                    out.append((c, edit, ROLES[state] if edit == "R" else r, t))
                if at == tail:
                    insert()
            yield results(conv_type)

    return dealt.select("conv", "role", "text", "audit").mapInArrow(run, f"conv {kind}, edit string, role string, text string").withColumnRenamed("conv", conv)
