"""Conversations repaired to legal turns at least cost, then rendered.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the assistant last.  A
source turn may keep its role or be relabelled; it may open a turn or be merged into the turn before it; empty turns may
be inserted before it, and after the last.  Each choice has a price.  The automaton has four states, the role of the
last turn or none, and a source turn moves it at the cost of a 4 by 4 table that depends on its role only.

Such tables multiply (least sums instead of sums of products), so a conversation of any length is repaired by many tasks:

1. turns are dealt to partitions by ranges of (conversation, turn), which also cuts a hot conversation, and sorted; each
   task multiplies the tables of every run of one conversation it holds;
2. the few runs of a conversation are put in order, the cheapest way through them fixes the state at each border;
3. each run is repaired on its own between its border states, and its turns rendered.

The rendered conversation is the concatenation of its fragments in order of ``position``.

Defined results: of equally cheap repairs, the last states are fixed first, and at each the first of: open, merge,
insert, from the lowest state; a null or unknown role can become any role at the price of a relabelling; null texts are
empty; equal turn numbers go by role and text; repeated rows are turns of their own; a null conversation id names one
conversation; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tonelens.plans.workdir import materialise

ROLES = ("system", "user", "assistant")
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Which roles may follow a state.
FOLLOWS = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
STATES = range(4)
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"


class Prices(NamedTuple):
    merge: int = 1
    relabel: int = 2
    insert: int = 3


class Move(NamedTuple):
    cost: float
    merge: bool
    inserted: tuple[int, ...]


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest runs of empty turns that make ``role`` legal after ``state``."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for state in STATES:
        level: list[tuple[int, ...]] = [()]
        for _ in STATES:
            for path in level:
                for role in FOLLOWS[path[-1] if path else state]:
                    found.setdefault((state, role), path)
            level = [(*path, role) for path in level for role in FOLLOWS[path[-1] if path else state]]
    return found


PATHS = _paths()


def moves(role: int, prices: Prices) -> dict[tuple[int, int], Move]:
    """Cheapest way from a state to a state through one source turn of ``role`` (0: unknown)."""
    table = {}
    for state in STATES:
        for target in (SYSTEM, USER, ASSISTANT):
            relabel = 0 if target == role else prices.relabel
            ways = []
            if (state, target) in PATHS:
                path = PATHS[state, target]
                ways.append(Move(relabel + prices.insert * len(path), False, path))
            if state == target:
                ways.append(Move(relabel + prices.merge, True, ()))
            if ways:
                table[state, target] = min(ways, key=lambda m: (m.cost, m.merge))
    return table


def ending(state: int, prices: Prices) -> Move:
    """What it takes to end in ``state``."""
    if state in (NONE, ASSISTANT):
        return Move(0, False, ())
    path = (*PATHS[state, ASSISTANT], ASSISTANT)
    return Move(prices.insert * len(path), False, path)


Table = tuple[float, ...]  # 4 by 4, row after row
IDENTITY: Table = tuple(0.0 if a == b else math.inf for a in STATES for b in STATES)


def product(left: Table, right: Table) -> Table:
    return tuple(min(left[4 * a + k] + right[4 * k + b] for k in STATES) for a in STATES for b in STATES)


def _code(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else NONE


class Runs:
    """Products of turn tables; they differ by constants from few distinct ones, so each is computed once."""

    def __init__(self, prices: Prices):
        self.single = []
        for role in STATES:
            ways = moves(role, prices)
            self.single.append(tuple(ways[a, b].cost if (a, b) in ways else math.inf for a in STATES for b in STATES))
        self.known: dict[tuple[Table, int], tuple[float, Table]] = {}

    def extend(self, total: float, table: Table, role: int) -> tuple[float, Table]:
        step = self.known.get((table, role))
        if step is None:
            found = product(table, self.single[role])
            low = min(found)
            step = self.known[table, role] = low, tuple(x - low for x in found)
        return total + step[0], step[1]


def best_borders(tables: list[Table], prices: Prices) -> tuple[float, list[int]]:
    """Least cost of a conversation's runs, and the state at each border, the last one included."""
    costs = [0.0, math.inf, math.inf, math.inf]
    steps = []
    for table in tables:
        ways = [[costs[a] + table[4 * a + b] for a in STATES] for b in STATES]
        steps.append([min(STATES, key=w.__getitem__) for w in ways])
        costs = [min(w) for w in ways]
    totals = [costs[s] + ending(s, prices).cost for s in STATES]
    state = min(STATES, key=totals.__getitem__)
    cost, borders = totals[state], [state]
    for step in reversed(steps):
        state = step[state]
        borders.append(state)
    return cost, borders[::-1]


def repair(roles: list[int], entry: int, exit_state: int, prices: Prices) -> list[tuple[int, Move]]:
    """Role and move of each turn on the cheapest way from ``entry`` to ``exit_state``."""
    tables = [moves(r, prices) for r in STATES]
    costs = [0.0 if s == entry else math.inf for s in STATES]
    steps: list[list[int]] = []
    for role in roles:
        ways = [[costs[a] + (tables[role][a, b].cost if (a, b) in tables[role] else math.inf) for a in STATES] for b in STATES]
        steps.append([min(STATES, key=w.__getitem__) for w in ways])
        costs = [min(w) for w in ways]
    state, found = exit_state, []
    for role, step in zip(reversed(roles), reversed(steps), strict=True):
        before = step[state]
        found.append((state, tables[role][before, state]))
        state = before
    return found[::-1]


def _marker(role: int) -> str:
    return OPEN.format(role=ROLES[role - 1])


def fragment(text: str, state: int, before: int, move: Move) -> str:
    """A turn's part of the rendered conversation; markers inside a text are broken up."""
    text = text.replace("<|", "< |")
    if move.merge:
        return "\n" + text
    empty = "".join(_marker(r) + CLOSE for r in move.inserted)
    return (CLOSE if before != NONE else "") + empty + _marker(state) + text


_TURNS = "conv {conv}, turn {turn}, role string, text string, part long, pos long"


def _sorted_runs(rows: DataFrame, schema: str, prices: Prices) -> DataFrame:
    """Adds ``run``, the table and length of a run, to the last turn of every run of one conversation in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(prices)
        held = None  # the last row of the batch before: its run may go on
        total, table, n = 0.0, IDENTITY, 0
        kind = pa.list_(pa.float64())

        def ended() -> list[float]:
            return [float(n), *(total + x for x in table)]

        for batch in batches:
            if not batch.num_rows:
                continue
            convs = batch.column("conv").to_pylist()
            ends: list[list[float] | None] = [None] * len(convs)
            if held is not None:
                over = held.column("conv")[0].as_py() != convs[0]
                yield held.append_column("run", pa.array([ended() if over else None], kind))
                if over:
                    total, table, n = 0.0, IDENTITY, 0
            for i, role in enumerate(batch.column("role").to_pylist()):
                if i and convs[i] != convs[i - 1]:
                    ends[i - 1] = ended()
                    total, table, n = 0.0, IDENTITY, 0
                total, table = runs.extend(total, table, _code(role))
                n += 1
            last = len(convs) - 1
            yield batch.slice(0, last).append_column("run", pa.array(ends[:last], kind))
            held = batch.slice(last)
        if held is not None:
            yield held.append_column("run", pa.array([ended()], kind))

    return rows.mapInArrow(run, schema + ", run array<double>")


_BORDERS = pa.schema([("entry", pa.int64()), ("exit", pa.int64()), ("first", pa.int64()), ("last", pa.bool_()), ("cost", pa.float64())])


def _solved(runs: DataFrame, conv: str, prices: Prices) -> DataFrame:
    """``(conv, part, entry, exit, first, last, cost)`` of every run, conversation by conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        done: list[tuple] = []
        conv_type = None

        def solve() -> None:
            cost, borders = best_borders([tuple(r[1:]) for _, _, r in group], prices)
            first = 0
            for i, (c, part, r) in enumerate(group):
                done.append((c, part, borders[i], borders[i + 1], first, i + 1 == len(group), cost))
                first += int(r[0])
            group.clear()

        def results() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 7
            done.clear()
            arrays = [pa.array(columns[0], conv_type), pa.array(columns[1], pa.int64())]
            arrays += [pa.array(c, f.type) for c, f in zip(columns[2:], _BORDERS, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["conv", "part", *_BORDERS.names])

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "run")), strict=True):
                if group and group[0][0] != row[0]:
                    solve()
                group.append(row)
            yield results()
        if group:
            solve()
            yield results()

    dealt = runs.repartition("conv").sortWithinPartitions("conv", "part")
    return dealt.mapInArrow(run, f"conv {conv}, part long, entry long, exit long, first long, last boolean, cost double")


_RESULT = "conv_cost double, position long, new_role string, action string, inserted array<string>, added array<string>, fragment string"


def _repaired(rows: DataFrame, conv: str, turn: str, prices: Prices) -> DataFrame:
    """Decides and renders run by run; ``rows`` has each run's borders before its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = lambda path: [ROLES[r - 1] for r in path]
        border, turns, out = None, [], []
        types = None

        def solve() -> None:
            entry, exit_state, first, last, cost = border
            state = entry
            ways = repair([_code(t[2]) for t in turns], entry, exit_state, prices)
            for i, ((c, number, role, text), (new, move)) in enumerate(zip(turns, ways, strict=True)):
                rendered = fragment(text or "", new, state, move)
                added: tuple[int, ...] = ()
                if last and i + 1 == len(turns):
                    added = ending(new, prices).inserted
                    rendered += CLOSE + "".join(_marker(r) + CLOSE for r in added)
                action = " and ".join([*(["relabel"] if _code(role) != new else []), *(["merge"] if move.merge else [])]) or "keep"
                out.append((c, number, role, cost, first + i, ROLES[new - 1], action, names(move.inserted), names(added), rendered))
                state = new
            turns.clear()

        def results() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 10
            out.clear()
            kinds = [*types, pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["conv", "turn", "role", "conv_cost", "position", "new_role", "action", "inserted", "added", "fragment"],
            )

        for batch in batches:
            types = [batch.schema.field("conv").type, batch.schema.field("turn").type]
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "entry", "exit", "first", "last", "cost")]
            for c, number, role, text, *found in zip(*columns, strict=True):
                if found[0] is not None:
                    if turns:
                        solve()
                    border = found
                else:
                    turns.append((c, number, role, text))
            yield results()
        if turns:
            solve()
            yield results()

    return rows.mapInArrow(run, f"conv {conv}, turn {turn}, role string, {_RESULT}")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", prices: Prices = Prices()) -> DataFrame:
    """One row per source turn: ``(conv, turn, role, conv_cost, position, new_role, action, inserted, added, fragment)``.

    ``inserted`` are empty turns before this one, ``added`` those that end the conversation; ``conv_cost`` is the whole
    conversation's.
    """
    conv_kind, turn_kind = (turns.schema[c].dataType.simpleString() for c in (conv, turn))
    slim = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv", "turn", "role", "text", "tie"]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.select("conv", "turn", "role", "text", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("pos"))
    rows = materialise(_sorted_runs(placed, _TURNS.format(conv=conv_kind, turn=turn_kind), prices), "chat-turns")
    solved = _solved(rows.filter("run IS NOT NULL").select("conv", "part", "run"), conv_kind, prices)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in T.StructType([rows.schema[c] for c in ("turn", "role", "text")])}
    borders = solved.withColumns(blank).withColumn("pos", F.lit(-1).cast("long"))
    marked = rows.drop("run").unionByName(borders, allowMissingColumns=True)
    together = marked.repartition("conv", "part").sortWithinPartitions("conv", "part", "pos")
    out = _repaired(together, conv_kind, turn_kind, prices)
    return out.withColumnsRenamed({"conv": conv, "turn": turn, "role": role})
