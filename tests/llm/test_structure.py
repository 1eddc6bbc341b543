"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tonelens.llm import queries, structure

ROWS = "conv_id long, turn long, role string, text string"


def _faults(turns):
    """(initial, fault) of each turn; the first fault counts."""
    seen, found = set(), []
    for _, role, text in turns:
        letters = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role[:1], fault))
    return found


def _cheapest(faults):
    """The least (cost, edits): a best-first search over (turns taken, initials' state)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, closed = [(0, "", 0, "")], set()
    while heap:
        cost, edits, at, state = heapq.heappop(heap)
        if at == len(faults) and state in ("", "a"):
            return cost, edits
        if (at, state) in closed:
            continue
        closed.add((at, state))
        for initial in "ua":
            if (state, initial) in after:
                heapq.heappush(heap, (cost + 5, edits + "I", at, after[state, initial]))
        if at < len(faults):
            initial, fault = faults[at]
            heapq.heappush(heap, (cost + 2, edits + "D", at + 1, state))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (state, initial) in after:
                    heapq.heappush(heap, (cost + more, edits + "K", at + 1, after[state, initial]))
                for new in "ua":
                    if (state, new) in after:
                        heapq.heappush(heap, (cost + more + 1, edits + "R", at + 1, after[state, new]))
    raise AssertionError


def _applied(turns, edits):
    out, rows, state = [], iter(turns), ""
    for edit in edits:
        new = "assistant" if state == "u" else "user"
        if edit == "I":
            out.append((new, ""))
        else:
            _, role, text = next(rows)
            if edit == "D":
                continue
            out.append((role, text) if edit == "K" else (new, text))
        state = out[-1][0][0]
    return out


def _report(turns):
    """Row of the contract for the turns of one conversation after damage, in order."""
    faults = _faults(turns)
    cost, edits = _cheapest(faults)
    numbers = {t for t, _, _ in turns if t is not None}
    kinds = [f for _, f in faults]
    lines = "\n".join(f"{r}:{t}" for r, t in _applied(turns, edits))
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(faults, faults[1:], strict=False)), cost, edits, hashlib.sha256(lines.encode()).hexdigest(),
    )


def _random_turns(rng, n):
    roles, texts = ["system", "user", "assistant", "bot"], ["Yes.", "no", "", "What? ", " \n"]
    return [(i, rng.choices(roles, [1, 4, 4, 1])[0], rng.choice([*texts, f"turn {i}.", f"and {i}"])) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_edits_are_the_cheapest(spark, monkeypatch, partitions):
    rng = random.Random(5)
    chats = {c: _random_turns(rng, rng.choice([1, 2, 3, 5, 9, 40])) for c in range(60)}
    rows = [(c, *t) for c, turns in chats.items() for t in turns]
    table = spark.createDataFrame(rows, ROWS)
    monkeypatch.setattr(structure, "ROUNDS", 3)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        audits = structure.audit(table).cache()
        repaired = structure.repair(table, audits).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {r["conv_id"]: tuple(r)[1:] for r in audits.collect()}
    lines = defaultdict(list)
    for r in repaired:
        if r["role"] is not None:
            lines[r["conv_id"]].append((r["role"], r["text"]))
    for c, turns in chats.items():
        want = _report(turns)
        assert got[c] == want[:-1]
        assert lines[c] == _applied(turns, want[-2])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines[c]))


def test_query_is_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    chats, every = defaultdict(list), set()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        every.add(r["conv_id"])
        fault = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role = "user" if fault == 4 else r["role"]
        text = "" if fault == 1 else re.sub("[.!?]", "", r["text"]) if fault == 2 else r["text"]
        chats[r["conv_id"]] += [(r["turn"], role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    want = {c: _report(sorted(chats[c], key=lambda t: t[0])) for c in every}
    assert {r["conv_id"]: tuple(r)[1:] for r in entry.queries()["op11_conversation_repair"](spark, sf).collect()} == want


def test_one_long_conversation_over_many_partitions(spark):
    turns = _random_turns(random.Random(9), 3000)
    table = spark.createDataFrame([(1, *t) for t in turns], ROWS).repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        assert tuple(structure.audit(table).first())[1:] == _report(turns)[:-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rules_keep_products():
    rng = np.random.default_rng(1)
    flat = np.concatenate([np.append(rng.choice(9, 30, p=[0.02, 0.3, 0.3, 0.02, 0.01, 0.1, 0.1, 0.05, 0.1]), -1) for _ in range(40)]).astype(np.int16)
    rules = [(1, 2), (9, 9), (2, 1), (8, 8)]
    grammar = structure.Grammar(rules, structure.Prices())
    plain = structure.Grammar([], structure.Prices())
    short = structure.compress(flat, rules)
    assert len(short) < len(flat) and (short == -1).sum() == 40
    for a, b in zip(np.split(flat, np.flatnonzero(flat == -1)), np.split(short, np.flatnonzero(short == -1)), strict=True):
        if len(a) > 1:
            spelt = [[e and (e[0], e[1].spell()) for e in g.matrix(x[x >= 0])] for g, x in ((plain, a), (grammar, b))]
            assert spelt[0] == spelt[1]


def test_odd_turns(spark):
    turns = [
        (1, None, None, None), (1, None, "user", "Hi."), (1, 2, "assistant", "\x0b"), (2, 1, "", "x."), (2, 2, "tool", "Y!"), (None, 1, "user", "A."),
        (None, 3, "assistant", "B"), (3, 0, "user", "Q?"), (3, 0, "user", "Q?"), (3, 0, "user", "Q?"), (3, 1, "assistant", "w " * 50_000 + "."),
    ]
    wide = spark.createDataFrame(turns, ROWS).withColumns({c: F.lit("x") for c in ("conv", "Digest", "n", "part", "audit", "edit", "first", "SYMBOLS")})
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in structure.audit(wide).collect()}
    assert got[1] in {(0, 2, 0, 0, 2, 6, "DDD"), (0, 2, 0, 0, 1, 6, "DDD")}
    assert got[2] == (0, 0, 0, 0, 1, 2, "RR")
    assert got[None] == (1, 0, 0, 1, 0, 4, "DD")
    assert got[3] == (0, 0, 2, 0, 2, 4, "KDDK")
    assert len(structure.repair(wide, structure.audit(wide)).filter("conv_id = 3 AND role IS NOT NULL").collect()) == 2
    assert structure.audit(wide.limit(0)).collect() == [] == structure.repair(wide.limit(0), structure.audit(wide.limit(0))).collect()
    table = spark.createDataFrame([(7, 0, None, None), (None, None, "user", None)], ROWS)
    assert queries.damaged(table).count() <= 4
