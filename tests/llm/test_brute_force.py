"""The operators against plain recomputation on small tables."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tonelens.llm import chat, decontaminate, packing, quality, recurrent_lm, setsketch, sharding, token_spans, toxicity
from tonelens.llm.components import components

SF = "/root/testdata/sf0.001"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


# -- packing ----------------------------------------------------------------------------------------------------

def test_packed_ids_are_those_of_whole_texts(spark, texts):
    odd = {-1: "<|ENDOFTEXT|> <|endoftext|>x don't I'LL 3.14 áb Σς ΟΔΟΣ", -2: "naïve… «café» x y\x1cz", -3: "word " * 9000, -4: "", -5: "it's... 'S 5th!"}
    rows = packing.pack(spark.createDataFrame([*texts.items(), *odd.items()], "doc_id long, text string").repartition(4), WORD_FILE).collect()
    tokenizer = Tokenizer.from_file(WORD_FILE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == {*texts, *odd}
    for doc, text in {**texts, **odd}.items():
        whole = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        own = sorted(pieces[doc], key=lambda r: r["start"])
        assert list(itertools.chain.from_iterable(r["ids"] for r in own)) == whole
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        assert {r["doc_tokens"] for r in own} == {len(whole)}
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        assert sum(r["length"] for r in own) <= 4096
    full = [sum(r["length"] for r in own) for own in sequences.values()]
    assert sum(4096 - n for n in full if n & (n - 1)) <= 0.04 * sum(full)


def test_classes_hold_a_fixed_number_of_pieces():
    packer = packing.Packer(4096, 0)
    for i in range(30):
        packer.add(i, np.zeros(1000, "<u4"))
    assert [len([p for p in packer.placed if p[4] == s]) for s in range(7)] == [4] * 7
    packer.finish()
    assert sum(len(p[2]) for p in packer.placed) == 30_000


# -- token counts -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("rule", token_spans.RULES)
def test_tokens_are_dealt_by_their_offsets(docs, texts, rule):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = defaultdict(dict)
    for r in token_spans.tokens_by_line(docs, BYTE_FILE, rule=rule).collect():
        found[r["doc_id"]][r["section"]] = r
    for doc, text in itertools.islice(texts.items(), 60):
        lines = text.splitlines(keepends=True) if "\r" not in text else None
        ends = list(itertools.accumulate(len(x.encode()) for x in text.split("\n")))
        ends = [e + i + 1 for i, e in enumerate(ends)]
        ends[-1] -= 1
        if text.endswith("\n"):
            ends.pop()
        want, at = [0.0] * len(ends), 0
        for token in tokenizer.encode(text, add_special_tokens=False).ids:
            length = len(_bytes_of(tokenizer, token))
            over = [max(0, min(at + length, e) - max(at, s)) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            hit = [i for i, o in enumerate(over) if o]
            if rule == "shares":
                for i in hit:
                    want[i] += over[i] / length
            else:
                want[{"first": hit[0], "last": hit[-1], "most": max(hit, key=lambda i: (over[i], -i))}[rule]] += 1
            at += length
        rows = [found[doc][i] for i in range(len(ends))]
        assert [r["n_tokens"] for r in rows] == pytest.approx(want)
        assert lines is None or [text[r["char_start"] : r["char_end"]] for r in rows] == lines or "\x0b" in text


def _bytes_of(tokenizer, token):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    return bytes(letters[c] for c in tokenizer.id_to_token(token))


def test_fields_are_encoded_together(spark):
    rows = spark.createDataFrame([(1, "Title here", None, "body text"), (2, "", "", "")], "doc_id long, a string, b string, c string")
    found = token_spans.tokens_by_field(rows, BYTE_FILE, ["a", "b", "c"], rule="first").collect()
    whole = len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("Title here\n\nbody text").ids)
    assert sum(r["n_tokens"] for r in found if r["doc_id"] == 1) == whole
    assert [(r["char_start"], r["char_end"]) for r in found if r["doc_id"] == 1] == [(0, 11), (11, 12), (12, 21)]


# -- near-duplicates --------------------------------------------------------------------------------------------

def _plain_components(texts):
    sets = {}
    for doc, text in texts.items():
        words = text.encode().lower().split()
        sets[doc] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in texts}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("part", [2048, 8])
def test_near_duplicates_are_those_of_all_pairs(spark, texts, monkeypatch, part):
    monkeypatch.setattr(setsketch, "PART", part)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    group = {}
    for i in range(60):  # copies, edited at random places, some of them only linked through others
        words = base[:]
        for _ in range(rng.choice([0, 1, 3, 5, 8, 12])):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        group[10**6 + i] = " ".join(words)
    short = {2 * 10**6 + i: t for i, t in enumerate(["a b c", "A  b\tc", "a b", "", "   ", "c b a"])}
    every = {**texts, **group, **short}
    rows = setsketch.near_duplicates(spark.createDataFrame([*every.items()], "doc_id long, text string").repartition(5)).collect()
    label, size = _plain_components(every)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in rows} == {d: (label[d], size[d], label[d] == d) for d in every}


def test_likely_similarity_is_close():
    rng = np.random.default_rng(5)
    errors = []
    for j in (0.3, 0.6, 0.75, 0.9):
        for _ in range(30):
            n = 400
            shared = int(round(2 * n * j / (1 + j)))
            x = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            a, b = setsketch.registers(x[:n]), setsketch.registers(x[n - shared :])
            got = setsketch.likely_similarity(np.array([(a > b).sum()]), np.array([(a < b).sum()]), setsketch.REGISTERS, np.array([float(n)]), np.array([float(n)]))
            errors.append(got[0] - shared / (2 * n - shared))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_registers_merge_by_maximum():
    x = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (setsketch.registers(x) == np.maximum(setsketch.registers(x[:400]), setsketch.registers(x[400:]))).all()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(150, 149), (150, 150)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 149: 149, 150: 149}


# -- shards -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shards", [1, 2, 8])
def test_shards_are_the_best_contiguous_ones(spark, texts, shards):
    extra = {10**6 + i: "same text " * 2000 for i in range(9)}
    every = {**texts, **extra}
    table = spark.createDataFrame([*every.items()], "doc_id long, text string").repartition(5)
    rows = sharding.assign_shards(table, shards).collect()
    by_hash = {r["doc_id"]: r["h"] for r in table.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    sizes = Counter()
    for doc, text in every.items():
        sizes[by_hash[doc]] += len(text.encode()) + 1
    ordered = [sizes[h] for h in sorted(sizes)]

    def needed(capacity):
        n, room = 1, capacity
        for s in ordered:
            if s > capacity:
                return 10**9
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    low, high = 0, sum(ordered)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    loads, slots, shard_of = Counter(), defaultdict(list), {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["text_crc32"] == zlib.crc32(every[r["doc_id"]].encode())
        assert shard_of.setdefault(by_hash[r["doc_id"]], r["shard"]) == r["shard"]
    assert max(loads.values()) == low
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [s for _, s in sorted(shard_of.items())] == sorted(shard_of.values())


@pytest.mark.parametrize("hot", [0.0, 0.34, 0.6])
def test_a_hot_text_does_not_bring_the_groups_to_the_driver(spark, monkeypatch, hot):
    groups = 100_000
    table = spark.range(groups).select(F.xxhash64("id").alias("_h"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)) + 1).alias("_size"))
    sizes = {r["_h"]: r["_size"] for r in table.collect()}
    if hot:
        middle, each = sorted(sizes)[groups // 3] + 1, int(sum(sizes.values()) * hot / (1 - hot)) // 1000
        table = table.union(spark.range(1000).select(F.lit(middle).alias("_h"), F.lit(each).alias("_size")))
        sizes[middle] = each * 1000
    collected, collect = [], sharding.collect_bounded
    monkeypatch.setattr(sharding, "collect_bounded", lambda *a: collected.append(rows := collect(*a)) or rows)
    cuts, capacity = sharding.minimax_cuts(table, 8)
    every = [sharding.Range(h, h, n) for h, n in sorted(sizes.items())]
    assert capacity == sharding.least_capacity(every, 8, divisible=False)
    loads = Counter()
    for r in every:
        loads[sum(r.low >= c for c in cuts)] += r.size
    assert max(loads.values()) == capacity and len(cuts) < 8
    assert sum(map(len, collected)) < 0.2 * groups and len(collected) < 12


def test_written_shards_are_the_assigned_ones(spark, docs, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/shards", 3)
    written = {(r["doc_id"], r["shard"]) for r in spark.read.parquet(f"{tmp_path}/shards").collect()}
    assert written == {(r["doc_id"], r["shard"]) for r in sharding.assign_shards(docs, 3).collect()}


def test_search_over_ranges_refines_to_groups():
    rng = random.Random(2)
    for _ in range(200):
        groups = [sharding.Range(i, i, rng.choice([1, 5, 50])) for i in range(rng.randrange(1, 30))]
        shards = rng.randrange(1, 6)
        exact = sharding.least_capacity(groups, shards, divisible=False)
        coarse = [sharding.Range(g[0].low, g[-1].high, sum(r.size for r in g)) for g in (groups[i : i + 4] for i in range(0, len(groups), 4))]
        assert sharding.least_capacity(coarse, shards, divisible=True) <= exact <= sharding.least_capacity(coarse, shards, divisible=False)


# -- chats ------------------------------------------------------------------------------------------------------

def _cheapest(roles, prices):
    costs = {chat.NONE: 0}
    for role in roles:
        after = {}
        for (a, b), move in chat.moves(role, prices).items():
            if a in costs:
                after[b] = min(after.get(b, 10**9), costs[a] + move.cost)
        costs = after
    return min(c + chat.ending(s, prices).cost for s, c in costs.items())


def _every_way(roles, prices, state=chat.NONE):
    """Least cost by trying every target, merge and number of inserted turns."""
    if not roles:
        best = 10**9
        for k in range(4):
            for path in itertools.product((1, 2, 3), repeat=k):
                legal = all(b in chat.FOLLOWS[a] for a, b in zip((state, *path), path, strict=False))
                if legal and ((*path,) or (state,))[-1] in (chat.NONE, chat.ASSISTANT):
                    best = min(best, prices.insert * k)
        return best
    best = 10**9
    for target in (1, 2, 3):
        price = 0 if target == roles[0] else prices.relabel
        if target == state:
            best = min(best, price + prices.merge + _every_way(roles[1:], prices, target))
        for k in range(3):
            for path in itertools.product((1, 2, 3), repeat=k):
                steps = (*path, target)
                if all(b in chat.FOLLOWS[a] for a, b in zip((state, *steps), steps, strict=False)):
                    best = min(best, price + prices.insert * k + _every_way(roles[1:], prices, target))
    return best


def test_repairs_cost_least_and_do_not_depend_on_cuts(spark):
    rng = random.Random(4)
    prices = chat.Prices()
    convs = {c: [rng.choice([*chat.ROLES, "tool"]) for _ in range(rng.choice([1, 2, 3, 4, 40]))] for c in range(40)}
    for roles in convs.values():
        if len(roles) <= 4:
            codes = [chat._code(r) for r in roles]
            assert _cheapest(codes, prices) == _every_way(codes, prices)
    table = spark.createDataFrame([(c, i, r, f"t{i}") for c, rs in convs.items() for i, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = defaultdict(list)
        for r in chat.format_chats(table.repartition(3)).collect():
            rows[r["conv_id"]].append(r)
        for c, roles in convs.items():
            own = sorted(rows[c], key=lambda r: r["position"])
            assert [r["turn"] for r in own] == list(range(len(roles))) == [r["position"] for r in own]
            cost, state = 0, chat.NONE
            for r in own:
                new = chat.ROLES.index(r["new_role"]) + 1
                cost += prices.relabel * ("relabel" in r["action"]) + prices.insert * (len(r["inserted"]) + len(r["added"]))
                if "merge" in r["action"]:
                    assert new == state
                    cost += prices.merge
                else:
                    for role in [*(chat.ROLES.index(x) + 1 for x in r["inserted"]), new]:
                        assert role in chat.FOLLOWS[state]
                        state = role
            assert {r["conv_cost"] for r in own} == {cost} and cost == _cheapest([chat._code(r) for r in roles], prices)
            text = "".join(r["fragment"] for r in own)
            assert text.count("<|im_start|>") == text.count("<|im_end|>") and text.endswith("<|im_end|>\n")
    spark.conf.set("spark.sql.shuffle.partitions", 4)


# -- language model ---------------------------------------------------------------------------------------------

def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    vocabulary = recurrent_lm.Vocabulary({}, [], np.log(rng.dirichlet(np.ones(recurrent_lm.OUTPUTS))))
    p = {k: v.astype(np.float64) for k, v in recurrent_lm.initial(vocabulary).items()}
    place = recurrent_lm.classes_of(vocabulary.log_share)
    ins, targets = rng.integers(1, 1000, (4, 3)), rng.integers(0, 1000, (4, 3))
    ins[2, 1] = 0
    h = rng.standard_normal((3, recurrent_lm.HIDDEN))

    def loss():
        state, total, projected = h, 0.0, p["embed"] @ p["w"] + p["b"]
        for t in range(4):
            state = np.where((ins[t] == 0)[:, None], 0, state)
            state, _ = recurrent_lm.advance(projected[ins[t]], state, p)
            total -= recurrent_lm.log_likelihood(state, place[targets[t]], p).sum()
        return total / targets.size

    g, _ = recurrent_lm._gradients(ins, place[targets], ins == 0, h, p)
    for name in p:
        spots = np.argsort(-np.abs(g[name]).ravel())[:4]
        for i in spots:
            old = p[name].flat[i]
            p[name].flat[i] = old + 1e-4
            up = loss()
            p[name].flat[i] = old - 1e-4
            down = loss()
            p[name].flat[i] = old
            assert (up - down) / 2e-4 == pytest.approx(g[name].flat[i], rel=2e-2, abs=2e-4)


def test_scores_of_documents(spark, docs, texts):
    found = {r["doc_id"]: r for r in entry.queries()["op6_lm_scoring"](spark, SF).collect()}
    tokens = {d: [*t.encode().lower().split(), b""] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = found[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base)
    unseen = [d for d in texts if held[d]]
    assert sum(found[d]["score"] for d in unseen) > sum(found[d]["base_score"] for d in unseen)


def test_state_is_carried_over_windows(monkeypatch):
    rng = np.random.default_rng(0)
    vocabulary = recurrent_lm.Vocabulary({}, [], np.log(rng.dirichlet(np.ones(recurrent_lm.OUTPUTS))))
    p, place = recurrent_lm.initial(vocabulary), recurrent_lm.classes_of(vocabulary.log_share)
    lengths = np.array([5, 700, 1, 260])
    symbols = rng.integers(0, 1000, lengths.sum())
    whole = recurrent_lm.sequence_scores(symbols, lengths, p, place)
    monkeypatch.setattr(recurrent_lm, "WINDOW", 10_000)
    assert recurrent_lm.sequence_scores(symbols, lengths, p, place) == pytest.approx(whole, rel=1e-5)
    alone = recurrent_lm.sequence_scores(symbols[5:705], np.array([700]), p, place)
    assert alone[0] == pytest.approx(whole[1], rel=1e-5)


def test_rare_words_meet_their_counts(spark, docs, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "HEAD", 50)
    few = recurrent_lm.score(docs, *recurrent_lm.fit(docs)).collect()
    monkeypatch.setattr(recurrent_lm, "HEAD", 300_000)
    many = {r["doc_id"]: r for r in recurrent_lm.score(docs, *recurrent_lm.fit(docs)).collect()}
    assert all(r["base_score"] == pytest.approx(many[r["doc_id"]]["base_score"]) and r["n_known"] == r["n_tokens"] for r in few)


def test_network_learns_from_all_tokens_however_the_table_is_cut(spark, docs, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(recurrent_lm, "PIECE_TOKENS", 500)
    long = spark.createDataFrame([(10**6, "aa bb " * 3000), (10**6, "aa bb " * 3000), (None, None)], "doc_id long, text string")
    every = docs.union(long)
    counts = recurrent_lm.count_tokens(every)
    vocabulary = recurrent_lm.build_vocabulary(counts, recurrent_lm.most_frequent(counts, 1000))
    words = Counter(w for r in every.collect() for w in recurrent_lm.tokens_of((r["text"] or "").encode()))
    n = sum(words.values())
    shards = {r["part"]: r for r in recurrent_lm._shards(every.coalesce(1), vocabulary, n, "doc_id", "text").collect()}
    symbols = Counter(s for r in shards.values() for s in r["symbols"])
    assert symbols == sum((Counter({vocabulary.symbol(w): c}) for w, c in words.items()), Counter())
    assert len(shards) == -(-n // 3000) and max(len(r["symbols"]) for r in shards.values()) < 3 * 3000
    assert all(sum(r["sizes"]) == len(r["symbols"]) and max(r["sizes"]) <= 500 for r in shards.values())
    # rows with one key and text are dealt by task, all others by what they hold
    cut = docs.repartition(7)
    one, other = ({r["part"]: r["symbols"] for r in recurrent_lm._shards(d, vocabulary, n, "doc_id", "text").collect()} for d in (docs.coalesce(1), cut))
    assert one == other


@pytest.mark.parametrize("n", [1, 79, 1000, 6011])
def test_a_pass_takes_every_token_once(monkeypatch, n):
    rng = np.random.default_rng(0)
    vocabulary = recurrent_lm.Vocabulary({}, [], np.log(rng.dirichlet(np.ones(recurrent_lm.OUTPUTS))))
    place, taken, gradients = recurrent_lm.classes_of(vocabulary.log_share), [], recurrent_lm._gradients
    symbols = rng.integers(0, 1000, n).astype(np.int32)
    monkeypatch.setattr(recurrent_lm, "STRETCHES", 10)
    monkeypatch.setattr(recurrent_lm, "_gradients", lambda ins, targets, *rest: taken.extend(targets.ravel()) or gradients(ins, targets, *rest))
    recurrent_lm.train_shard(symbols, recurrent_lm.flat(recurrent_lm.initial(vocabulary)), place)
    assert sorted(taken) == sorted(place[symbols])


def test_head_is_full_and_holds_the_end(spark, monkeypatch):
    words = [f"w{i:03}".encode() for i in range(200)]
    rows = [(bytearray(w), 1) for w in words[2:]] + [(bytearray(w), 7) for w in words[:2]] + [(bytearray(b""), 1)]
    counts = spark.createDataFrame(rows, "word binary, c long").repartition(3)
    assert recurrent_lm.most_frequent(counts, 10) == {b"": 1, **{w: 7 if i < 2 else 1 for i, w in enumerate(words[:9])}}
    assert recurrent_lm.most_frequent(counts, 2) == {b"": 1, words[0]: 7}
    assert len(recurrent_lm.most_frequent(counts, 1000)) == 201
    monkeypatch.setattr(recurrent_lm, "HEAD", 10)
    docs = spark.createDataFrame([(1, " ".join(f"once{i}" for i in range(300)))], "doc_id long, text string")
    language, found = recurrent_lm.fit(docs)
    assert b"" in language.head
    row = recurrent_lm.score(docs, language, found).first()
    p, v = recurrent_lm.shaped(language.weights), language.vocabulary
    tokens = recurrent_lm.tokens_of(" ".join(f"once{i}" for i in range(300)).encode())
    symbols = np.array([v.symbol(t) for t in tokens])
    first = recurrent_lm.OUTPUTS - recurrent_lm.TAIL
    inside = sum(v.tail_unit[s - first] + np.log10(1.5) for s in symbols if s >= first)
    expected = recurrent_lm.sequence_scores(symbols, np.array([len(symbols)]), p, recurrent_lm.classes_of(v.log_share))[0] + inside
    assert row["score"] == pytest.approx(expected, rel=1e-6)


# -- toxicity ---------------------------------------------------------------------------------------------------

def test_marginals_are_those_of_all_taggings():
    rng = np.random.default_rng(0)
    emission, lengths, m = rng.standard_normal(9), np.array([4, 0, 5]), (-1.0, 0.5, 0.8)
    got, start = toxicity.marginals(emission, lengths, m), 0
    table = {(0, 0): 0.0, (0, 1): m[0], (1, 0): m[1], (1, 1): m[2]}
    for n in lengths:
        weights = np.zeros(n)
        total = 0.0
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e for e, t in zip(emission[start : start + n], tags, strict=True) if t) + sum(table[p] for p in itertools.pairwise(tags)))
            total += w
            weights += w * np.array(tags)
        assert got[start : start + n] == pytest.approx(weights / total)
        start += n


def test_toxic_words_are_learnt_and_found(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if i % 3 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "NASTY", "foul!"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 200], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    assert [found[i]["predicted"] for i in range(200, 300)] == [int(i % 3 == 0) for i in range(200, 300)]
    for i, text in rows:
        for s in found[i]["spans"]:
            assert {*text[s["start"] : s["stop"]].lower().replace("!", "").split()} <= {"vile", "nasty", "foul"}


def test_toxic_words_late_in_long_texts_are_learnt(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    text = {i: [rng.choice(words) for _ in range(3500 if i % 20 == 0 else 600)] for i in range(120)}
    for i in range(0, 120, 20):
        text[i] += [w for _ in range(40) for w in ("vile", rng.choice(words))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in text.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in text], "doc_id long, toxic int")
    assert all(len(" ".join(text[i][:3500])) > 20_000 for i in range(0, 120, 20))
    assert toxicity.fit(docs, labels).weights.get(b"vile", 0) > 0
    read, fit_field = [], toxicity._fit_field
    monkeypatch.setattr(toxicity, "FIT_BYTES", 80_000)
    monkeypatch.setattr(toxicity, "_fit_field", lambda texts, toxic: read.extend(texts) or fit_field(texts, toxic))
    toxicity.fit(docs, labels)
    assert {*map(tuple, read)} <= {*map(tuple, ([w.encode() for w in t] for t in text.values()))} and 0 < sum(len(t) > 3500 for t in read) < 6


# -- decontamination and quality --------------------------------------------------------------------------------

def test_blocks_of_items_give_one_result(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(str, decontaminate.find_items(docs, items).collect()))
    assert sorted(map(str, decontaminate.find_items(docs, items, block_bytes=3000).collect())) == whole


def test_order_of_rules_does_not_change_the_verdict(docs):
    names = set()
    for rules in itertools.islice(itertools.permutations(quality.RULES), 0, 720, 240):
        kept = docs.filter(quality.first_failure(rules, quality.lazily()).isNull())
        names.add(tuple(sorted(r["doc_id"] for r in kept.collect())))
    judged = quality.judged(docs).filter("kept").select("doc_id").collect()
    assert names == {tuple(sorted(r["doc_id"] for r in judged))}


def test_quality_runs_no_python(docs):
    for df in (quality.judged(docs), quality.keep_good(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_cascade_measures_no_more_than_it_needs(docs):
    """What the contract does not list is computed only inside the branches that ask for it."""
    upper, lower = quality.judged(docs)._jdf.queryExecution().optimizedPlan().toString().split("Project [")[1:]
    assert ", !, 0)" not in lower
    assert upper.count(", !, 0)") == 1 and "CASE WHEN" in upper.split(", !, 0)")[0]


# -- pipeline ---------------------------------------------------------------------------------------------------

def test_pipeline_is_its_stages_by_brute_force(spark, texts):
    rows = corpus_pipeline.run(spark, SF).collect()
    judged = {r["doc_id"] for r in quality.judged(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id").isin([*judged]))
    harmless = {r["doc_id"] for r in corpus_pipeline.harmless(spark, docs, SF).collect()}
    label, _ = _plain_components({d: texts[d] for d in harmless})
    kept = {d for d in harmless if label[d] == d}
    finder = decontaminate.Finder(tuple((str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), 13)
    clean = set()
    for d in kept:
        n, runs, _ = finder.find(texts[d].encode())
        hit = sum(b - a for a, b in runs)
        if not (hit and 20 * hit >= n):
            clean.add(d)
    tokenizer = Tokenizer.from_file(WORD_FILE)
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        found[r["doc_id"]] += r["ids"]
    assert found == {d: [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 2] for d in clean}


def test_chunk_ids_are_those_of_whole_texts():
    """Letters with and without marks, composed or not, digits, quotes, punctuation and odd white space in any order."""
    known = packing.ChunkIds(WORD_FILE)
    rng = random.Random(1)
    letters = "aZéÉßİıſŉŀ'.,*&<>≠́ 9²ªµ×÷_-\"sdtǅʼŁΩ \n"
    for _ in range(20_000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 12))).encode()
        assert known.of(text) == known.whole(text), text


def test_network_reads_thousands_of_documents_side_by_side(spark, monkeypatch):
    """Each step of a batch costs the same for few rows as for many, so a batch of short texts is one pass."""
    from types import SimpleNamespace

    import pyarrow as pa

    words = {b"": 10, b"a": 7, b"b": 5}
    vocabulary = recurrent_lm.Vocabulary({b"": 0, b"a": 1, b"b": 2}, [-1.0] * recurrent_lm.TAIL, np.log(np.full(recurrent_lm.OUTPUTS, 1 / recurrent_lm.OUTPUTS)))
    language = recurrent_lm.Language(vocabulary, words, recurrent_lm.flat(recurrent_lm.initial(vocabulary)), 22, 3)
    found, passes, real = [], [], recurrent_lm.sequence_scores
    slim = SimpleNamespace(mapInArrow=lambda run, schema: found.append(run))
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))
    key = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))
    docs = SimpleNamespace(select=lambda *c: slim, schema={"doc_id": key}, sparkSession=session)
    monkeypatch.setattr(recurrent_lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(recurrent_lm, "sequence_scores", lambda *a: passes.append(len(a[1])) or real(*a))
    monkeypatch.setattr(recurrent_lm, "materialise", lambda *a: (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        recurrent_lm.score(docs, language, None)
    texts = ["a b " * (i % 5) + ("rare" if i % 3 else "") for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["key", "text"])
    together = [r for out in found[0](iter([batch])) for r in out.to_pylist()]
    assert passes == [3000]
    for i in (0, 1, 4, 2999):
        (alone,) = [r for out in found[0](iter([batch.slice(i, 1)])) for r in out.to_pylist()]
        assert {**alone, "row": i, "score": 0} == {**together[i], "score": 0} and alone["score"] == pytest.approx(together[i]["score"], rel=1e-5)


def test_gates_are_runs_of_memory():
    vocabulary = recurrent_lm.Vocabulary({}, [], np.log(np.full(recurrent_lm.OUTPUTS, 1 / recurrent_lm.OUTPUTS)))
    p = recurrent_lm.initial(vocabulary)
    _, gates = recurrent_lm.advance(np.zeros((5, 3 * recurrent_lm.HIDDEN), np.float32), np.zeros((5, recurrent_lm.HIDDEN), np.float32), p)
    assert all(g.flags.c_contiguous for g in gates)
