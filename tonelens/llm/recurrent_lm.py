"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are runs of anything but white space, A to Z lower-cased, then one end token, written as the empty word.

Counts of every token of every training row come from one aggregation, each task adding up its own rows first.  The
model's output has ``OUTPUTS`` symbols: the end, the most frequent words, and ``TAIL`` symbols that share all other
words by a checksum of their last two bytes; inside such a symbol a word has its smoothed share of the counts, so rare
and unknown words have probabilities too.  Symbols are dealt to ``CLASSES`` classes by frequency: the softmax is over
classes, then over the symbols of one class.

A gated recurrent unit carries the state.  It is trained by backpropagation through ``STEPS`` tokens at a time, the state
going on from one stretch to the next and cleared at a document's end.  All training tokens are used: documents, in
pieces of at most ``PIECE_TOKENS``, are dealt by a hash to shards of about ``SHARD_TOKENS``, whose number follows the
count of tokens and not the layout of the table.  A round (one by default) trains a copy on every shard and averages them,
weighted by tokens, in one aggregation.

Scoring is narrow but for rare words.  Counts of the ``HEAD`` most frequent words, a bounded table, go to all tasks; a
word that is not among them leaves its task as (row, word, times) and meets its count in a join on the word.  State is
carried from window to window through each whole document, ``SIDE_BY_SIDE`` documents side by side, of whose words only the
symbols are held; a window is ``WINDOW`` tokens of all of them.

Defined results: a null or blank text is the end token alone; repeated rows are scored alike, each on its own; with no
training tokens every word is unknown and the model is untrained; an empty table gives an empty one; only the key and
text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tonelens.llm.common import Steps, lists, slices, utf8
from tonelens.plans.ranking import first_by
from tonelens.plans.sizing import collect_bounded
from tonelens.plans.workdir import materialise

OUTPUTS, CLASSES, TAIL = 1024, 32, 96
EMBED, HIDDEN = 16, 24
STEPS, STREAMS, ROUNDS, RATE = 20, 16, 1, 0.01
#: Stretches that a pass over a shard takes: more tokens are read side by side.
STRETCHES = 156
SHARD_TOKENS, PIECE_TOKENS = 1_600_000, 50_000
#: Most words whose counts are sent to every task.
HEAD = 300_000
#: Tokens of all documents side by side whose probabilities are taken at a time.
WINDOW = 8192
#: Documents that the network reads side by side; the fewer run at a step, the more each token costs.
SIDE_BY_SIDE = 4096
#: Entries of a task's counter before it hands them on, and words a task remembers.
COUNTER_ENTRIES = 400_000
END = b""


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


# -- counts -----------------------------------------------------------------------------------------------------

def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, c)`` over all rows; words as bytes, the end token as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[bytes] = Counter()

        def results() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["word", "c"])
            counter.clear()
            return batch

        for whole in batches:
            for batch in slices(whole, "text"):
                for t in utf8(batch, "text"):
                    counter.update(tokens_of(t))
                if len(counter) >= COUNTER_ENTRIES:
                    yield results()
        yield results()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The ``most`` words of the highest counts, the least words first among those of one count; the end always."""
    words = counts.filter(F.col("word") != F.lit(END))
    level = F.floor(F.log2("c") * 16)
    steps = sorted(((r["s"], r["n"]) for r in collect_bounded(words.groupBy(level.alias("s")).agg(F.count("*").alias("n")), 1100, "count levels")), reverse=True)
    most -= 1
    cut, total = None, 0
    for step, n in steps:
        if total + n > most:
            cut = step
            break
        total += n
    taken = words
    if cut is not None:
        # counts are whole numbers: a level of many counts is one of high counts, which few words reach
        exact = words.filter(level == cut).groupBy("c").agg(F.count("*").alias("n"))
        least = 0
        for r in exact.orderBy(F.desc("c")).toLocalIterator():
            least = r["c"]
            if total + r["n"] > most:
                break
            total += r["n"]
        taken = words.filter(F.col("c") > least).union(first_by(words.filter(F.col("c") == least), most - total, "word"))
    found = collect_bounded(taken.union(counts.filter(F.col("word") == F.lit(END))), most + 1, "frequent words")
    return {bytes(r["word"]): r["c"] for r in found}


def _tail(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


class Vocabulary(NamedTuple):
    """Symbols: frequent words first, by falling count, then the tail symbols."""

    symbols: dict[bytes, int]
    #: log10 of the share of a count unit among those of a tail symbol
    tail_unit: list[float]
    #: natural log of every symbol's share of all tokens
    log_share: np.ndarray

    def symbol(self, word: bytes) -> int:
        found = self.symbols.get(word)
        return OUTPUTS - TAIL + _tail(word) if found is None else found


class Symbols(dict):
    """Word -> symbol, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= COUNTER_ENTRIES:
            self.clear()
        self[word] = found = self.vocabulary.symbol(word)
        return found


def build_vocabulary(counts: DataFrame, head: dict[bytes, int]) -> Vocabulary:
    ranked = sorted(((-c, w) for w, c in head.items() if w != END))[: OUTPUTS - TAIL - 1]
    symbols = {END: 0, **{w: i + 1 for i, (_, w) in enumerate(ranked)}}
    mass = np.full(OUTPUTS, 0.5)
    for w, i in symbols.items():
        mass[i] += head.get(w, 0)
    chosen = F.col("word").isin([bytearray(w) for w in symbols])
    last_two = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    tails = counts.filter(~chosen).groupBy((F.crc32(last_two) % TAIL).alias("t")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect()
    for r in tails:
        mass[OUTPUTS - TAIL + r["t"]] += r["m"]
    # an unknown word has half a count, and is what the half added to each symbol stands for
    return Vocabulary(symbols, (-np.log10(mass[OUTPUTS - TAIL :])).tolist(), np.log(mass / mass.sum()))


# -- the network ------------------------------------------------------------------------------------------------

SIZE = OUTPUTS // CLASSES
_SHAPES = {
    "embed": (OUTPUTS, EMBED), "w": (EMBED, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
    "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ws": (CLASSES, HIDDEN, SIZE), "bs": (CLASSES, SIZE),
}


def classes_of(log_share: np.ndarray) -> np.ndarray:
    """Place (class * SIZE + slot) of each symbol: classes hold symbols of neighbouring frequency."""
    place = np.empty(OUTPUTS, np.int64)
    place[np.argsort(-log_share, kind="stable")] = np.arange(OUTPUTS)
    return place


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; output biases that give every symbol its share."""
    rng = np.random.default_rng(1)
    p = {k: (rng.standard_normal(s) / math.sqrt(s[-2] if len(s) > 1 else 1) * 0.5).astype(np.float32) for k, s in _SHAPES.items()}
    p["wc"] *= 0.1
    p["ws"] *= 0.1
    p["b"][:] = 0
    share = np.empty(OUTPUTS)
    share[classes_of(vocabulary.log_share)] = np.exp(vocabulary.log_share)
    share = share.reshape(CLASSES, SIZE)
    p["bc"] = np.log(share.sum(axis=1)).astype(np.float32)
    p["bs"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return p


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in _SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = math.prod(s)
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Overwrites its argument."""
    np.maximum(x, -30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def by_gate(x: np.ndarray) -> np.ndarray:
    """Reset, update and candidate, side by side in the last axis, as three arrays: each is one run of memory."""
    return np.stack(np.split(x, 3, axis=-1))


def advance(inputs: np.ndarray, h: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple]:
    """One step; ``inputs`` are embeddings times ``w`` plus ``b``.  Gates: reset, update, candidate."""
    return _advance(by_gate(inputs), h, by_gate(p["u"]))


def _advance(inputs: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step; ``inputs`` and ``u`` by gate."""
    from_state = np.matmul(h, u)
    gates, pulled = from_state[:2], from_state[2]
    gates += inputs[:2]
    r, z = _sigmoid(gates)
    c = r * pulled
    c += inputs[2]
    np.tanh(c, out=c)
    after = c - h
    after *= z
    after += h
    return after, (r, z, pulled, c)


def _exponentials(x: np.ndarray) -> np.ndarray:
    """Overwrites its argument, one distribution a column, with exponentials; returns their sums."""
    x -= x.max(axis=0)
    return np.exp(x, out=x).sum(axis=0)


def _logs(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of the ``at``-th symbol of each column; overwrites ``x``."""
    x -= x.max(axis=0)
    chosen = x[at, np.arange(x.shape[1])]
    return chosen - np.log(np.exp(x, out=x).sum(axis=0))


class Grouped(NamedTuple):
    """States in the order of their target's class, and what each class gives its symbols: (symbol, state)."""

    order: np.ndarray
    states: np.ndarray
    #: class, first and last row of its states
    spans: list[tuple[int, int, int]]
    scores: np.ndarray


def _grouped(states: np.ndarray, group: np.ndarray, p: dict[str, np.ndarray]) -> Grouped:
    order = np.argsort(group.astype(np.uint8), kind="stable")
    ends = np.searchsorted(group[order], np.arange(CLASSES + 1)).tolist()
    spans = [(k, s, e) for k, (s, e) in enumerate(zip(ends, ends[1:], strict=False)) if s < e]
    states = states[order]
    scores = np.empty((SIZE, len(states)), states.dtype)
    for k, s, e in spans:
        np.add(p["ws"][k].T @ states[s:e].T, p["bs"][k][:, None], out=scores[:, s:e])
    return Grouped(order, states, spans, scores)


def _class_scores(states: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    scores = p["wc"].T @ states.T
    scores += p["bc"][:, None]
    return scores


def log_likelihood(h: np.ndarray, place: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each symbol's place after state ``h``."""
    group, slot = place // SIZE, place % SIZE
    own = _grouped(h, group, p)
    out = _logs(_class_scores(h, p), group)
    out[own.order] += _logs(own.scores, slot[own.order])
    return out


def _gradients(inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, p: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean loss over one stretch (steps, streams), and the state after it.  ``fresh`` clears states."""
    steps, streams = inputs.shape
    before, after, kept = [], [], []
    u, projected = by_gate(p["u"]), by_gate(p["embed"] @ p["w"] + p["b"])
    for t in range(steps):
        h = h.copy()
        h[fresh[t]] = 0
        before.append(h)
        h, gates = _advance(projected.take(inputs[t], axis=1), h, u)
        after.append(h)
        kept.append(gates)
    states = np.concatenate(after)
    place = targets.ravel()
    group, slot = place // SIZE, place % SIZE
    g = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    rows = np.arange(len(place))
    error = _class_scores(states, p)
    error /= _exponentials(error)
    error[group, rows] -= 1
    g["wc"], g["bc"] = states.T @ error.T, error.sum(axis=1)
    d_states = error.T @ p["wc"].T
    own = _grouped(states, group, p)
    error = own.scores
    error /= _exponentials(error)
    error[slot[own.order], rows] -= 1
    d_own = np.empty_like(d_states)
    for k, s, e in own.spans:
        here = error[:, s:e]
        g["ws"][k], g["bs"][k] = own.states[s:e].T @ here.T, here.sum(axis=1)
        np.matmul(here.T, p["ws"][k].T, out=d_own[s:e])
    d_states[own.order] += d_own
    d_states = d_states.reshape(steps, streams, HIDDEN)
    d_h = np.zeros((streams, HIDDEN), np.float32)
    back = u.transpose(0, 2, 1).copy()
    # by gate; a candidate's input and what the reset gate let through to it differ by that gate
    d_inputs = np.empty((3, steps, streams, HIDDEN), np.float32)
    d_pulled = np.empty((steps, streams, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        d = d_states[t] + d_h
        r, z, pulled, c = kept[t]
        d_r, d_z, d_c = d_inputs[:, t]
        np.multiply(d, z, out=d_c)
        d_c *= 1 - c * c
        np.multiply(d, c - before[t], out=d_z)
        keep = 1 - z
        d_z *= z
        d_z *= keep
        pull = d_c * r
        d_pulled[t] = pull
        np.multiply(pull, pulled, out=d_r)
        d_r *= 1 - r
        d_h = d
        d_h *= keep
        d_h += d_r @ back[0]
        d_h += d_z @ back[1]
        d_h += pull @ back[2]
        d_h[fresh[t]] = 0
    d_inputs, d_pulled = d_inputs.reshape(3, -1, HIDDEN), d_pulled.reshape(-1, HIDDEN)
    held = np.concatenate(before).T
    g["u"] = np.concatenate([held @ d_inputs[0], held @ d_inputs[1], held @ d_pulled], axis=1)
    embedded = p["embed"][inputs.ravel()].T
    g["w"], g["b"] = np.concatenate([embedded @ d for d in d_inputs], axis=1), d_inputs.sum(axis=1).ravel()
    # rows of one symbol are added up by a sorted sum
    order = np.argsort(inputs.astype(np.int16), axis=None, kind="stable")
    symbols, first = np.unique(inputs.ravel()[order], return_index=True)
    d_embedded = sum(d @ w.T for d, w in zip(d_inputs, by_gate(p["w"]), strict=True))
    g["embed"][symbols] = np.add.reduceat(d_embedded[order], first, axis=0)
    return {k: v / len(place) for k, v in g.items()}, h


def train_shard(symbols: np.ndarray, params: np.ndarray, place: np.ndarray, heads: np.ndarray | None = None) -> np.ndarray:
    """Weights after one pass over all of a shard's tokens (Adam); 0 is the end token, pieces begin at ``heads``.

    Parallel streams follow the shard's length beyond ``STREAMS``, so that a pass takes about ``STRETCHES`` stretches.
    """
    streams = max(1, min(max(STREAMS, len(symbols) // (STRETCHES * STEPS)), len(symbols) // (4 * STEPS)))
    length, left = divmod(len(symbols), streams)
    starts = np.arange(streams) * length + np.minimum(np.arange(streams), left)
    previous = np.concatenate([np.zeros(1, symbols.dtype), symbols[:-1]])
    previous[starts[starts < len(symbols)]] = 0
    if heads is not None:
        previous[heads] = 0
    values = params.astype(np.float32)
    first, second = np.zeros_like(values), np.zeros_like(values)
    h = np.zeros((streams, HIDDEN), np.float32)
    # the first ``left`` streams are one token longer: a last stretch of one step
    stretches = [(t, min(t + STEPS, length), streams) for t in range(0, length, STEPS)] + [(length, length + 1, left)] * (left > 0)
    for n, (start, stop, running) in enumerate(stretches, start=1):
        p = shaped(values)
        at = np.arange(start, stop)[:, None] + starts[:running]
        ins = previous[at]
        g, h = _gradients(ins, place[symbols[at]], ins == 0, h[:running], p)
        g = flat(g)
        g *= min(1.0, 1.0 / (np.linalg.norm(g) + 1e-9))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        values = values - RATE * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.99**n)) + 1e-8)
    return values


def _pieces(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str) -> DataFrame:
    """``(h, copy, piece, symbols)``: all symbols of every row, long texts in pieces.

    ``h`` is a hash of key and text; ``copy`` tells rows of one task apart that have the same, so that they spread too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol_of, seen = Symbols(vocabulary), Counter()
        for whole in batches:
            for batch in slices(whole, "text"):
                names, found = [], []
                for h, t in zip(batch.column("h").to_pylist(), utf8(batch, "text"), strict=True):
                    words = tokens_of(t)
                    symbols = np.fromiter(map(symbol_of.__getitem__, words), np.int16, len(words))
                    for piece, start in enumerate(range(0, len(symbols), PIECE_TOKENS)):
                        names.append((h, seen[h], piece))
                        found.append(symbols[start : start + PIECE_TOKENS])
                    seen[h] += 1
                if len(seen) >= COUNTER_ENTRIES:
                    seen.clear()
                h, copy, piece = zip(*names, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(copy, pa.int64()), pa.array(piece, pa.int64()), lists(found, pa.int16())],
                    names=["h", "copy", "piece", "symbols"],
                )

    slim = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "h long, copy long, piece long, symbols array<smallint>")


def _shards(docs: DataFrame, vocabulary: Vocabulary, n: int, key: str, text: str) -> DataFrame:
    """``(part, symbols, sizes)``: the ``n`` training tokens as rows of about ``SHARD_TOKENS``, and the sizes of their pieces."""
    count = max(1, -(-n // SHARD_TOKENS))
    dealt = _pieces(docs, vocabulary, key, text).select(
        F.pmod(F.xxhash64("h", "copy", "piece"), F.lit(count)).alias("part"), F.struct("h", "copy", "piece", "symbols").alias("p")
    )
    held = dealt.repartition(count, "part").groupBy("part").agg(F.sort_array(F.collect_list("p")).alias("p"))
    symbols = F.transform("p", lambda p: p["symbols"])
    return held.select("part", F.flatten(symbols).alias("symbols"), F.transform(symbols, F.size).alias("sizes"))


def train(docs: DataFrame, vocabulary: Vocabulary, n: int, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Weights averaged over the copies trained on the shards of all ``n`` tokens, ``rounds`` times."""
    shards = materialise(_shards(docs, vocabulary, n, key, text), "lm-shards")
    place, params = classes_of(vocabulary.log_share), flat(initial(vocabulary))
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], start=params) -> Iterator[pa.RecordBatch]:
            total, weight = np.zeros(len(start)), 0
            for batch in batches:
                for symbols, sizes in zip(batch.column("symbols"), batch.column("sizes"), strict=True):
                    ids, sizes = symbols.values.to_numpy(), sizes.values.to_numpy()
                    total += len(ids) * train_shard(ids, start, place, np.cumsum(sizes) - sizes)
                    weight += len(ids)
            n = len(start) if weight else 0
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total[:n]), pa.array(np.full(n, weight))], names=["i", "v", "n"])

        means = shards.mapInArrow(run, "i long, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v"))
        rows = collect_bounded(means, len(params), "weights")
        if not rows:
            break
        params = np.empty(len(params), np.float32)
        for r in rows:
            params[r["i"]] = r["v"]
    return params


# -- scoring ----------------------------------------------------------------------------------------------------

def sequence_scores(symbols: np.ndarray, lengths: np.ndarray, params: dict[str, np.ndarray], place: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence's symbols, state carried from its first to its last."""
    steps = Steps(lengths)
    laid = steps.spread(symbols)
    u, projected = by_gate(params["u"]), by_gate(params["embed"] @ params["w"] + params["b"])
    totals = np.zeros(len(lengths))
    h = np.zeros((len(lengths), HIDDEN), np.float32)
    start = stop = 0
    while stop < len(steps):
        start, states = stop, []
        stop = max(start + 1, int(np.searchsorted(steps.starts, steps.starts[start] + WINDOW, side="right")) - 1)
        for t in range(start, stop):
            n = int(steps.running[t])
            here = steps.at(t)
            before = laid[here.start - int(steps.running[t - 1]) : here.start][:n] if t else np.zeros(n, laid.dtype)
            h, _ = _advance(projected.take(before, axis=1), h[:n], u)
            states.append(h)
        window = slice(steps.at(start).start, steps.at(stop - 1).stop)
        logs = log_likelihood(np.concatenate(states), place[laid[window]], params)
        rank = np.concatenate([np.arange(n) for n in steps.running[start:stop]])
        totals += np.bincount(rank, logs, len(lengths))
    out = np.empty(len(lengths))
    out[steps.order] = totals / math.log(10)
    return out


class Language(NamedTuple):
    vocabulary: Vocabulary
    head: dict[bytes, int]
    weights: np.ndarray
    n: int
    v: int


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[Language, DataFrame]:
    """The model of the training rows, and the counts of all their tokens."""
    counts = materialise(count_tokens(docs, text), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = most_frequent(counts, HEAD)
    vocabulary = build_vocabulary(counts, head)
    return Language(vocabulary, head, train(docs, vocabulary, n, key, text), n, v), counts


def score(docs: DataFrame, language: Language, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    # a word's place in two lists: of symbols, and of log10 of count plus a half, which only words of the head have
    words_known = {w: i for i, w in enumerate(language.head)}
    symbols_known = np.array([*map(language.vocabulary.symbol, language.head), *range(OUTPUTS - TAIL, OUTPUTS)], np.int16)
    logs_known = np.append(np.log10(np.fromiter(language.head.values(), float, len(language.head)) + 0.5), np.full(TAIL, math.nan))
    shared = spark.sparkContext.broadcast((language.vocabulary, language.weights, words_known, symbols_known, logs_known))
    least = math.log10(language.n + 0.5 * (language.v + 1))
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, known, symbol_at, log_at = shared.value
        params = shaped(weights)
        place = classes_of(vocabulary.log_share)
        part_id, done = TaskContext.get().partitionId() << 36, 0
        unit = np.zeros(OUTPUTS)
        unit[OUTPUTS - TAIL :] = vocabulary.tail_unit
        for whole in batches:
            for batch in slices(whole, "text", most_rows=SIDE_BY_SIDE):
                parts = []
                for part in slices(batch, "text", most_bytes=1 << 20):
                    words = [tokens_of(t) for t in utf8(part, "text")]
                    lengths = np.array([len(w) for w in words])
                    at = np.fromiter(map(known.get, chain.from_iterable(words), repeat(-1)), np.int64, lengths.sum())
                    row = np.repeat(np.arange(len(words)), lengths)
                    # words outside the head are left to the join
                    rare = at < 0
                    ends = np.cumsum(lengths)
                    owner, column = row[rare], np.flatnonzero(rare) - (ends - lengths)[row[rare]]
                    left = [words[i][j] for i, j in zip(owner.tolist(), column.tolist(), strict=True)]
                    at[rare] = [len(known) + _tail(w) for w in left]
                    symbols, head_logs = symbol_at[at], np.where(rare, 0.0, log_at[at])
                    inside = np.bincount(row, np.where(symbols >= OUTPUTS - TAIL, unit[symbols] + head_logs, 0), len(words))
                    base = np.bincount(row, head_logs, len(words)) - lengths * least
                    stops = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
                    tails = [Counter(left[s:e]) for s, e in zip([0, *stops], stops, strict=False)]
                    pairs = pa.StructArray.from_arrays(
                        [pa.array(chain.from_iterable(tails), pa.binary()), pa.array(chain.from_iterable(t.values() for t in tails), pa.int64())], fields=list(tail_type.value_type)
                    )
                    offsets = pa.array(np.cumsum([0, *map(len, tails)]), pa.int32())
                    seen = np.bincount(row, ~rare, len(words)).astype(np.int64)
                    parts.append((lengths, symbols, inside, seen, base, pa.ListArray.from_arrays(offsets, pairs, type=tail_type)))
                *numbers, rare = zip(*parts, strict=True)
                lengths, symbols, inside, seen, base = map(np.concatenate, numbers)
                scores = sequence_scores(symbols, lengths, params, place) + inside
                ids = part_id + done + np.arange(len(lengths))
                done += len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(ids), pa.array(lengths), pa.array(seen), pa.array(base), pa.array(scores), pa.concat_arrays(rare)],
                    names=["key", "row", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    schema = f"key {kind}, row long, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,times:long>>"
    rows = materialise(slim.mapInArrow(run, schema), "lm-rows")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    met = rare.join(counts, "word", "left")
    seen: Column = F.coalesce("c", F.lit(0))
    added = met.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.log10(seen + 0.5)).alias("_log"),
    )
    out = rows.drop("rare").join(added, "row", "left")
    log = F.coalesce("_log", F.lit(0.0))
    return out.select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(language.n).cast("long").alias("train_tokens"), (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"),
    )
