"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of ASCII letters, digits and anything outside ASCII, A to Z lower-cased.  The chain has two states,
clean and toxic.  A token's features are its word and its prefixes of 4 and 5 bytes; a feature has one weight, and pairs
of neighbouring states have one each.

``fit`` reads at most ``FIT_ROWS`` labelled rows of each class, whole texts in the order of a hash of their keys, as
many as fit into ``FIT_BYTES`` for each class; no text is cut.  Labels are of documents; tokens get theirs from them: a token of a toxic document is toxic if one of its features is found in significantly more
settings of toxic documents than of clean ones.  The field's log-likelihood is climbed by gradients from
forward-backward passes over windows of ``FIT_WINDOW`` tokens.

``score`` is narrow: each whole text, one forward and one backward pass over its tokens, many texts side by side.  The
sum of the squared marginals, toxic tokens weighted by their certainty, gives the document's score by a logistic curve
fitted to the same sample and corrected for the share of toxic rows among all labels.  Squares keep the many faint
marginals of a long clean text from adding up.

Defined results: null, empty and wordless texts have no tokens and the least score; without a toxic or without a clean
example the score of every text is the share of toxic labels, 0 if there are none; null labels are not learnt from, of
several labels of one row the greatest counts; repeated rows are scored alike; columns of ``docs`` stay, but for those
named ``score``, ``predicted`` and ``spans`` in any case of letters; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tonelens.llm.common import Steps, set_aside, slices, utf8
from tonelens.llm.decontaminate import NORMAL, WORD, words_of
from tonelens.plans.sizing import collect_bounded

FIT_ROWS = 2000
FIT_BYTES = 8_000_000
FIT_WINDOW = 96
FIT_STEPS = 60
#: Least log-likelihood ratio and ratio of shares for a feature that marks toxic tokens.
SIGNIFICANT, RATIO = 20.0, 8.0
#: Settings that a feature must be found in; rarer ones are left to the bias, so that it fits unseen words.
LEAST_SETTINGS = 3
#: Weights below this are dropped after the fit.
LEAST_WEIGHT = 0.02
THRESHOLD = 0.3
#: Marginal from which a token belongs to a span.
SPAN = 0.5
#: Words that a task remembers, and bytes of text that it takes side by side: its worker's memory follows both.
CACHE_ENTRIES = 200_000
SLICE_BYTES = 2 << 20
RESULTS = ("score", "predicted", "spans")


def features(word: bytes) -> set[bytes]:
    return {word, *(b"^" + word[:n] for n in (4, 5) if len(word) > n)}


class Model(NamedTuple):
    """Feature weights, state scores, and the curve from weighted toxic tokens to a score."""

    weights: dict[bytes, float]
    bias: float
    moves: tuple[float, float, float]  # clean to toxic, toxic to clean, toxic to toxic; clean to clean is 0
    curve: tuple[float, float]
    share: float | None  # the constant score, where nothing could be learnt


class Emissions(dict):
    """Word -> its score for the toxic state, remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = found = self.model.bias + sum(self.model.weights.get(f, 0.0) for f in features(word))
        return found


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: Iterable[float]) -> np.ndarray:
    """Probability of the toxic state for every token, sequence after sequence.

    With two states it is enough to carry the odds of toxic against clean in each direction.
    """
    if not len(emission):
        return np.zeros(0)
    ct, tc, tt = np.exp(np.array(list(moves)))
    steps = Steps(lengths)
    e = steps.spread(emission)
    np.exp(np.clip(e, -30, 30, out=e), out=e)
    forward, backward = np.empty_like(e), np.ones_like(e)
    odds = None
    for t in range(len(steps)):
        here = steps.at(t)
        n = here.stop - here.start
        odds = e[here] if odds is None else e[here] * (ct + odds[:n] * tt) / (1 + odds[:n] * tc)
        forward[here] = odds
    for t in range(len(steps) - 2, -1, -1):
        here, later = steps.at(t), steps.at(t + 1)
        n = later.stop - later.start
        ahead = e[later] * backward[later]
        backward[here.start : here.start + n] = (tc + ahead * tt) / (1 + ahead * ct)
    del e
    forward *= backward
    np.divide(forward, 1 + forward, out=forward)
    return forward[steps.place]


def _marks(words: np.ndarray, toxic: np.ndarray, of_word: np.ndarray, of_feature: np.ndarray, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which features mark tokens of toxic texts as toxic, and in how many settings each feature is found.

    A setting is a word between its two neighbours; equal settings, as copies of a text have them, count once.
    """
    around = np.concatenate([[-1], words, [-1]]).astype(np.uint64)
    setting = ((around[:-2] * np.uint64(0x9E3779B97F4A7C15) + around[1:-1]) * np.uint64(0xBF58476D1CE4E5B9)) + around[2:]
    counts, totals = [], []
    for label in (0, 1):
        own = np.flatnonzero(toxic == label)
        own = own[np.unique(setting[own], return_index=True)[1]]
        per_word = np.bincount(words[own], minlength=size[0])
        counts.append(np.bincount(of_feature, per_word[of_word], size[1]))
        totals.append(max(len(own), 1))
    c, t = counts
    expected = [(c + t) * n / sum(totals) for n in totals]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(t > 0, t * np.log(t / expected[1]), 0) + np.where(c > 0, c * np.log(c / expected[0]), 0))
    return (ratio >= SIGNIFICANT) & (t / totals[1] >= RATIO * (c + 0.5) / totals[0]), c + t


class Coded:
    """Texts as numbers of their words, end to end; numbers go by the words' order."""

    def __init__(self, texts: Iterable[bytes]):
        known: dict[bytes, int] = {}
        parts = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), np.int32) for t in texts]
        self.vocabulary = sorted(known)
        number = np.empty(len(known), np.int32)
        number[[known[w] for w in self.vocabulary]] = np.arange(len(known), dtype=np.int32)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.words = number[np.concatenate(parts)] if len(known) else np.zeros(0, np.int32)

    def __iter__(self) -> Iterator[list[bytes]]:
        for part in np.split(self.words, np.cumsum(self.lengths)[:-1]):
            yield [self.vocabulary[i] for i in part]

    def windows(self, most: int) -> np.ndarray:
        """Lengths of the windows that the texts are cut into."""
        whole, rest = np.divmod(self.lengths, most)
        sizes = np.full((whole + (rest > 0)).sum(), most)
        last = np.cumsum(whole + (rest > 0))[rest > 0] - 1
        sizes[last] = rest[rest > 0]
        return sizes


def _fit_field(texts: Coded, toxic: np.ndarray) -> tuple[dict[bytes, float], float, tuple[float, float, float]]:
    """Weights by gradient ascent with steps that adapt to each weight (Adam), and a small ridge."""
    vocabulary, words, lengths = texts.vocabulary, texts.words, texts.windows(FIT_WINDOW)
    every: dict[bytes, int] = {}
    of_word, of_feature = np.array([(i, every.setdefault(f, len(every))) for i, w in enumerate(vocabulary) for f in sorted(features(w))]).T
    in_toxic = np.repeat(toxic, texts.lengths)
    marks, settings = _marks(words, in_toxic, of_word, of_feature, (len(vocabulary), len(every)))
    marked = np.bincount(of_word, marks[of_feature], len(vocabulary)) > 0
    kept = settings >= LEAST_SETTINGS
    renumbered = np.cumsum(kept) - 1
    names = {f: int(renumbered[i]) for f, i in every.items() if kept[i]}
    of_word, of_feature = of_word[kept[of_feature]], renumbered[of_feature[kept[of_feature]]]
    truth = marked[words] & (in_toxic == 1)
    follows = np.ones(len(words), bool)
    follows[np.cumsum(lengths) - lengths] = False
    here, before = np.flatnonzero(follows), np.flatnonzero(follows) - 1
    moved = np.array([(~truth[before] & truth[here]).sum(), (truth[before] & ~truth[here]).sum(), (truth[before] & truth[here]).sum()])

    params = np.concatenate([np.zeros(len(names)), [-2.0, -1.0, 0.0, 0.0]])
    first, second = np.zeros_like(params), np.zeros_like(params)
    n_words, n_features = len(vocabulary), len(names)
    for step in range(1, FIT_STEPS + 1):
        w, bias, moves = params[:n_features], params[n_features], params[n_features + 1 :]
        emission = (np.bincount(of_word, w[of_feature], n_words) + bias)[words]
        p = marginals(emission, lengths, moves)
        slope = truth - p
        # chance of each pair of states, from the marginals of its two tokens and the odds ratio of the moves
        joint = _pairs(p[before], p[here], np.exp(moves))
        gradient = np.concatenate([
            np.bincount(of_feature, np.bincount(words, slope, n_words)[of_word], n_features) - 0.05 * w, [slope.sum()],
            moved - joint - 0.5 * moves,
        ])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        params = params + 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(params[i]) for f, i in names.items() if abs(params[i]) >= LEAST_WEIGHT}
    return weights, float(params[n_features]), tuple(map(float, params[n_features + 1 :]))


def _pairs(p: np.ndarray, q: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected numbers of moves clean-toxic, toxic-clean, toxic-toxic between neighbours with marginals p and q.

    In a chain a pair's table has the marginals of its tokens and the odds ratio of the move scores, which fixes it.
    """
    ratio = moves[2] / (moves[0] * moves[1])
    if abs(ratio - 1) < 1e-9:
        both = p * q
    else:
        s = 1 + (p + q) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * p * q, 0))) / (2 * (ratio - 1))
    return np.array([(q - both).sum(), (p - both).sum(), both.sum()])


def weight(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Toxic tokens of each text, weighted by their certainty."""
    return np.bincount(np.repeat(np.arange(len(lengths)), lengths), p * p, len(lengths))


def _fit_curve(weights: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic curve over the log of the weighted toxic tokens, by Newton steps with a ridge; the sample's class
    balance is replaced by ``share``."""
    x = np.stack([np.ones(len(weights)), np.log(weights + 1e-3)], axis=1)
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        gradient = x.T @ (toxic - p) - 0.5 * b
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        b = b + np.linalg.solve(hessian, gradient)
    ours = toxic.mean()
    if b[1] < 0:  # a sample too small to tell: more toxic tokens never lower a score
        b = np.array([np.log(ours / (1 - ours)), 0.0])
    return float(b[0] - np.log(ours / (1 - ours)) + np.log(share / (1 - share))), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fits to the labelled rows; which of them are in the sample depends on a hash of their key alone."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in known.filter("y IN (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model({}, 0.0, (0.0, 0.0, 0.0), (0.0, 0.0), counts.get(1, 0) / total if total else 0.0)
    wanted = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(rows)
        wanted = part if wanted is None else wanted.union(part)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).alias("n")
    sized = docs.select(F.col(key).alias("k"), size).join(F.broadcast(wanted), "k").groupBy("k", "y").agg(F.sum("n").alias("n"))
    room, keys = {0: FIT_BYTES, 1: FIT_BYTES}, []
    for r in sorted(collect_bounded(sized.withColumn("h", F.xxhash64("k")), 2 * rows, "labelled rows"), key=lambda r: (r["h"], r["k"])):
        if r["n"] <= room[r["y"]]:
            room[r["y"]] -= r["n"]
            keys.append((r["k"], r["y"]))
    taken = docs.sparkSession.createDataFrame(keys, wanted.schema)
    chosen = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).join(F.broadcast(taken), "k")
    # at most 2 * FIT_BYTES of text, as one table; of words only their numbers and distinct ones are held
    sample = chosen.orderBy("k", "y", "t").toArrow()
    toxic = sample.column("y").to_numpy()
    texts = Coded((t.as_py() or b"").translate(NORMAL) for t in sample.column("t"))
    del sample
    if len(set(toxic.tolist())) < 2 or not len(texts.words):
        return Model({}, 0.0, (0.0, 0.0, 0.0), (0.0, 0.0), counts[1] / total)
    weights, bias, moves = _fit_field(texts, toxic)
    model = Model(weights, bias, moves, (0.0, 0.0), None)
    of = Emissions(model)
    p = marginals(np.array([of[w] for w in texts.vocabulary])[texts.words], texts.lengths, moves)
    return model._replace(curve=_fit_curve(weight(p, texts.lengths), toxic, counts[1] / total))


def spans_of(text: bytes, p: np.ndarray) -> list[dict]:
    """Runs of toxic tokens as character offsets, with their greatest marginal."""
    hot = np.flatnonzero(p >= SPAN)
    if not len(hot):
        return []
    places = [m.span() for m in re.finditer(WORD, text)]
    runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
    at = lambda byte: len(text[:byte].decode())
    return [{"start": at(places[r[0]][0]), "stop": at(places[r[-1]][1]), "p": float(p[r].max())} for r in runs]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``spans`` (character offsets ``start, stop`` and marginal ``p``)."""
    names = [c for c in docs.columns if c.lower() not in RESULTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Emissions(model)
        for whole in batches:
            for batch in slices(whole, text, most_bytes=SLICE_BYTES):
                texts = utf8(batch, text)
                # the words of one text at a time; of the others only their scores are held
                emissions = [np.fromiter(map(of.__getitem__, words_of(t)), float) for t in texts]
                lengths = np.array([len(e) for e in emissions])
                p = marginals(np.concatenate(emissions), lengths, model.moves)
                del emissions
                ends = np.cumsum(lengths)
                if model.share is None:
                    scores = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log(weight(p, lengths) + 1e-3))))
                    spans = [spans_of(t, p[e - n : e]) for t, e, n in zip(texts, ends, lengths, strict=True)]
                else:
                    scores, spans = np.full(len(texts), model.share), [[]] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, _SPANS)],
                    names=[*names, "score", "predicted", "spans"],
                )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    return docs.mapInArrow(run, ", ".join([*kept, "score double, predicted int, spans array<struct<start:long,stop:long,p:double>>"]))


def keep_harmless(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, columns unchanged."""
    own = set_aside(docs, RESULTS)
    harmless = score(docs.withColumnsRenamed(own), model, text, threshold).filter("predicted = 0")
    return harmless.select([F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
