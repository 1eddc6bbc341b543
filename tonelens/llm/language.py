"""Language of texts by averaged hashed subword embeddings and a linear softmax.

Texts are lower-cased; anything but a letter is a mark.  Subwords are the n-grams of ``GRAMS`` characters with letters
inside, marks at most at their ends, each hashed into one of ``BUCKETS`` embeddings.  A text is the mean of the embeddings
of all its subwords; a linear layer and a softmax turn it into probabilities of the languages.

``fit`` reads at most ``FIT_ROWS`` labelled rows and ``FIT_BYTES`` of text of each language, whole texts in the order of a
hash.  They are cut into windows of ``WINDOW`` words, so that the model meets short texts as well, and embeddings and
layer are trained by stochastic gradient descent.  Every fifth text is left out of that: on its windows a temperature is
fitted, by which probabilities mean what they say, and the least probability is found at which accepted windows are right
in ``PRECISION`` of cases.  Below it a prediction is marked as not accepted.

``predict`` is narrow: one pass over the characters of each whole text, many texts side by side in numpy.  Where there are
fewer languages than dimensions the layer is applied to the embeddings beforehand.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text if no language was
learnt; of equally likely languages the first by name; rows without a text or a language are not learnt from; repeated
rows are predicted alike; columns of the input stay, but for those named as a result, in any case of letters; an empty
table gives an empty one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tonelens.llm.common import free_name, slices
from tonelens.plans.sizing import collect_bounded

UNKNOWN = "und"
FIT_ROWS, FIT_BYTES = 400, 600_000
#: Most languages that are learnt.
LANGUAGES = 200
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
DIMENSIONS = 16
WINDOW = 40
BATCH, PASSES, RATE = 128, 3, 4.0
CALIBRATION = 5
PRECISION = 0.99
#: Bytes of text that are looked at side by side; a longer text is looked at whole.
SLICE_BYTES = 1 << 19
#: Odd 32-bit multipliers of the characters of an n-gram, and of its sum.
PLACES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
MIX = 0x165667B1

RESULTS = ("lang_pred", "score", "accepted")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, gram size by gram size, and the number of the text of each."""
    whole = "".join(f"\0{t}\0" for t in map(str.lower, texts))
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(0))
    # a text's number at each of its characters; lower-casing may change lengths
    number = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.lower()) + 2 for t in texts])
    buckets, owners = [], []
    total, inside = points * np.uint32(PLACES[0]), None
    for n in range(2, max(GRAMS) + 1):
        ends = len(points) - n + 1
        if ends <= 0:
            break
        total = total[:ends] + points[n - 1 :] * np.uint32(PLACES[n - 1])
        inside = letter[:-1] | letter[1:] if n == 2 else letter[1:-1] if n == 3 else inside[:ends] & letter[n - 2 : -1]
        if n in GRAMS:
            at = np.flatnonzero(inside)
            buckets.append(((total[at] + np.uint32(n)) * np.uint32(MIX)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
            owners.append(number[at])
    return np.concatenate(buckets), np.concatenate(owners)


class Model(NamedTuple):
    """A text's scores are the mean of its subwords' rows of ``table`` times ``layer``, plus ``bias``."""

    languages: list[str]
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float
    floor: float  # least accepted score


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


class _Windows:
    """Windows of words as runs of bucket numbers."""

    def __init__(self, texts: list[str], classes: list[int]):
        pieces, self.y, self.doc = [], [], []
        for i, (text, y) in enumerate(zip(texts, classes, strict=True)):
            words = text.split()
            for at in range(0, len(words), WINDOW):
                pieces.append(" ".join(words[at : at + WINDOW]))
                self.y.append(y)
                self.doc.append(i)
        buckets, owners = subwords(pieces) if pieces else (np.zeros(0, np.uint32), np.zeros(0, np.int32))
        self.buckets = buckets[np.argsort(owners, kind="stable")].astype(np.int64)
        sizes = np.bincount(owners, minlength=len(pieces))
        some = sizes > 0  # windows without a letter say nothing
        self.sizes, self.starts = sizes[some], (np.cumsum(sizes) - sizes)[some]
        self.y, self.doc = np.array(self.y, np.int64)[some], np.array(self.doc, np.int64)[some]

    def of(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of these windows end to end, and how many each has."""
        sizes = self.sizes[window]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[window], sizes)
        return self.buckets[at], sizes


def _means(vectors: np.ndarray, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(vectors[buckets], np.cumsum(sizes) - sizes) / sizes[:, None]


def loss_and_slopes(vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, y: np.ndarray):
    """Mean loss, and its gradients: per touched bucket (buckets, rows), of the layer and of the bias."""
    mean = _means(vectors, buckets, sizes)
    p = softmax(mean @ layer + bias)
    loss = -np.log(p[np.arange(len(y)), y] + 1e-12).mean()
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    # a bucket's gradient is the sum over windows of its count there times the window's
    window = np.repeat(np.arange(len(y)), sizes)
    pairs, counts = np.unique(buckets.astype(np.int64) * len(y) + window, return_counts=True)
    touched, first = np.unique(pairs // len(y), return_index=True)
    slope = (p @ layer.T / sizes[:, None])[pairs % len(y)] * counts[:, None]
    return loss, (touched, np.add.reduceat(slope, first)), mean.T @ p, p.sum(axis=0)


def _train(windows: _Windows, chosen: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer, bias = rng.uniform(-0.5, 0.5, (DIMENSIONS, n)), np.zeros(n)
    # languages in equal shares: draws by class
    weight = 1 / np.bincount(windows.y[chosen], minlength=n)[windows.y[chosen]]
    steps = PASSES * -(-len(chosen) // BATCH)
    for step in range(steps):
        picked = rng.choice(chosen, BATCH, p=weight / weight.sum())
        buckets, sizes = windows.of(picked)
        _, (touched, rows), of_layer, of_bias = loss_and_slopes(vectors, layer, bias, buckets, sizes, windows.y[picked])
        rate = RATE * (1 - step / steps)
        vectors[touched] -= 10 * rate * rows
        layer -= rate * of_layer
        bias -= rate * of_bias
    return vectors, layer, bias


def calibrated(scores: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> tuple[float, float]:
    """The temperature with the least loss, and the least probability from which on ``precision`` of cases are right."""
    if not len(y):
        return 1.0, 0.0
    tried = np.geomspace(0.1, 20, 60)
    losses = [-np.log(softmax(scores / t)[np.arange(len(y)), y] + 1e-12).mean() for t in tried]
    temperature = float(tried[int(np.argmin(losses))])
    p = softmax(scores / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-best, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= precision)
    return temperature, float(best[order[good[-1]]]) if len(good) else 1.0


_NOTHING = Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), 1.0, 0.0)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", rows: int = FIT_ROWS) -> Model:
    """Learns from a sample of whole labelled texts, in order of a hash of language and text."""
    known = docs.select(F.col(lang).cast("string").alias("y"), F.col(text).alias("t")).filter("y IS NOT NULL AND t IS NOT NULL")
    known = known.withColumns({"h": F.xxhash64("y", "t"), "n": F.octet_length("t")})
    # the window's limit is applied in every task before rows of a language meet
    first = known.select("y", "h", "n").withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "n"))).filter(F.col("r") <= rows)
    room: dict[str, int] = {}
    keys = []
    for r in sorted(collect_bounded(first.select("y", "h", "n"), LANGUAGES * rows, "labelled texts")):
        if r["n"] <= room.setdefault(r["y"], FIT_BYTES):
            room[r["y"]] -= r["n"]
            keys.append((r["y"], r["h"]))
    if not keys:
        return _NOTHING
    # one row for each key, at most rows * LANGUAGES; equal texts are one
    wanted = docs.sparkSession.createDataFrame(sorted(set(keys)), "y string, h long")
    sample = known.join(F.broadcast(wanted), ["y", "h"]).groupBy("y", "h").agg(F.first("t").alias("t"))
    found = sorted(tuple(r) for r in collect_bounded(sample, LANGUAGES * rows, "labelled texts"))
    languages = sorted({y for y, _, _ in found})
    windows = _Windows([t for _, _, t in found], [languages.index(y) for y, _, _ in found])
    if not len(windows.y):
        return _NOTHING
    languages = [languages[y] for y in sorted(set(windows.y.tolist()))]  # those with a letter
    windows.y = np.unique(windows.y, return_inverse=True)[1]
    aside = windows.doc % CALIBRATION == 0
    trained = np.flatnonzero(~aside) if len(set(windows.y[~aside])) == len(languages) else np.arange(len(aside))
    vectors, layer, bias = _train(windows, trained, len(languages))
    held = np.flatnonzero(aside)
    scores = np.concatenate([_means(vectors, *windows.of(held[i : i + 512])) @ layer + bias for i in range(0, len(held), 512)] or [np.zeros((0, 1))])
    temperature, floor = calibrated(scores, windows.y[held])
    table, layer = (vectors, layer) if len(languages) > DIMENSIONS else (vectors @ layer, np.eye(len(languages)))
    return Model(languages, np.ascontiguousarray(table, np.float32), layer, bias, temperature, floor)


def scores_of(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have a letter, and the probabilities of the languages of those."""
    buckets, owners = subwords(texts)
    sizes = np.bincount(owners, minlength=len(texts))
    some = sizes > 0
    means = np.stack([np.bincount(owners, column[buckets], len(texts))[some] / sizes[some] for column in np.ascontiguousarray(model.table.T)], axis=1)
    return some, softmax((means @ model.layer + model.bias) / model.temperature)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, its probability ``score``, and whether it is ``accepted``."""
    kept = [f for f in docs.schema if f.name.lower() not in RESULTS]
    names, judged = [f.name for f in kept], free_name(docs, "judged")
    asked = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias(judged))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of at most DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for batch in slices(whole, judged, most_bytes=SLICE_BYTES):
                texts = [t or "" for t in batch.column(judged).to_pylist()]
                some, best, score = np.zeros(len(texts), bool), np.zeros(len(texts), np.int64), np.zeros(len(texts))
                if model.languages:
                    some, p = scores_of(texts, model)
                    best[some], score[some] = p.argmax(axis=1), p.max(axis=1)
                called = [model.languages[i] if s else UNKNOWN for i, s in zip(best, some, strict=True)]
                own = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(called, pa.string()), pa.array(score), pa.array(some & (score >= model.floor))], names=[*names, *RESULTS]
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return asked.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, accepted boolean"]))
