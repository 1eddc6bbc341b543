"""Near-duplicate documents: SetSketch registers, banded, estimated by likelihood, verified on full sets.

A document's set holds the 64-bit hashes of its distinct runs of ``SHINGLE`` words.  Register i of its sketch is the
least of an exponential hash over the set, on a logarithmic scale of base ``BASE`` cut to two bytes: sketches of parts
merge by maximum, and registers of two sets are equal about as often as the sets overlap.  With a base so close to 1
unrelated sets agree in one register of 4 000, so buckets do not fill up with strangers as the corpus grows.

1. Sketch every text in one narrow pass; documents with equal sets (size and 128-bit digest) form a class, whose least
   id stands for it.  From here on copies cost nothing.
2. Every ``ROWS`` registers are a band.  Two classes with equal values in a band share a bucket.
3. Each bucket has a hub; its other members are paired with the hub only.  Hubs differ from band to band, so a large
   group gets many.  For a pair, register comparisons give the maximum-likelihood Jaccard similarity; pairs below
   ``FLOOR``, over five standard errors under the threshold, are dropped.
4. The best pair of every class is verified on the full sets, then all others whose ends are still apart.
5. In buckets that still hold more than one component, every pair across is estimated inside the tasks, which give only
   each class's likeliest partner; these are verified.  Classes without a likely partner are done.  Of the others, what
   is still apart is compared inside the tasks on the full sets, which give only links.  A large bucket is cut into
   parts, any two of which make a block of work.  So any two classes that share a bucket are connected, or were
   compared, and no list of all pairs is ever made.
6. Components of the verified links.

With 32 bands of 4 registers a pair at the threshold shares no bucket with probability 5e-6.

Scale: the widest shuffles are 32 rows of 20 bytes a class and, twice, the texts of the classes in candidate pairs.
No group is gathered; hot buckets and hubs are skewed join keys, which Spark splits.

Defined results: null and blank texts have an empty set and are linked with nothing; fewer than ``SHINGLE`` words are
one shingle; repeated rows are copies; a null id never stands for a class, its row is alone unless a copy has an id;
one id should name one text; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tonelens.llm.common import free_name, lists, slices, utf8
from tonelens.llm.components import components
from tonelens.plans.workdir import materialise

SHINGLE = 5
#: Similarity that links, in hundredths.
PERCENT = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
FLOOR = 0.55
#: Hashes sketched at once.
BLOCK = 1 << 12
#: Members of one part of a large bucket, about, and pairs compared at once.
PART, PAIRS = 2048, 1 << 16
#: Bits of the map that marks wanted ids.
MARKS = 1 << 26

_STEP, _MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _scatter(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SEEDS = _scatter(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * _STEP)
_FACTOR, _SHIFT = _SEEDS[:REGISTERS] | np.uint64(1), _SEEDS[REGISTERS:]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _scatter((total + hashes[k : k + n]) * _STEP)
    return np.unique(total)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[i : i + BLOCK, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    exponential = -np.log1p(-np.minimum((least.astype(np.float64) + 1) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype(np.uint16)


def likely_similarity(above: np.ndarray, below: np.ndarray, m: int, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, given how many of ``m`` registers of a are above and below those of b.

    With shares u and v of the sizes, a register is above with probability p(u - vJ) and below with p(v - uJ), where
    p(x) = -log_b(1 - x (b - 1) / b).  The likelihood is concave in J, so its slope is bisected.
    """
    u = size_a / (size_a + size_b)
    v = 1 - u
    scale, log_base = (BASE - 1) / BASE, np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-x * scale) / log_base, -np.log1p(-y * scale) / log_base
        dp, dq = -v * scale / (1 - x * scale) / log_base, -u * scale / (1 - y * scale) / log_base
        slope = above * dp / p + below * dq / q - (m - above - below) * (dp + dq) / np.maximum(1 - p - q, 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


#: The registers of band i as one long.
_REGISTER_COLUMNS = [f"r{i}" for i in range(BANDS)]


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n, d1, d2, r0 ...)``: set size, set digest, and registers, a band of them to a long."""
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    names = ["id", "n", "d1", "d2", *_REGISTER_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles(t) for t in utf8(batch, "text")]
                regs = np.zeros((len(sets), REGISTERS), np.uint16)
                for i, s in enumerate(sets):
                    if len(s):
                        regs[i] = registers(s)
                sizes = np.array([len(s) for s in sets], np.int64)
                sums = [np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for f in (lambda s: s, lambda s: _scatter(s ^ _STEP))]
                packed = regs.view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sizes), *map(pa.array, sums), *(pa.array(packed[:, i]) for i in range(BANDS))], names=names
                )

    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in names))


#: What names a bucket: the band and its registers.
_BUCKET = ["band", "value"]


def _buckets() -> Column:
    return F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("band"), F.col(c).alias("value")) for i, c in enumerate(_REGISTER_COLUMNS)]))


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b, likely)`` of the distinct pairs that may be similar: by size, then by registers."""
    side = lambda p: classes.select(F.col("id").alias(p), F.col("n").alias(f"{p}n"), *[F.col(c).alias(f"{p}{c}") for c in _REGISTER_COLUMNS])
    wide = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    wide = wide.filter(100 * F.least("an", "bn") >= PERCENT * F.greatest("an", "bn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = [np.stack([batch.column(f"{p}{c}").to_numpy() for c in _REGISTER_COLUMNS], axis=1).view(np.uint16) for p in "ab"]
            above, below = (regs[0] > regs[1]).sum(axis=1), (regs[0] < regs[1]).sum(axis=1)
            sizes = [batch.column(f"{p}n").to_numpy().astype(float) for p in "ab"]
            likely = likely_similarity(above, below, REGISTERS, *sizes)
            found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(likely)], names=["a", "b", "likely"])
            yield found.filter(pa.array(likely >= FLOOR))

    return wide.mapInArrow(run, "a long, b long, likely double")


def _marked(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows whose id may be in ``named``: few texts are then shuffled to meet it.

    Ids mark bits of a map of fixed size, 2^20 words of 64 bits at most, which is copied to all tasks; so many ids that
    the map fills up make it let everything through.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    word, mask = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(id), {MARKS}L) & 63 AS INT))")
    marks = named.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_marks"))
    found = docs.withColumn("_word", word).join(F.broadcast(marks), "_word")
    return found.filter(F.col("_marks").bitwiseAND(mask) != 0).drop("_word", "_marks")


def _sets(docs: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, hashes)`` of the documents named by ``pairs``."""
    named = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    slim = _marked(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), named).join(named, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shingles(t).view(np.int64) for t in utf8(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists(found, pa.int64())], names=["id", "hashes"])

    return slim.mapInArrow(run, "id long, hashes array<long>").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    side = lambda p: sets.select(F.col("id").alias(p), F.col("hashes").alias(f"{p}s"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("as", "bs"))
    return both.filter(100 * shared >= PERCENT * (F.size("as") + F.size("bs") - shared)).select("a", "b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    label = lambda p: labels.select(F.col("node").alias(p), F.col("label").alias(f"{p}_label"))
    marked = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return marked.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))


def _mixed(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, dealt to blocks, with the columns of ``classes``.

    A bucket of many members is cut into parts by a hash of the id; a block is a pair of its parts ``(i, j)``, so that
    any two members meet in one block, and ``side`` says which of the two parts a row is from.
    """
    known = labels.select(F.col("node").alias("id"), "label")
    marked = members.join(known, "id", "left").withColumn("label", F.coalesce("label", "id"))
    shape = marked.groupBy(*_BUCKET).agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_n")).filter("_low <> _high")
    shape = shape.select(*_BUCKET, F.ceil(F.col("_n") / PART).alias("_parts"))
    parted = marked.join(shape, _BUCKET).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    dealt = parted.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    rows = dealt.select(
        *_BUCKET, "id", "label", "hub", F.least("_part", "_with").alias("i"), F.greatest("_part", "_with").alias("j"),
        (F.col("_part") > F.col("_with")).cast("int").alias("side"),
    )
    block = [*_BUCKET, "i", "j"]
    return rows.join(classes, "id").repartition(*block).sortWithinPartitions(*block, "side", "id")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole blocks, from rows sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 2 * PART:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        block = np.stack([table[c].to_numpy() for c in (*_BUCKET, "i", "j")])
        changes = np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1
        if len(changes):
            yield table.slice(0, changes[-1])
            held = table.slice(changes[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _across(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``(a, b)`` of blocks that lie across components, were not paired with the hub, and may be similar, with
    their likely similarity.  A pair that shares several buckets is met in that of the lowest band only."""
    band, value, i, j, side, ids, label, hub, size = (table[c].to_numpy() for c in (*_BUCKET, "i", "j", "side", "id", "label", "hub", "n"))
    bands = np.stack([table[c].to_numpy() for c in _REGISTER_COLUMNS], axis=1)
    regs = bands.view(np.uint16)
    block = np.stack([band, value, i, j])
    starts = np.concatenate([[0], np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1])
    ends = np.append(starts[1:], len(band))
    number = np.repeat(np.arange(len(starts)), ends - starts)
    second = starts + np.add.reduceat(side == 0, starts)
    rows = np.arange(len(band))
    first = np.where(i == j, rows + 1, np.where(side == 0, second[number], ends[number]))
    partners = ends[number] - first
    stops = np.cumsum(partners)
    at = 0
    while at < len(rows):
        before = stops[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(stops, before + PAIRS, side="right")))
        count = partners[at:stop]
        a = np.repeat(rows[at:stop], count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + first[a]
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        keep = (label[a] != label[b]) & (100 * small >= PERCENT * large) & (ids[a] != hub[a]) & (ids[b] != hub[a])
        a, b = a[keep], b[keep]
        keep = (bands[a] == bands[b]).argmax(axis=1) == band[a]
        a, b = a[keep], b[keep]
        above, below = (regs[a] > regs[b]).sum(axis=1), (regs[a] < regs[b]).sum(axis=1)
        likely = likely_similarity(above, below, REGISTERS, size[a].astype(float), size[b].astype(float))
        keep = likely >= FLOOR
        yield a[keep], b[keep], likely[keep]
        at = stop


def _closest(mixed: DataFrame) -> DataFrame:
    """``(id, other, likely)``: for each row of a block its likeliest partner across, if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            ids = table["id"].to_numpy()
            best, other = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for a, b, likely in _across(table):
                for x, y in ((a, b), (b, a)):
                    order = np.argsort(likely, kind="stable")
                    x, y, found = x[order], y[order], likely[order]
                    better = found > best[x]
                    best[x[better]], other[x[better]] = found[better], ids[y[better]]
            has = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(other[has]), pa.array(best[has])], names=["id", "other", "likely"])

    return mixed.mapInArrow(run, "id long, other long, likely double")


def _linked_in_buckets(mixed: DataFrame) -> DataFrame:
    """Verified links across components inside the blocks; ``mixed`` has the full sets as ``hashes``.

    Likely pairs go first, and a pair whose ends are connected by then is skipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            ids, label = table["id"].to_numpy(), table["label"].to_numpy()
            lists_of = table["hashes"].chunk(0)
            ends, flat = lists_of.offsets.to_numpy(), lists_of.values.to_numpy()
            parent = {x: x for x in label.tolist()}

            def root(x: int, parent=parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            found: list[tuple[int, int]] = []
            for a, b, likely in _across(table):
                for k in np.argsort(-likely, kind="stable"):
                    x, y = int(a[k]), int(b[k])
                    u, v = root(int(label[x])), root(int(label[y]))
                    if u == v:
                        continue
                    one, two = flat[ends[x] : ends[x + 1]], flat[ends[y] : ends[y + 1]]
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * shared >= PERCENT * (len(one) + len(two) - shared):
                        parent[u] = v
                        found.append((int(ids[x]), int(ids[y])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return mixed.mapInArrow(run, "a long, b long")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches ``(id, n, d1, d2, ...)``, classes ``(n, d1, d2, id)``, and verified links ``(a, b)`` between classes.

    The links connect what all links between similar classes would connect; inside a connected group not every one of
    them is listed.
    """
    sketches = materialise(sketch(docs, key, text), "sketches")
    content = ["n", "d1", "d2"]
    least = [F.min(c).alias(c) for c in _REGISTER_COLUMNS]  # all equal in a class
    classes = materialise(sketches.filter("n > 0").groupBy(*content).agg(F.min("id").alias("id"), *least).filter("id IS NOT NULL"), "classes")

    rows = classes.select("id", _buckets())
    # the least id of a bucket, the same order in every band, so that a class meets few different hubs
    hubs = rows.groupBy(*_BUCKET).agg(F.min("id").alias("hub"), F.max("id").alias("_high")).filter("hub <> _high").drop("_high")
    members = materialise(rows.join(hubs, _BUCKET), "bucket-members")

    star = materialise(_estimated(members.filter("id <> hub").select(*_ordered(F.col("id"), F.col("hub"))), classes), "hub-pairs")
    sets = materialise(_sets(docs, star, key, text), "sets")
    ends = star.select(F.col("a").alias("id"), F.col("b").alias("other"), "likely").union(star.select("b", "a", "likely"))
    best = ends.groupBy("id").agg(F.max_by("other", "likely").alias("other")).select(*_ordered(F.col("id"), F.col("other"))).distinct()
    links = materialise(_verified(best, sets), "links")
    apart = _apart(star, components(links))
    links = links.union(materialise(_verified(apart, sets), "links"))

    mixed = _mixed(members, components(links), classes)
    near = materialise(_closest(mixed), "closest")
    ends = near.select("id").union(near.select(F.col("other").alias("id"))).distinct()
    sets = materialise(_sets(docs, near.select(*_ordered(F.col("id"), F.col("other"))), key, text), "sets")
    best = near.groupBy("id").agg(F.max_by("other", "likely").alias("other")).select(*_ordered(F.col("id"), F.col("other"))).distinct()
    links = links.union(materialise(_verified(best, sets), "links"))
    few = _mixed(members.join(ends, "id", "left_semi"), components(links), classes.join(sets, "id"))
    links = links.union(materialise(_linked_in_buckets(few), "links"))
    return sketches, classes.select(*content, "id"), links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``(key, n_shingles, component_id, kept)``; the least id of a component is kept."""
    sketches, classes, links = link(docs, key, text)
    found = (
        sketches.select("id", "n", "d1", "d2")
        .join(classes.withColumnRenamed("id", "class_id"), ["n", "d1", "d2"], "left")
        .join(components(links).select(F.col("node").alias("class_id"), "label"), "class_id", "left")
    )
    component = F.coalesce("label", "class_id", "id")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their component, columns unchanged; of repeated rows all stay, as they share the id."""
    name = free_name(docs, "_gone")
    gone = near_duplicates(docs, key, text).filter("NOT kept").select(F.col(key).alias(name)).distinct()
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")
