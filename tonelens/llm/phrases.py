"""Collocations: frequent phrases of each language, scored by how much their parts attract each other.

Texts, A to Z lower-cased, are cut into pieces at ``PIECE_ENDS`` and those into words at blanks and tabs.  ``f`` counts
all contiguous occurrences of a phrase within pieces, overlaps included.

1. Words are counted; those found ``least`` times get a number.  Texts become arrays of such numbers, written once: 0
   stands for a rarer word or the end of a piece, which no frequent phrase holds.
2. Candidates of k words are two frequent phrases of k - 1 that start at neighbouring positions often enough.  No
   frequent phrase is missed: its first and last k - 1 words are as frequent, and so is their meeting.
3. Candidates go into double-array tries of at most ``TRIE_PHRASES`` phrases, broadcast one by one.  Each task moves all
   text positions through the trie at the same time, number by number (three digits a number, so that rows are narrow),
   drops the dead ones, counts the accepting states, and the meetings that make the next candidates; Spark sums the
   tasks' counts.
4. A phrase's score is the least, over its cuts in two, of ``floor(1000 a n / (l r))``, in exact decimals.

What is broadcast or collected at once is bounded: ``WORD_BLOCK`` words, ``TRIE_PHRASES`` phrases.  More of them take
more passes over the number arrays, nothing is dropped.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they
occur; equal scores go by ``a``, then by phrase; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tonelens.llm.common import lists, slices, utf8
from tonelens.plans.sizing import MAX_CLASSES, collect_bounded
from tonelens.plans.workdir import materialise

#: Fixed value: what ends a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
LEAST = 100
LONGEST = 5
#: Share, in hundredths, of a phrase's occurrences inside one longer phrase from which the phrase is dropped.
INSIDE = 100
#: Words that a task's dictionary holds at once.
WORD_BLOCK = 500_000
#: Phrases of one trie.
TRIE_PHRASES = 250_000
#: Distinct words, and text positions, that a task counts before it hands its counts on.
HELD_WORDS, HELD_POSITIONS = 200_000, 4_000_000
DIGITS = 3
#: Parts that the phrases of a language are ranked in first.
RANK_PARTS = 32
#: Nodes with more children get a range of slots of their own.
FEW = 8

_END = b"\xff"  # in no UTF-8 text
_FOLD = bytes(b"\xff"[0] if b in PIECE_ENDS else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, with ``_END`` where a piece ends.

    The white space that ``split`` knows besides blanks and tabs ends a piece.
    """
    return text.translate(_FOLD).replace(_END, b" \xff ").split()


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def count_words(docs: DataFrame) -> DataFrame:
    """``(lang, word, f)`` of a table ``(lang, text)``; a null word has the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def results() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(_END, None)
                total = sum(own.values())
                words, n = [None, *own], [total, *own.values()]
                for i in range(0, len(words), 100_000):
                    part = words[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), _strings(part), pa.array(n[i : i + 100_000], pa.int64())], names=["lang", "word", "f"]
                    )
            counts.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
                    counts.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > HELD_WORDS:
                    yield from results()
        yield from results()

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``id`` from 1 without gaps; written, so ids stay."""
    stored = materialise(rows.withColumn("part", F.spark_partition_id()), "rows")
    sizes = sorted(tuple(r) for r in collect_bounded(stored.groupBy("part").count(), MAX_CLASSES, "partitions to number"))
    if not sizes:
        return stored.drop("part").withColumn("id", F.lit(1))
    before = F.create_map(*(F.lit(int(x)) for (p, _), at in zip(sizes, np.cumsum([0, *(n for _, n in sizes)])[:-1], strict=True) for x in (p, at)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return materialise(stored.withColumn("id", (before[F.col("part")] + place).cast("int")).drop("part"), "numbered")


def _joinable(ids: np.ndarray) -> np.ndarray:
    """Drops numbers between two zeros, which stand in no phrase, and all but one of neighbouring zeros."""
    known = np.concatenate([[0], ids, [0]]) > 0
    ids = np.where(known[:-2] | known[2:], ids, 0)
    known = np.concatenate([[0], ids]) > 0
    return ids[known[1:] | known[:-1]]


def encode(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Texts as arrays of word numbers (``ids``), 0 between them, one dictionary block after the other."""
    spark = docs.sparkSession
    last = words.agg(F.max("id")).first()[0] or 0
    starts = list(range(1, last + 1, WORD_BLOCK)) or [1]
    table = docs
    for start in starts:
        block = words.filter(F.col("id").between(start, start + WORD_BLOCK - 1)).toArrow()
        langs, names, ids = (np.array(block.column(c).to_pylist(), object) for c in ("lang", "word", "id"))
        packed = {lang: (" ".join(names[langs == lang]).encode(), ids[langs == lang].astype(np.int32)) for lang in set(langs)}
        sent, final = spark.sparkContext.broadcast(packed), start == starts[-1]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, final=final) -> Iterator[pa.RecordBatch]:
            known = {lang: dict(zip(blob.split(b" "), own.tolist(), strict=True)) for lang, (blob, own) in sent.value.items()}
            for whole in batches:
                for batch in slices(whole, "text"):
                    found = []
                    before = batch.column("ids").to_pylist() if "ids" in batch.schema.names else [None] * batch.num_rows
                    for lang, text, old in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), before, strict=True):
                        own = known.get(lang, {})
                        ids = np.array([own.get(w, 0) for w in words_of(text)], np.int32)
                        ids = ids if old is None else np.where(ids, ids, np.array(old, np.int32))
                        found.append(np.concatenate([_joinable(ids), [0]]).astype(np.int32) if final else ids)
                    arrays = [] if final else [batch.column("lang"), batch.column("text")]
                    yield pa.RecordBatch.from_arrays([*arrays, lists(found, pa.int32())], names=["lang", "text", "ids"][-len(arrays) - 1 :])

        schema = "ids array<int>" if final else "lang string, text string, ids array<int>"
        table = materialise(table.mapInArrow(run, schema), "phrase-texts")
        sent.destroy()
    return table


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The number arrays of a task end to end, in stretches of bounded length, column by column."""
    held, n = [], 0
    for batch in batches:
        held.append([column.flatten().to_numpy() for column in batch.columns])
        n += len(held[-1][0])
        if n >= HELD_POSITIONS:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _pairs(at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each two phrases start at neighbouring positions, as ``a, b, n``."""
    a, b = at[:-1].astype(np.int64), at[1:]
    pairs, n = np.unique(((a << 32) | b)[(a > 0) & (b > 0)], return_counts=True)
    for i in range(0, len(pairs), 500_000):
        part = pairs[i : i + 500_000]
        yield pa.RecordBatch.from_arrays([pa.array(part >> 32), pa.array(part & 0xFFFFFFFF), pa.array(n[i : i + 500_000])], names=["a", "b", "n"])


def _often(rows: DataFrame, least: int) -> DataFrame:
    return materialise(rows.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrase-counts")


def _longer(often: DataFrame, phrases: DataFrame) -> DataFrame:
    """Candidates (``ids``) one word longer: two phrases (``id, ids``) that start side by side often enough."""
    first, then = (phrases.select(F.col("id").alias(c), F.col("ids").alias(f"{c}_ids")) for c in ("a", "b"))
    return often.join(first, "a").join(then, "b").select(F.concat("a_ids", F.slice("b_ids", -1, 1)).alias("ids"))


def seeds(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Candidates of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (flat,) in _flat(batches):
            yield from _pairs(flat)

    return _longer(_often(texts.mapInArrow(run, "a long, b long, n long"), least), words.select("id", F.array("id").alias("ids")))


class Trie:
    """Double-array trie: from state ``s``, digit ``d`` leads to ``base[s] + d`` if ``check`` there is ``s``.

    ``accept`` has, for each state, one more than the place of the phrase that ends in it.  State 1 is the root, 0 dead.
    """

    def __init__(self, phrases: np.ndarray):
        """``phrases``: one row of numbers from 1 for each."""
        n, words = phrases.shape
        self.words, self.size = words, n
        self.bits = max(2, -(-int(phrases.max(initial=1)).bit_length() // DIGITS))
        shifts = self.bits * np.arange(DIGITS - 1, -1, -1)
        digits = ((phrases[:, :, None] >> shifts) & ((1 << self.bits) - 1)).reshape(n, words * DIGITS)
        order = np.lexsort(digits.T[::-1])
        digits = digits[order]
        # nodes, level by level: the distinct prefixes; node 0 is the root
        changed = np.zeros(n, bool)
        changed[:1] = True
        node, parents, symbols, total = np.zeros(n, np.int64), [], [], 1
        for level in range(digits.shape[1]):
            changed[1:] |= digits[1:, level] != digits[:-1, level]
            parents.append(node[changed])
            symbols.append(digits[changed, level])
            node = total + np.cumsum(changed) - 1
            total += int(changed.sum())
        parent, symbol = np.concatenate(parents), np.concatenate(symbols)  # of nodes 1, 2, ...: edges, in order of parents
        bases, slots = self._placed(parent, symbol, total)
        state = np.concatenate([[1], slots])
        self.base = np.zeros(int(state.max()) + (1 << self.bits) + 1, np.int32)
        self.check = np.full(len(self.base), -1, np.int32)
        self.base[state] = bases
        self.check[slots] = state[parent]
        self.accept = np.zeros(len(self.base), np.int32)
        self.accept[state[node]] = order + 1

    def _placed(self, parent: np.ndarray, symbol: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """A base for every node such that no two edges share a slot, and each edge's slot.

        Wide nodes lie one after the other; narrow ones try places at random, all of them at the same time, widest first.
        """
        width = np.bincount(parent, minlength=total)
        bases = np.zeros(total, np.int64)
        at, span = 2, 1 << self.bits
        for v in np.flatnonzero(width > FEW):
            bases[v] = at
            at += span
        rng, room = np.random.default_rng(0), 4 * int(width[width <= FEW].sum()) + span
        taken = np.zeros(room + span, bool)
        for n in range(FEW, 0, -1):
            edges = np.flatnonzero(width[parent] == n).reshape(-1, n)  # one row a node, as edges go by parent
            while len(edges):
                tried = rng.integers(0, room, len(edges))
                places = tried[:, None] + symbol[edges]
                free = ~taken[places].any(axis=1)
                flat = places.ravel()
                by_place = np.argsort(flat, kind="stable")
                second = np.flatnonzero(flat[by_place][1:] == flat[by_place][:-1]) + 1
                free[by_place[second] // n] = False
                taken[places[free]] = True
                bases[parent[edges[free, 0]]] = at + tried[free]
                edges = edges[~free]
        return bases, bases[parent] + symbol

    def find(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases start in an array of numbers, and which, from 0; all positions move at the same time."""
        start = np.flatnonzero(flat)
        state = np.ones(len(start), np.int32)
        mask = (1 << self.bits) - 1
        for word in range(self.words):
            inside = start + word < len(flat)
            start, state = start[inside], state[inside]
            number = flat[start + word]
            for digit in range(DIGITS - 1, -1, -1):
                ahead = self.base[state] + ((number >> (self.bits * digit)) & mask)
                live = (self.check[ahead] == state) & (number < 1 << (self.bits * DIGITS))
                start, state, number = start[live], ahead[live], number[live]
        return start, self.accept[state] - 1


def count_candidates(texts: DataFrame, candidates: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``(ids, f)`` of the candidates found ``least`` times, and the candidates one word longer.

    Where one trie cannot hold all candidates, each but the last writes down which phrase starts where (``at``).
    """
    spark = texts.sparkSession
    stored = numbered(candidates, "ids")
    last = stored.agg(F.max("id")).first()[0] or 0
    starts = list(range(1, last + 1, TRIE_PHRASES))
    table, often = texts, spark.createDataFrame([], "a long, b long, n long")
    for first in starts:
        block = stored.filter(F.col("id").between(first, first + TRIE_PHRASES - 1)).select("ids").orderBy("id").toArrow().column("ids").combine_chunks()
        sent = spark.sparkContext.broadcast(Trie(block.flatten().to_numpy().reshape(len(block), -1)))

        def locate(columns: list[np.ndarray], sent=sent, first=first) -> np.ndarray:
            at = np.zeros(len(columns[0]), np.int32) if len(columns) == 1 else columns[1].copy()
            start, which = sent.value.find(columns[0])
            at[start] = first + which
            return at

        if first != starts[-1]:

            def mark(batches: Iterator[pa.RecordBatch], locate=locate) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    ids = batch.column("ids")
                    at = locate([c.flatten().to_numpy() for c in batch.columns])
                    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(at))], names=["ids", "at"])

            table = materialise(table.mapInArrow(mark, "ids array<int>, at array<int>"), "phrase-places")
            continue

        def run(batches: Iterator[pa.RecordBatch], locate=locate, last=last) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1, np.int64)
            for columns in _flat(batches):
                at = locate(columns)
                total = _plus(total, np.bincount(at))
                yield from _pairs(at)
            hit = np.flatnonzero(total[1:]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(np.zeros_like(hit)), pa.array(total[hit])], names=["a", "b", "n"])

        often = _often(table.mapInArrow(run, "a long, b long, n long"), least)
    found = often.filter("b = 0").join(stored, F.col("a") == F.col("id")).select("ids", F.col("n").alias("f"))
    return found, _longer(often.filter("b > 0"), stored)


def _plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    short, long = sorted((x, y), key=len)
    long = long.copy()
    long[: len(short)] += short
    return long


def scored(phrases: DataFrame, totals: DataFrame, words: DataFrame) -> DataFrame:
    """``(ids, lang, a, l, r, n, score)`` of the phrases of two words and more, at their lowest-scoring cut."""
    many = phrases.filter("size(ids) > 1")
    cuts = many.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(ids, 1, k)").alias("first"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    cuts = cuts.join(phrases.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first")
    cuts = cuts.join(phrases.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    cuts = cuts.join(words.select(F.array("id").alias("first_word"), "lang"), F.expr("slice(ids, 1, 1) = first_word"))
    cuts = cuts.join(totals, "lang")
    whole = "CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(14, 0)) * CAST(n AS DECIMAL(16, 0))"
    score = F.expr(f"{whole} DIV (CAST(l AS DECIMAL(14, 0)) * CAST(r AS DECIMAL(14, 0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("ids", "lang", "a", "n").agg(best).select("ids", "lang", "a", "best.l", "best.r", "n", "best.score")


def not_inside(phrases: DataFrame, inside: int = INSIDE) -> DataFrame:
    """The phrases (``ids, f``) of which no longer one has ``inside`` hundredths of the occurrences."""
    longer = phrases.filter("size(ids) > 2").select(F.col("f").alias("most"), "ids", F.explode(F.expr("sequence(2, size(ids) - 1)")).alias("m"))
    longer = longer.select("most", F.explode(F.expr("transform(sequence(1, size(ids) - m + 1), i -> slice(ids, i, m))")).alias("ids"))
    most = longer.groupBy("ids").agg(F.max("most").alias("most"))
    many = phrases.filter("size(ids) > 1")
    return many.join(most, "ids", "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("f"))).select("ids")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int | None = None
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``, best first; the first ``top`` of each language if that is given."""
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    counts = count_words(slim)
    words = numbered(counts.filter(F.col("word").isNull() | (F.col("f") >= least)), "lang", "word")
    totals = words.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    words = words.filter("word IS NOT NULL")
    texts = encode(slim, words)
    phrases, candidates = words.select(F.array("id").alias("ids"), "f"), seeds(texts, words, least)
    for _ in range(2, longest + 1):
        found, candidates = count_candidates(texts, candidates, least)
        phrases = phrases.union(found)
    phrases = materialise(phrases, "all-phrases")
    kept = scored(phrases, totals, words).join(not_inside(phrases, inside), "ids")
    spelt = kept.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    columns = ["lang", "a", "l", "r", "n", "score"]
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = spelt.groupBy("ids", *columns).agg(phrase.alias("phrase"))
    best = (F.desc("score"), F.desc("a"), "phrase")
    if top is not None:  # the first of each part, so that a language's final order holds top * RANK_PARTS rows at most
        part = F.pmod(F.xxhash64("ids"), F.lit(RANK_PARTS))
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).filter(F.col("rank") <= top)
    order = Window.partitionBy("lang").orderBy(*best)
    ranked = named.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *columns[1:])
