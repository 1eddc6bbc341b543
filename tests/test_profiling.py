import numpy as np
from pyspark.sql import functions as F

from conftest import plan_of
from tonelens.functions import bit_filter
from tonelens.operators import leakage, profiling


def corpus(spark):
    rows = [(i, " ".join(["word"] * (1 + (i * i) % 47)) + " tail", int(i % 3 == 0)) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, text string, label int")


def test_balance_and_summary(spark):
    df = corpus(spark)
    shares = {r.label: (r.n, r.share) for r in profiling.class_balance(df).collect()}
    assert abs(sum(s for _, s in shares.values()) - 1) < 1e-12 and shares[1][0] == 67
    summary = profiling.corpus_summary(df).orderBy("label").collect()
    assert [r.total for r in summary] == [200, 200] and abs(sum(r.percent for r in summary) - 100) < 1e-9
    assert summary[0].duplicates == 200 - df.select("text").distinct().count()


def test_histogram_agrees_with_numpy(spark):
    df = corpus(spark).unionByName(spark.createDataFrame([(900, "one two", 5), (901, "two one", 5)], "row_id long, text string, label int"))
    rows = profiling.length_histogram(df).collect()
    texts = df.collect()
    for label in (0, 1, 5):
        for measure, size in (("words", lambda t: len(t.split())), ("chars", len)):
            mine = sorted((r.bin, r.n, r.bin_start) for r in rows if r.label == label and r.measure == measure)
            counts, edges = np.histogram([size(r.text) for r in texts if r.label == label], bins=30)
            assert [n for _, n, _ in mine] == counts.tolist()
            assert np.allclose([s for _, _, s in mine], edges[:-1])


def test_top_ngrams_break_ties_alphabetically(spark):
    df = spark.createDataFrame([("bb aa the bb", 0), ("aa cc", 0), ("zz", 1)], "text string, label int")
    out = profiling.top_ngrams(df, ["the"], 1, 2)
    assert sorted(map(tuple, out.collect())) == [(0, "aa", 2, 1), (0, "bb", 2, 2), (1, "zz", 1, 1)]
    bigrams = profiling.top_ngrams(df, ["the"], 2, 5).filter("label = 0")
    assert {r.term for r in bigrams.collect()} == {"bb aa", "aa bb", "aa cc"}
    assert "WindowGroupLimit" in plan_of(out)


def test_exact_and_shingle_leaks(spark):
    passage = "one two three four five six seven eight nine"
    train = spark.createDataFrame(
        [(1, f"Intro! {passage} and more"), (2, "nothing to see here at all in this one"), (3, None), (4, "HELLO there")],
        "doc long, text string",
    )
    held = spark.createDataFrame([(10, passage), (11, "hello, there"), (12, "quite another sentence of no use to you")], "item long, text string")
    assert [r.item for r in leakage.exact_leaks(held, train).collect()] == [11]
    assert sorted(r.item for r in leakage.exact_clean(held, train).collect()) == [10, 12]
    audit = {r.item: (r.n_shingles, r.n_leaked, r.leaked) for r in leakage.quoted_passages(held, "item", train, "doc").collect()}
    assert audit == {10: (2, 2, True), 11: (0, 0, None), 12: (1, 0, False)}
    assert [tuple(r) for r in leakage.shared_shingles(train, "doc", held, "item").collect()] == [(1, 2)]
    assert sorted(r.doc for r in leakage.without_quotes(train, "doc", held, "item").collect()) == [2, 3, 4]


def test_leaks_of_many_rows(spark):
    df = spark.range(300).select(F.col("id").alias("doc"), F.concat_ws(" ", *[F.lit(w) for w in "abcdefgh"], F.when(F.col("id") % 3 > 0, "x").otherwise("y")).alias("text"))
    held = spark.createDataFrame([(1, "b c d e f g h y")], "item long, text string")
    found = leakage.shared_shingles(df, "doc", held, "item").collect()
    assert len(found) == 100 and {r.n_shared for r in found} == {1}


def test_only_matching_shingles_leave_their_rows(spark):
    """A held-out side that Spark may not broadcast: the corpus is filtered before the one shuffle of its shingles."""
    words = [F.concat(F.lit("w"), F.translate((F.xxhash64("id", F.lit(k)) % 100_000).cast("string"), "-0123456789", "xabcdefghij")) for k in range(40)]
    corpus = spark.range(2000).select(F.col("id").alias("doc"), F.concat_ws(" ", *words).alias("text"))
    quoted = corpus.filter("doc % 100 = 7").select((F.col("doc") + 5000).alias("item"), F.substring_index("text", " ", 12).alias("text"))
    other = spark.range(300, 600).select(F.col("id").alias("item"), F.concat_ws(" ", *reversed(words)).alias("text"))
    held = quoted.union(other)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.doc: r.n_shared for r in leakage.shared_shingles(corpus, "doc", held, "item").collect()}
        wanted = leakage._hashed(leakage.shingles(held, "item"), leakage.SHINGLE_WORDS)
        met = leakage._candidates(corpus, "doc", wanted, "text", leakage.SHINGLE_WORDS)
        audit = leakage.quoted_passages(held, "item", corpus, "doc").filter("leaked").collect()
        passed, every = met.count(), leakage.shingles(corpus, "doc").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {d: 5 for d in range(7, 2000, 100)}
    assert {(r["item"], r.n_shingles, r.n_leaked) for r in audit} == {(d + 5000, 5, 5) for d in found}
    assert every == 2000 * 33 and 100 <= passed < every / 100


def test_filter_holds_its_set_even_when_full(spark):
    hashes = spark.range(400).select(F.xxhash64("id").alias("h"))
    for words in (1, 64):
        table = bit_filter.constant(bit_filter.build(hashes, "h", words))
        assert hashes.filter(bit_filter.may_hold(table, F.col("h"), words)).count() == 400
    none = bit_filter.constant(bit_filter.build(hashes.limit(0), "h", 64))
    assert hashes.filter(bit_filter.may_hold(none, F.col("h"), 64)).count() == 0
