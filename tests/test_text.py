import unicodedata

from pyspark.sql import functions as F

from tonelens.functions import text as X
from tonelens.operators import cleaning, profiling

ODD = [
    "Hello, World!", "123 !!!", "http://x.y z", "awwww no", "awww no", "see http://a b ok", "don't  STOP\tnow\n", "", "   ",
    "Ünïcode café", "WWW.Site.com/page rest", "it's 5 o'clock", "a b", "https://x", "İstanbul",
]


#: ODD cleaned by hand.
CLEAN = [
    "hello world", "", "z", "a no", "awww no", "see b ok", "don't stop now", "", "", "n code caf", "rest", "it's o'clock", "a b", "",
    "i stanbul",
]


def test_clean_text(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, s string")
    assert [r.c for r in df.select("i", X.clean_text(F.col("s")).alias("c")).orderBy("i").collect()] == CLEAN


def test_word_count_strip_and_accents(spark):
    df = spark.createDataFrame([(s,) for s in ODD], "s string")
    rows = df.select("s", X.word_count(F.col("s")).alias("n"), X.strip_blanks(F.col("s")).alias("t")).collect()
    assert [(r.s, r.n, r.t) for r in rows] == [(s, len(s.split()), s.strip()) for s in ODD]
    plain = spark.createDataFrame([("crème brûlée ñandú straße é",)], "s string")
    assert plain.select(X.strip_accents(F.col("s"))).first()[0] == "creme brulee nandu straße e"


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("Don't stop the Café the end",), ("a",), ("",)], "s string")
    tokens = df.select(X.word_tokens(F.col("s")).alias("t"))
    assert tokens.first().t == ["don", "t", "stop", "the", "cafe", "the", "end"]
    grams = [r[0] for r in tokens.select(X.ngram_range(F.col("t"), 1, 2)).collect()]
    assert grams[0][7:] == ["don t", "t stop", "stop the", "the cafe", "cafe the", "the end"]
    assert grams[1:] == [["a"], []]
    content = df.select(X.content_tokens(F.col("s"), ["the"]).alias("t"))
    assert content.first().t == ["don", "stop", "café", "end"]  # stop words go before bigrams form
    assert content.select(X.ngrams(F.col("t"), 2)).first()[0] == ["don stop", "stop café", "café end"]


def test_preparation_order_and_first_label(spark):
    rows = [
        (5, "Same Text!", 0), (2, "same text", 1), (3, None, 1), (4, "x", None), (6, "123", 1), (7, "456", 0), (8, "other", 0),
    ]
    df = spark.createDataFrame(rows, "id long, t string, l int")
    out = cleaning.prepare_corpus(df, "t", "l", "id")
    want = {(2, "same text", 1), (8, "other", 0)}
    assert {tuple(r) for r in out.collect()} == want
    assert {tuple(r) for r in cleaning.prepare_corpus(df.repartition(7), "t", "l", "id").collect()} == want
    assert cleaning.fill_missing_text(df, "t").filter("t = ''").count() == 1


def test_dedup_and_duplicate_count_with_one_dominant_text(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    out = cleaning.dedup_keep_first(df)
    assert out.count() == 2001 and out.filter("text = 'hot'").first().row_id == 0
    assert tuple(cleaning.duplicate_count(df).first()) == (3000, 2001, 999)
    assert tuple(cleaning.duplicate_count(df.limit(0)).first()) == (0, 0, 0)


def test_compatibility_forms(spark):
    odd = ["ﬁne ŉ ǆ", "𝐁𝐨𝐥𝐝 𝔘", "e\u0301a\u0308\u0323", "½ ℃ ㎏ ™", "ΐ Ἄ", "plain", "①②", "ﷺ", "ñ ß", "\U0001f600"]
    df = spark.createDataFrame([(t,) for t in odd], "s string")
    want = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in odd]
    assert [r[0] for r in df.select(X.strip_accents(F.col("s"))).collect()] == want


def test_default_stop_words(spark):
    df = spark.createDataFrame([(1, "The cat and the hat")], "label int, text string")
    assert sorted(r.term for r in profiling.top_ngrams(df).collect()) == ["cat", "hat"]
