"""Every operator over empty tables, null and odd texts, repeated rows and columns with clashing names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonelens.llm import chat, decontaminate, packing, quality, recurrent_lm, setsketch, sharding, token_spans, toxicity, url_rules

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

LONG = " ".join(f"wort{i}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, then sleeps until noon."), (2, None), (3, ""), (4, " \t\n "), (5, LONG),
    (6, "ünï çødé 漢字 \U0001f600 e\u0301 <|endoftext|> <|ENDOFTEXT|>"), (7, "tie tie tie tie tie tie tie tie tie tie tie tie"),
    (7, "tie tie tie tie tie tie tie tie tie tie tie tie"), (8, "\x00\x1c\u00a0\u2028 odd\x0bspace"), (None, "no id here at all"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (7, 1), (7, 1), (2, None), (None, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "lazy DOG"), (2, None), (3, "..."), (None, "tie tie")], "item_id long, text string")


def scored(docs):
    language, counts = recurrent_lm.fit(docs)
    return recurrent_lm.score(docs, language, counts)


#: name -> (documents, labels, benchmark items) -> result with a row per document
PER_DOCUMENT = {
    "contaminated": lambda d, y, b: decontaminate.find_items(d, b),
    "duplicates": lambda d, y, b: setsketch.near_duplicates(d),
    "toxicity": lambda d, y, b: toxicity.score(d, toxicity.fit(d, y)),
    "language model": lambda d, y, b: scored(d),
    "quality": lambda d, y, b: quality.judged(d),
    "shards": lambda d, y, b: sharding.assign_shards(d),
}
OTHERS = {
    "packing": lambda d, y, b: packing.pack(d, WORD_FILE),
    "token counts": lambda d, y, b: token_spans.tokens_by_line(d, BYTE_FILE),
    "clean": lambda d, y, b: decontaminate.keep_clean(d, b),
    "harmless": lambda d, y, b: toxicity.keep_harmless(d, toxicity.fit(d, y)),
    "distinct": lambda d, y, b: setsketch.keep_first(d),
    "good": lambda d, y, b: quality.keep_good(d),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_per_document(docs, labels, items, name):
    rows = PER_DOCUMENT[name](docs, labels, items).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(k) for k, _ in TEXTS)


@pytest.mark.parametrize("name", [*PER_DOCUMENT, *OTHERS])
def test_empty_tables(spark, docs, labels, items, name):
    run = {**PER_DOCUMENT, **OTHERS}[name]
    assert run(docs.limit(0), labels.limit(0), items.limit(0)).collect() == []
    run(docs, labels.limit(0), items.limit(0)).collect()


CLASHES = [
    "n_words", "n_hit", "items", "spans", "contaminated", "score", "predicted", "size", "shard", "slot", "text_crc32", "kept", "base_failed",
    "key", "id", "n", "row", "_h", "_size", "_part", "hit_words", "component_id", "ids", "start", "section", "_gone", "label",
    "_best", "_rank", "_offset", "_n", "_kept_score", "_kept_items", "_high", "hub",
]


@pytest.mark.parametrize("name", [*PER_DOCUMENT, *OTHERS])
def test_clashing_columns(docs, labels, items, name):
    run = {**PER_DOCUMENT, **OTHERS}[name]
    wide = docs.withColumns({c: F.lit("x") for c in CLASHES})
    found = run(wide, labels, items)
    assert found.count() == run(docs, labels, items).count()
    if name in ("clean", "harmless", "distinct", "good"):
        assert found.columns == wide.columns
        assert all(r[c] == "x" for r in found.collect() for c in CLASHES)


@pytest.mark.parametrize("name", [*PER_DOCUMENT, *OTHERS])
def test_clashing_columns_of_other_cases(docs, labels, items, name):
    run = {**PER_DOCUMENT, **OTHERS}[name]
    wide = docs.withColumns({c: F.lit("x") for c in ("Size", "Items", "Score", "SPANS", "N_Words", "Shard", "Kept", "_Rank", "_KEPT_Score", "Contaminated")})
    found = run(wide, labels, items)
    assert found.count() == run(docs, labels, items).count()
    if name in ("clean", "harmless", "distinct", "good"):
        assert found.columns == wide.columns
    if "_Rank" in found.columns:
        assert {r["_Rank"] for r in found.collect()} <= {"x"}


def test_nulls_have_the_stated_results(docs, labels, items):
    found = {r["doc_id"]: r for r in decontaminate.find_items(docs, items).collect()}
    assert (found[2]["n_words"], found[2]["items"], found[2]["contaminated"]) == (0, [], False)
    assert found[1]["items"] == ["1"] and found[1]["spans"][0]["start"] == TEXTS[0][1].index("lazy")
    assert found[7]["items"] == ["null"] and found[7]["n_hit"] == 12
    twins = {r["doc_id"]: r for r in setsketch.near_duplicates(docs).collect()}
    assert twins[2]["n_shingles"] == 0 and twins[2]["component_id"] == 2 and twins[3]["kept"]
    assert twins[None]["component_id"] is None and twins[None]["kept"]
    judged = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert judged[2]["n_words"] == 0 and judged[2]["base_failed"] and judged[7]["n_repeat_words"] == 12
    assert judged[5]["kept"] and not judged[3]["kept"]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert scores[2] == scores[3] == min(scores.values())
    shards = {r["doc_id"]: r for r in sharding.assign_shards(docs).collect()}
    assert (shards[2]["size"], shards[2]["text_crc32"], shards[3]["size"]) == (1, 0, 1)


def test_urls(spark):
    rules = [("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x", "allow"), (None, "/", "block"), ("", "", "block")]
    urls = [
        (1, "http://A.com/xyz?q#f"), (2, None), (3, "no scheme"), (4, "x://b.a.com/xa"), (4, "x://b.a.com/xa"), (5, "http://com"),
        (6, "http://c.com/?://d"), (None, "://.com/" + "z" * 5000), (7, "a\nb://a.com/\nx"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(0) for c in ("host", "verdict", "_k", "_best", "action")})
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = {(r["page_id"], r["host"], r["path"][:5], r["rule"], r["verdict"]) for r in url_rules.judge(pages, table).collect()}
    assert got == {
        (1, "a.com", "/xyz", "a.com/x", "block"), (2, "", "", "", "block"), (3, "", "", "", "block"), (4, "b.a.com", "/xa", "a.com/x", "block"),
        (5, "com", "", None, "allow"), (6, "c.com", "/", "com/", "allow"), (None, ".com", "/zzzz", "com/", "allow"), (7, "a.com", "/\nx", "com/", "allow"),
    }
    assert url_rules.judge(pages, table).count() == len(urls)
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, table.limit(0), default="block").collect()} == {"block"}


def test_chats(spark):
    turns = [(1, 0, "user", None), (1, 1, "bot", "x"), (1, 1, "bot", "x"), (None, None, None, ""), (2, 5, "assistant", "<|im_end|>"), (2, None, "system", "s")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "part", "pos", "run", "tie", "cost")})
    rows = chat.format_chats(table).collect()
    assert len(rows) == len(turns)
    text = {c: "".join(r["fragment"] for r in sorted(rows, key=lambda r: r["position"]) if r["conv_id"] == c) for c in (1, 2, None)}
    assert text[2] == "<|im_start|>user\ns<|im_end|>\n<|im_start|>assistant\n< |im_end|><|im_end|>\n"  # relabelling costs 2, inserting 3
    assert text[None].count("<|im_start|>") == 2
    assert chat.format_chats(table.limit(0)).collect() == []


def test_pipeline_stages_keep_the_columns(spark, docs, labels, items, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, str(tmp_path))
        assert wide.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, wide, str(tmp_path)).select(F.countDistinct("doc_id")).first()[0] == wide.count()
    assert {r["doc_id"] for r in wide.collect()} <= {1, 5}


def test_scoring_toxicity_holds_the_words_of_one_text_at_a_time():
    """Memory of a task beyond its batch: 10 MB of text in 4 000 rows stay under 60 MB."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql import types as T

    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(20_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 420)]) for _ in range(4_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    docs = SimpleNamespace(columns=batch.schema.names, schema=schema, mapInArrow=lambda run, _: run)
    model = toxicity.Model({b"w1": 3.0, b"w22": 1.0}, -3.0, (-1.0, 0.5, 0.5), (0.0, 1.0), None)
    run = toxicity.score(docs, model)
    tracemalloc.start()
    scores = [s for out in run(iter([batch])) for s in out.column("score").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = [s for i in (0, 1999, 3999) for out in run(iter([batch.slice(i, 1)])) for s in out.column("score").to_pylist()]
    assert len(scores) == len(texts) and np.allclose([scores[i] for i in (0, 1999, 3999)], alone, rtol=1e-9)
    assert peak < 60e6, peak
