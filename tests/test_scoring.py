import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tonelens.catalog.oracles import _q, _scored
from tonelens.functions import gram_index, scores as S
from tonelens.functions.sql import register_functions
from tonelens.operators import messages, metrics
from tonelens.operators.lexicon import DEFAULT_LEXICON, DEFAULT_PATTERNS, LABELS, Lexicon
from tonelens.sources.samples import STRESS_SAMPLES, expectation_sample, labelled_sample, with_extra

SENTENCES = [t for t, _ in STRESS_SAMPLES] + [
    "Nice weather today.", "Fine, whatever.", "I never said that. You always do this!", "You're so sensitive, can't you take a joke?",
    "If you say so... must be nice, whatever you want.", "Thank you, I appreciate it. Honestly.", "fine. ", "Sure, sure. Do whatever you want.",
    "It's all about you and your fault; you need therapy", "oh wow wow, what a great idea", "", "No one else agrees. Everyone thinks you're crazy",
    "i guess obviously oh great", "I'm sorry, I hear you. Let's talk. you're paranoid",
]


def messages_table(spark):
    return spark.createDataFrame([(i, s, None if i % 3 == 0 else (i % 7) / 6.0) for i, s in enumerate(SENTENCES)], "id long, text string, p double")


def test_golden_rows(spark):
    df = spark.createDataFrame([(1, "Nice weather today.", None), (2, "Fine, whatever.", None), (3, "Fine, whatever.", 0.9)], "id long, text string, p double")
    one, two, three = messages.analyse_messages(df, prob="p").orderBy("id").collect()
    assert (one.label, one.confidence, one.severity, one.pattern_highlights) == ("Sincere", 1.0, "low", [])
    assert (two.label, two.score_passive, two.score_sincere, two.severity) == ("Passive-Aggressive", 0.7407, 0.2593, "high")
    assert two.pattern_highlights == ["whatever", "fine, "]
    assert (three.method, three.score_passive, three.score_sarcastic, three.score_sincere, three.score_gaslighting) == ("passive", 0.7477, 0.2329, 0.0194, 0.0)
    assert three.severity == "high"


@pytest.mark.parametrize("prob", [None, "p"])
def test_default_lexicon_agrees_with_sql(spark, prob):
    got = messages.score_messages(messages_table(spark), prob=prob).orderBy("id")
    cols = ["id", "gl_pattern", "pa_pattern", "sa_pattern", *S.SCORE_COLS.values(), "label", "confidence", "severity"]
    values = ", ".join(f"({i}, {_q(s)}, {'NULL' if i % 3 == 0 else (i % 7) / 6.0}::DOUBLE)" for i, s in enumerate(SENTENCES))
    sql = f"WITH src(id, text, p) AS (VALUES {values}), {_scored('src', DEFAULT_LEXICON, prob)} SELECT {', '.join(cols)} FROM scored ORDER BY id"
    want = duckdb.sql(sql).fetchall()
    for g, w in zip(got.select(cols).collect(), want, strict=True):
        assert [round(v, 9) if isinstance(v, float) else v for v in g] == [round(v, 9) if isinstance(v, float) else v for v in w]


def test_pattern_hits_and_highlights_agree_with_python(spark):
    rows = messages.with_highlights(messages.score_messages(messages_table(spark))).collect()
    for r in rows:
        t = r.text.lower()
        for label, col in (("Gaslighting", "gl_pattern"), ("Passive-Aggressive", "pa_pattern"), ("Sarcastic", "sa_pattern")):
            ps = DEFAULT_PATTERNS[label]
            assert r[col] == sum(bool(re.search(p, t)) for p in ps) / len(ps)
        found = [m.group(0) for l in ("Gaslighting", "Passive-Aggressive", "Sarcastic") for p in DEFAULT_PATTERNS[l] if (m := re.search(p, t))]
        assert r.pattern_highlights == list(dict.fromkeys(found))[:5]


def test_required_literals_are_necessary():
    words = sorted({w for ps in DEFAULT_PATTERNS.values() for p in ps for w in re.findall(r"[a-z']+", p)})
    rng = random.Random(1)
    for _ in range(4000):
        text = rng.choice([" ", ", ", "  "]).join(rng.choices(words, k=6))
        for ps in DEFAULT_PATTERNS.values():
            for p in ps:
                if re.search(p, text):
                    assert any(s in text for s in S.required_literals(p))
    assert S.required_literals("a|b*") is None and S.required_literals("(?i)abc") is None
    assert S.required_literals("x{0,2}yz") == ["yz"] and S.required_literals("(") is None


def test_ties_follow_the_method(spark):
    df = spark.createDataFrame([("rules",), ("gaslighting",), ("passive",), ("model",)], "m string")
    cols = {l: F.lit(0.25) for l in LABELS}
    assert [r[0] for r in df.select(S.top_label(cols, F.col("m"))).collect()] == ["Sincere", "Gaslighting", "Passive-Aggressive", "Sarcastic"]


def test_indexed_keywords_agree_with_literal_ones(spark):
    df = messages_table(spark)
    cols = ["id", "gl_keywords", "pa_keywords", "sa_keywords", "si_keywords"]
    literal = messages.keyword_hits(df).select(cols)
    indexed = messages.keyword_hits_indexed(df, DEFAULT_LEXICON, "id").select(cols)
    assert sorted(map(tuple, literal.collect())) == sorted(map(tuple, indexed.collect()))


@pytest.mark.parametrize("n", [100, 400, 600, 5000])
def test_long_lexicons_give_the_same_hits_by_both_methods(spark, n):
    words = [f"w{i}x" for i in range(n - 3)]
    lexicon = Lexicon(keywords={"Sincere": [*words, "w5x", "", "q"], "Sarcastic": ["one", "é"]})
    texts = spark.createDataFrame([(1, f"W5x w{n - 4}x w5x w{n}x"), (2, "none"), (3, None), (4, "Q?"), (5, "É")], "id long, text string")
    found = {}
    for how in (None, "id"):
        rows = messages.evidence(texts, lexicon, indexed_by=how).collect()
        found[how] = sorted((r.id, r.si_keywords, r.sa_keywords, r.gl_keywords) for r in rows)
    assert found[None] == found["id"] == [(1, 2, 0, 0), (2, 0, 1, 0), (3, 0, 0, 0), (4, 1, 0, 0), (5, 0, 1, 0)]


def test_lexicon_round_trip_and_dimension(spark):
    assert Lexicon.from_dataframe(DEFAULT_LEXICON.to_dataframe(spark)) == DEFAULT_LEXICON
    with pytest.raises(ValueError):
        Lexicon.from_dataframe(spark.createDataFrame([("Other", "regex", 0, "x")], "label string, kind string, ord int, pattern string"))


def test_scoring_is_a_projection(spark):
    plan = plan_of(messages.score_messages(messages_table(spark), prob="p"))
    assert "Exchange" not in plan and "Python" not in plan


def test_ranked_scores_and_fallback(spark):
    scored = messages.score_messages(messages_table(spark))
    rows = messages.ranked_scores(scored, ["id"]).filter("id = 10").orderBy("rank").collect()
    assert [r.label for r in rows] == ["Sincere", "Sarcastic", "Passive-Aggressive", "Gaslighting"] and rows[0].score == 1.0
    keys = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    strong = spark.createDataFrame([(1, 0.5)], "id long, prob double")
    weak = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, prob double")
    out = messages.predicted_polarity(messages.best_available(keys, {"strong": strong, "weak": weak}, "id")).orderBy("id").collect()
    assert [(r.prob, r.model_used) for r in out] == [(0.5, "strong"), (0.2, "weak"), (None, None)]
    assert (out[0].polarity, out[0].confidence_text, out[1].polarity, out[1].confidence_text) == ("SARCASTIC", "50.0%", "NOT SARCASTIC", "80.0%")


def test_stress_samples(spark):
    extra = spark.createDataFrame([("Thank you, I appreciate it.", "Sincere")], "text string, expected string")
    sample = with_extra(expectation_sample(spark, STRESS_SAMPLES), extra)
    scored = messages.score_messages(sample)
    verdict = metrics.pass_rate(scored, "expected", "label").first()
    assert verdict.total == 11 and verdict.correct == metrics.stress_results(scored).filter("passed").count()
    assert verdict.verdict == ("PASS" if verdict.accuracy >= 0.7 else "FAIL")
    assert metrics.pass_rate(scored.limit(0), "expected", "label").count() == 0
    assert labelled_sample(spark, [("a", 3), ("b", 0)]).orderBy("row_id").collect()[0].label == "Gaslighting"


def test_sql_functions(spark):
    register_functions(spark)
    messages_table(spark).createOrReplaceTempView("msgs")
    got = spark.sql(
        "SELECT id, clean_text(text) c, pattern_score(text, 'Passive-Aggressive') pa, keyword_hits(text, 'Sarcastic') k, "
        "rule_score(text, 'Sincere') si, rule_score(text, 'Gaslighting') gl, severity(0.5, 'Sarcastic') s FROM msgs ORDER BY id"
    ).collect()
    want = messages.score_messages(messages_table(spark)).orderBy("id").collect()
    for g, w in zip(got, want, strict=True):
        assert (g.pa, g.k, g.si, g.gl, g.s) == (w.pa_pattern, w.sa_keywords, w.score_sincere, w.score_gaslighting, "medium")


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0, 0.0],)], "x array<double>")
    rows = df.select(S.softmax(F.col("x")).alias("p"), S.argmax(F.col("x")).alias("a")).collect()
    assert [r.a for r in rows] == [1, 0] and abs(sum(rows[0].p) - 1) < 1e-12 and rows[1].p[0] == 1.0


def test_indexed_patterns_agree_with_compiled_ones(spark):
    lexicon = Lexicon(
        patterns={"Gaslighting": [r"never (said|did)\b", r"\w+ing\b", "imagin", "(?i)CRAZY"], "Sarcastic": ["oh+ (wow|great)", r"^\s*sure"]},
        keywords={},
    )
    texts = [(1, "You never said that, you are imagining things"), (2, "ohhh great, SURE"), (3, None), (4, ""), (5, " sure, oh wow crazy"), (5, "é"), (6, "never dide")]
    df = spark.createDataFrame(texts, "id int, text string").withColumns({"_found": F.lit(1), "_T": F.lit(2)})
    cols = ["id", "gl_pattern", "pa_pattern", "sa_pattern", "_found", "_T"]
    compiled = messages.pattern_scores(df.drop("_T"), lexicon).withColumn("_T", F.lit(2)).select(cols)
    indexed = messages.pattern_scores_indexed(df, lexicon)
    assert sorted(map(str, compiled.collect())) == sorted(map(str, indexed.select(cols).collect()))
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_scores_as_a_struct_hold_all_evidence_once(spark):
    register_functions(spark)
    spark.createDataFrame([(1, "You're crazy, you're imagining things"), (2, "oh wow thank you")], "id int, text string").createOrReplaceTempView("struct_msgs")
    df = spark.sql("SELECT id, s.* FROM (SELECT id, message_scores(text) AS s FROM struct_msgs)")
    want = messages.evidence(spark.table("struct_msgs"))
    got = {r["id"]: (r["gaslighting_keywords"], r["sincere_keywords"], round(r["gaslighting_patterns"], 9)) for r in df.collect()}
    assert got == {r["id"]: (r["gl_keywords"], r["si_keywords"], round(r["gl_pattern"], 9)) for r in want.collect()}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("you're imagining") == 1


@pytest.mark.parametrize("widest", [64, 1])
def test_index_finds_every_literal_that_a_text_has(spark, monkeypatch, widest):
    """Beginnings of each other, literals longer than they are filed, odd characters; tried or intersected."""
    monkeypatch.setattr(gram_index, "WIDEST", widest)
    words = ["a", "ab", "abc", "abcdef", "abcdefgh", "bc", "x.y", "[z]", "é\U0001f600", "\U0001f600a", "long " * 6, "long " * 5 + "z", "b" * 24, "b" * 30]
    texts = ["abcdefg", "xab abcdefgh", "x.yx[z]", "x1y é\U0001f600ab", "long " * 8, "long " * 5 + "zz", "b" * 29, "b" * 31, "", None, "é z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    found = gram_index.found(F.col("t"), [gram_index.Entry(w, 3, i) for i, w in enumerate(words)])
    rows = df.select("id", F.sort_array(F.transform(found, lambda e: e["number"])).alias("n")).collect()
    assert {r["id"]: r["n"] for r in rows} == {i: [n for n, w in enumerate(words) if w in (t or "")] for i, t in enumerate(texts)}


def test_index_looks_up_words_and_not_every_gram(spark):
    """Texts of a few letters have the grams of all words: only whole words may open a bucket."""
    plan = spark.createDataFrame([("x",)], "t string").select(gram_index.found(F.col("t"), [gram_index.Entry("person", 0, 0), gram_index.Entry("personal", 0, 1)]))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "{6}" not in text and "array_intersect" not in text


def test_literal_first_patterns_are_equal(spark):
    patterns = [
        r"\bcat", r"(?:^|[^a-z])cat(?:s|ed)?(?:$|[^a-z])", r"[^a-z]cats+ (a|b)", r"[ ,]cat's?\b", r"(?:^|[^a-z])ca*t", r"\bcat|dog", r"\bcat(x|y|)(?=,)",
        r"\bca{2}t", r"\b(cat)\1", r"\bcat[|)]", r"(?:^|[^a-z])cat$", r"\Bcat",
    ]
    rng = random.Random(4)
    pieces = ["cat", "cats", "cated", " ", ",", "é", "caat", "c", "\U0001f600", "dog", "'s", "x", "a", ")", "\n", "catcat", " cats a"]
    texts = [("".join(rng.choices(pieces, k=rng.randint(0, 14))),) for _ in range(1500)]
    df = spark.createDataFrame(texts, "t string")
    turned = [S.literal_first(p) for p in patterns]
    assert sum(a != b for a, b in zip(patterns, turned, strict=True)) == 9
    for before, after in zip(patterns, turned, strict=True):
        hits = df.select(F.col("t").rlike(S.unicode_pattern(before)).alias("a"), F.col("t").rlike(S.unicode_pattern(after)).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in hits), (before, after)
        assert any(r["a"] for r in hits), before
