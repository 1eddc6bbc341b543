"""Language of texts on held-out rows and odd inputs; phrases against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tonelens.llm import language, phrases

SF = "/root/testdata/sf0.001"
CLASHES = ("score", "Lang_Pred", "ACCEPTED", "judged", "h", "y", "t", "n", "f", "word", "ids", "id", "rank", "Phrase", "best", "part")


# -- language ---------------------------------------------------------------------------------------------------

def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    vectors, layer, bias = rng.normal(size=(50, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    sizes, y = np.array([3, 5, 4]), np.array([0, 2, 1])
    buckets = np.array([1, 1, 7, 7, 8, 9, 9, 9, 1, 2, 3, 49])
    loss, (touched, rows), of_layer, of_bias = language.loss_and_slopes(vectors, layer, bias, buckets, sizes, y)
    for array, slopes in ((layer, of_layer), (bias, of_bias), (vectors, dict(zip(touched, rows, strict=True)))):
        for at in [(9, 1), (1, 0), (49, 3)] if array is vectors else [(0, 1), (3, 2)] if array is layer else [(2,)]:
            moved = array.copy()
            moved[at] += 1e-6
            args = [moved if x is array else x for x in (vectors, layer, bias)]
            slope = (language.loss_and_slopes(*args, buckets, sizes, y)[0] - loss) / 1e-6
            assert slope == pytest.approx(slopes[at[0]][at[1]] if array is vectors else slopes[at], abs=1e-4)


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = entry.queries()["op12_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["lang"] and r["n"] and r["n"] >= 40]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(3)
    true = rng.normal(size=(20_000, 3)) * 2
    p = language.softmax(true)
    y = np.array([rng.choice(3, p=q) for q in p])
    temperature, floor = language.calibrated(true * 4, y, precision=0.9)
    assert temperature == pytest.approx(4, rel=0.15)
    best = language.softmax(true * 4 / temperature)
    sure = best.max(axis=1) >= floor
    assert 0.88 <= (best.argmax(axis=1) == y)[sure].mean() <= 0.93 and 0.1 < sure.mean() < 1


def test_odd_texts_have_the_stated_language(spark):
    texts = [(1, "the cat and the dog " * 30, "en"), (2, "der Hund und die Katze " * 30, "de"), (3, "the dog and the cat ran " * 20, "en"), (4, "die Katze und der Hund lief " * 20, "de")]
    learnt = spark.createDataFrame([*texts, (5, None, "fr"), (6, "sans nom", None), (7, "", "fr")], "doc_id long, text string, lang string")
    model = language.fit(learnt)
    asked = [(1, None), (2, ""), (3, "12 345 !?"), (4, "dog"), (4, "dog"), (5, "KATZE" * 40_000), (6, "the " * 100_000), (None, "und die")]
    wide = spark.createDataFrame(asked, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})
    out = language.predict(wide, model)
    rows = [(r["doc_id"], r["lang_pred"], r["score"]) for r in out.collect()]
    assert sorted(map(str, (r[0] for r in rows))) == sorted(str(k) for k, _ in asked)
    found = {k: (lang, score) for k, lang, score in rows}
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[4][0] == found[6][0] == "en" and found[5][0] == found[None][0] == "de"
    assert {"h", "judged", "Phrase"} <= set(out.columns)
    assert language.predict(wide.limit(0), model).collect() == []
    nothing = language.fit(learnt.limit(0))
    assert {(r["lang_pred"], r["score"], r["accepted"]) for r in language.predict(wide, nothing).collect()} == {("und", 0.0, False)}


# -- phrases ----------------------------------------------------------------------------------------------------

def _plain(rows, least, longest=5):
    """(lang, phrase) -> (a, l, r, n, score), in order, by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in (("und" if x is None else x, t) for x, t in rows):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {p: c for p, c in f.items() if c >= least}
    out = {}
    for (lang, p), a in often.items():
        if len(p) > 1:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    for (lang, p), a in often.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if a >= often[lang, p[i : i + size]]:
                    out.pop((lang, p[i : i + size]), None)
    return {(lang, " ".join(p)): v for (lang, p), v in sorted(out.items(), key=lambda x: (x[0][0], -x[1][4], -x[1][0], " ".join(x[0][1]).encode()))}


def _found(df):
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in sorted(df.collect(), key=lambda r: (r["lang"], r["rank"]))}


@pytest.mark.parametrize(("words", "trie"), [(500_000, 250_000), (40, 60)])
def test_phrases_are_those_of_plain_counting(spark, monkeypatch, words, trie):
    """Also with dictionaries and tries so small that several passes are needed."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    monkeypatch.setattr(phrases, "WORD_BLOCK", words)
    monkeypatch.setattr(phrases, "TRIE_PHRASES", trie)
    monkeypatch.setattr(phrases, "HELD_WORDS", 1000)
    least = 12 if trie > 60 else 80
    want = _plain([tuple(r) for r in docs.collect()], least)
    got = _found(phrases.collocations(docs.repartition(3), least=least))
    assert got == want and list(got) == list(want) and len(want) > 10


def test_odd_texts_have_the_stated_phrases(spark):
    rows = [
        (None, "A b\tA  b. A b"), ("x", None), ("x", ""), ("x", "a a a a a"), ("x", "a a a a a"), ("é", "\x00 \x1c\x00 \x1c"), ("x", "ä ß " * 60_000),
        ("", "q.q.q.q q"), ("", "Q q\x0bq Q"),
    ]
    table = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in CLASHES})
    got = _found(phrases.collocations(table, least=2))
    assert got == _plain(rows, 2)
    assert got["x", "a a a a a"][0] == 2 and got["", "q q"][0] == 3 and got["und", "a b"][0] == 3
    assert phrases.collocations(table.limit(0), least=2).collect() == []
    assert {r["rank"] for r in phrases.collocations(table, least=2, top=1).collect()} == {1}


def test_trie_counts_like_a_dictionary():
    rng = np.random.default_rng(2)
    flat = np.append((rng.zipf(1.3, 50_000) % 900).astype(np.int32), 0)
    for size in (2, 3, 5):
        seen = Counter(tuple(flat[i : i + size].tolist()) for i in range(len(flat) - size))
        some = [p for p in seen if 0 not in p][::3] + [(901,) * size]
        _, which = phrases.Trie(np.array(some)).find(flat)
        assert np.bincount(which, minlength=len(some)).tolist() == [seen.get(p, 0) for p in some]
