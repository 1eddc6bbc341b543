import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import plan_of
from tonelens.operators import experiments, models, sampling, tfidf
from tonelens.plans import ranking
from tonelens.plans.workdir import work_path

TEXTS = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "Café cat's café", "", "unique words only here", None]


def brute_tfidf(texts, max_features=50_000):
    docs = []
    for t in texts:
        k = re.findall(r"\w+", (t or "").lower().replace("é", "e"))
        docs.append(Counter(k + [f"{a} {b}" for a, b in zip(k, k[1:])]))
    tf, df = Counter(), Counter()
    for d in docs:
        tf.update(d)
        df.update(d.keys())
    kept = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[:max_features]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in sorted(kept)}
    out = {}
    for i, d in enumerate(docs):
        w = {t: (1 + math.log(d[t])) * idf[t] for t in d if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): x / norm for t, x in w.items()})
    return idf, tf, df, out


def texts_table(spark):
    return spark.createDataFrame([(i, t, i % 2, "train") for i, t in enumerate(TEXTS)], "row_id long, text string, label int, split string")


@pytest.mark.parametrize("cap", [3, 50_000])
def test_tfidf_agrees_with_brute_force(spark, cap):
    df = texts_table(spark)
    vocabulary = tfidf.fit_vocabulary(df, max_features=cap)
    idf, tf, dfreq, weights = brute_tfidf(TEXTS, cap)
    rows = vocabulary.orderBy("idx").collect()
    assert [r.term for r in rows] == list(idf) and [r.idx for r in rows] == list(range(len(idf)))
    assert all(r.tf == tf[r.term] and r.df == dfreq[r.term] and abs(r.idf - idf[r.term]) < 1e-12 for r in rows)
    got = {(r.row_id, r.term): r.weight for r in tfidf.transform_long(df, vocabulary).collect()}
    assert got.keys() == weights.keys() and all(abs(got[k] - weights[k]) < 1e-12 for k in got)


def test_features_are_a_projection(spark):
    df = texts_table(spark)
    vocabulary = tfidf.fit_vocabulary(df)
    assert "Exchange" not in plan_of(tfidf.with_features(df, vocabulary))
    assert "Exchange hashpartitioning" not in plan_of(tfidf.transform_long(df, vocabulary))
    assert tfidf.transform_long(df, vocabulary.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 40, 99, 100, 500])
def test_first_rows_of_a_large_order(spark, n):
    df = spark.range(100).select(F.concat(F.lit("t"), (F.col("id") * 37 % 100).cast("string")).alias("term"))
    assert sorted(r.term for r in ranking.first_by(df, n, "term").collect()) == sorted(f"t{i}" for i in range(100))[:n]


def test_feature_table_reads_back_as_vectors(spark):
    features = models.build_features(texts_table(spark))
    again = models.load_features(spark, features.path)
    rows = {r.row_id: r.features for r in again.split("train").collect()}
    assert len(rows) == len(TEXTS) and rows[4].numNonzeros() == 0 and rows[6].numNonzeros() == 0
    assert all(abs(v.norm(2) - 1) < 1e-9 for i, v in rows.items() if v.numNonzeros())
    assert again.split("test").count() == 0


def words_corpus(spark, n=240):
    good = F.element_at(F.array(*map(F.lit, ("calm river", "green tree", "open field"))), (F.col("id") % 3 + 1).cast("int"))
    bad = F.element_at(F.array(*map(F.lit, ("loud siren", "red alarm"))), (F.col("id") % 2 + 1).cast("int"))
    label = (F.col("id") % 4 == 0).cast("int")
    df = spark.range(n).select(
        F.col("id").alias("row_id"), F.concat_ws(" ", F.when(label == 1, bad).otherwise(good), F.lit("common words")).alias("text"), label.alias("label")
    )
    return sampling.three_way_split(df)


def test_training_end_to_end(spark):
    features = models.build_features(words_corpus(spark))
    external = features.split("test").select("row_id", F.col("label").cast("double").alias("prob"))
    result = experiments.train_all(features, external, folds=3, grid_c=[0.1, 10.0], max_iter=50)
    rows = {r.model: r for r in result.comparison.collect()}
    assert rows["Naive Baseline"].f1 == 0.0 and rows["Naive Baseline"].auc == 0.5
    assert rows["TF-IDF + LR"].f1 > 0.95 and rows["External"].accuracy == 1.0
    top = result.top_features.collect()
    assert top[0]["rank"] == 1 and {"loud", "siren", "red", "alarm", "loud siren", "red alarm"} >= {r.positive_term for r in top[:2]}
    assert result.errors["Naive Baseline"].count() == 5
    assert result.confusion["TF-IDF + LR"].count() == 2

    path = work_path(spark, "classifier")
    result.classifier.save(spark, path)
    loaded = models.TextClassifier.load(spark, path)
    test = features.split("test")
    a = [r.prob for r in result.classifier.transform(test).orderBy("row_id").collect()]
    b = [r.prob for r in loaded.transform(test).orderBy("row_id").collect()]
    assert a == b and loaded.params == result.classifier.params

    curve = experiments.learning_curve(features, fractions=[0.2, 1.0], grid_c=[1.0], grid_penalty=["l2"], max_iter=20).collect()
    n_train = features.split("train").count()
    assert [(r.model, r.fraction, r.n_samples) for r in curve] == [
        ("Naive Baseline", 0.2, math.ceil(0.2 * n_train)), ("Naive Baseline", 1.0, n_train),
        ("TF-IDF + LR", 0.2, math.ceil(0.2 * n_train)), ("TF-IDF + LR", 1.0, n_train),
    ]


def test_fits_use_no_more_tasks_than_cores(spark, monkeypatch):
    """However many rows there are: each task of each iteration sends a whole gradient."""
    monkeypatch.setattr(models, "ROWS_PER_TASK", 2)
    seen, fit = [], models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    data = [(i, i % 2, Vectors.sparse(3, [(i % 2, 1.0), (2, i / 64)])) for i in range(64)]
    train = spark.createDataFrame(data, ["row_id", "label", "features"]).repartition(16)
    classifier = models.TextClassifier.fit(train, folds=2, grid_c=[1.0, 10.0], grid_penalty=["l2"], max_iter=5)
    assert classifier.params["cv_f1"] == 1.0 and seen == [4] * 5
    monkeypatch.undo()
    assert models.fit_layout(14_000, 12, 8) == (2, 8) and models.fit_layout(1_000_000, 12, 8) == (12, 2)


def test_majority_and_weights(spark):
    df = spark.createDataFrame([(i, l) for i, l in enumerate([0, 0, 1, 1, 2])], "row_id long, label int")
    m = models.MajorityModel.fit(df)
    assert (m.majority, m.share) == (0, 0.4)  # the smaller class wins the tie
    path = work_path(spark, "majority")
    m.save(spark, path)
    assert models.MajorityModel.load(spark, path) == m
    assert m.transform(df).first().prob == 0.0
    weights = {r.label: r.weight for r in models.with_class_weights(df).collect()}
    assert weights == {0: 5 / 6, 1: 5 / 6, 2: 5 / 3}


def test_external_scorers(spark):
    def make_prob():
        return lambda texts: np.array([len(t) / 100 for t in texts])

    def make_logits():
        return lambda texts: np.array([[0.0, float(len(t))] for t in texts])

    df = spark.createDataFrame([(i, "x" * i) for i in range(130)], "row_id long, text string").repartition(3)
    assert all(r.prob == r.row_id / 100 for r in models.score_text(df, make_prob).collect())
    assert all(r.logits == [0.0, float(r.row_id)] for r in models.score_logits(df, make_logits, 2).collect())


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_optimality_of_a_stored_fit(spark, penalty):
    """Against the conditions written out in numpy; a model that was pushed off its optimum shows it."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((240, 12)) < 0.4, rng.random((240, 12)), 0.0)
    y = (x[:, 0] + 0.3 * rng.random(240) > x[:, 1] + 0.4).astype(int)
    data = [(i, int(y[i]), Vectors.sparse(12, [(j, float(x[i, j])) for j in np.flatnonzero(x[i])])) for i in range(240)]
    train = spark.createDataFrame(data, ["row_id", "label", "features"])
    fitted = models.TextClassifier.fit(train, grid_c=[1.0], grid_penalty=[penalty])
    path = work_path(spark, "certified")
    fitted.save(spark, path)
    loaded = models.TextClassifier.load(spark, path)
    predictions = [{r.row_id: (r.prediction, r.prob) for r in m.transform(train).collect()} for m in (fitted, loaded)]
    assert predictions[0] == predictions[1]
    got = models.optimality(loaded, train).first()
    b, n = fitted.model.coefficients.toArray(), len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    error = w * (1 / (1 + np.exp(-(x @ b + fitted.model.intercept))) - y) / n
    g = x.T @ error
    if penalty == "l1":
        breach = np.where(b == 0, np.maximum(np.abs(g) - 1 / n, 0), np.abs(g + np.sign(b) / n))
    else:
        breach = np.abs(g + b / n)
    want = max(breach.max(), abs(error.sum()))
    start = max(np.abs(x.T @ (w * (0.5 - y) / n)).max(), abs((w * (0.5 - y)).sum() / n))
    assert abs(got["violation"] - want) < 1e-9 and abs(got["start"] - start) < 1e-9
    assert got["violation"] < 0.02 * got["start"]
    wrong = models.TextClassifier(fitted.model, fitted.params | {"C": 0.01})
    assert models.optimality(wrong, train).first()["violation"] > 0.1 * got["start"]


def test_weights_are_not_shuffled_to_their_terms(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b a c"), (3, "")], "row_id int, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = tfidf.transform_long(docs, tfidf.fit_vocabulary(docs))
        plan = plan_of(long)
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert {(r["row_id"], r["term"]) for r in long.collect()} == {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "b a"), (1, "b a")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
