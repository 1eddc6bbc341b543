import random

from pyspark.sql import functions as F

from tonelens.operators import experiments, metrics


def frame(spark, rows):
    return spark.createDataFrame([(i, f"t{i}", *r) for i, r in enumerate(rows)], "row_id long, text string, label int, prediction int, prob double")


def brute_auc(rows):
    pos = [p for y, _, p in rows if y == 1]
    neg = [p for y, _, p in rows if y != 1]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_is_exact(spark):
    rng = random.Random(3)
    many = [(rng.randint(0, 1), 0, rng.random() ** 8) for _ in range(600)]  # scores crowd near zero
    tied = [(rng.randint(0, 1), 0, rng.choice([0.1, 0.2, 0.2, 0.7])) for _ in range(200)]
    for rows in (many, tied):
        for buckets in (2, 16, 1024):
            assert abs(metrics.roc_auc(frame(spark, rows), buckets=buckets).first().auc - brute_auc(rows)) < 1e-12
    assert metrics.roc_auc(frame(spark, [(1, 0, 0.5), (0, 0, 0.5), (0, 0, 0.5)])).first().auc == 0.5
    assert metrics.roc_auc(frame(spark, [(1, 0, 0.5), (1, 0, 0.7)])).first().auc is None


def test_binary_metrics_with_empty_denominators(spark):
    never = metrics.evaluate_binary(frame(spark, [(1, 0, 0.1), (0, 0, 0.2)])).first()
    assert (never.accuracy, never.precision, never.recall, never.f1, never.auc) == (0.5, 0.0, 0.0, 0.0, 0.0)
    some = metrics.evaluate_binary(frame(spark, [(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1), (0, 0, 0.0)])).first()
    assert (some.n, some.accuracy, some.precision, some.recall, some.f1) == (5, 0.6, 0.5, 0.5, 0.5)
    assert metrics.binary_metrics(frame(spark, [(1, 1, 0.0)]).limit(0)).first().accuracy == 0.0


def test_confusion_and_report_keep_all_labels(spark):
    rows = [("Sincere", "Sincere"), ("Sincere", "Sarcastic"), ("Gaslighting", "Sarcastic"), ("Sarcastic", "Sarcastic")]
    df = spark.createDataFrame([("x", t, p, 0.51239) for t, p in rows], "text string, t string, p string, c double")
    m = metrics.confusion_matrix(df, "t", "p").orderBy("label_no").collect()
    assert [tuple(r)[2:] for r in m] == [(1, 1, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0), (0, 1, 0, 0)]
    rep = {r.label: r for r in metrics.per_class_report(df, "t", "p").collect()}
    assert (rep["Sarcastic"].precision, rep["Sarcastic"].recall, rep["Sarcastic"].support) == (1 / 3, 1.0, 1)
    assert (rep["Passive-Aggressive"].f1, rep["Passive-Aggressive"].weak, rep["Sincere"].weak) == (0.0, True, False)
    s = metrics.report_summary(df, "t", "p").first()
    assert s.accuracy == 0.5 and abs(s.macro_f1 - (2 / 3 + 0.5) / 4) < 1e-12 and s.support == 4
    assert metrics.per_example(df, "text", "t", "p", "c").filter("correct").first().confidence == 0.5124


def test_error_table_ranks_by_wrong_confidence(spark):
    df = frame(spark, [(1, 0, 0.2), (0, 1, 0.9), (1, 1, 0.99), (1, 0, 0.05), (0, 1, 0.9)])
    out = metrics.error_table(df, 3).collect()
    assert [(r.row_id, r.confidence) for r in out] == [(3, 0.05), (1, 0.9), (4, 0.9)]
    assert metrics.error_table(df.filter(F.col("label") == F.col("prediction"))).count() == 0


def test_comparison_has_one_row_per_model(spark):
    df = frame(spark, [(1, 1, 0.9), (0, 0, 0.123456)])
    out = metrics.model_comparison({"a": df, "b": df.withColumn("prediction", F.lit(0))}).orderBy("model").collect()
    assert [(r.model, r.accuracy, r.auc) for r in out] == [("a", 1.0, 1.0), ("b", 0.5, 1.0)]


def test_rows_without_a_score(spark):
    rows = [(0, 0.1, 0), (1, 0.9, 1), (0, 0.2, 0), (1, 0.8, 1), (1, None, None), (1, None, None), (None, 0.4, 0)]
    got = metrics.evaluate_binary(spark.createDataFrame(rows, "label int, prob double, prediction int")).first()
    assert (got.n, got.n_scored, got.accuracy, got.precision, got.recall, got.auc) == (6, 4, 4 / 6, 1.0, 0.5, 1.0)
    assert got.f1 == 2 * 2 / (2 * 2 + 2)


def test_external_scores_keep_every_test_row(spark):
    test = spark.createDataFrame([(i, i % 2) for i in range(10)], "row_id long, label int")
    scores = spark.createDataFrame([(i, float(i % 2)) for i in range(4)], "row_id long, prob double")
    got = metrics.evaluate_binary(experiments.external_predictions(test, scores)).first()
    assert (got.n, got.n_scored, got.accuracy) == (10, 4, 0.4)
