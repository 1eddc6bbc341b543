"""Evaluation of any scorer: binary metrics, exact AUC, confusion, per-class report, errors, comparison tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tonelens.operators.lexicon import LABELS, label_dimension
from tonelens.plans.workdir import materialise

# Acceptance marks.
PASS_MARK = 0.70
WEAK_F1 = 0.4

METRICS = ["accuracy", "precision", "recall", "f1", "auc"]


def _ratio(num: Column, den: Column) -> Column:
    """0 when there is nothing to divide by."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def score_table(df: DataFrame, label: str = "label", prediction: str | None = "prediction", prob: str | None = "prob") -> DataFrame:
    """Confusion cells per distinct score: the only pass over the scored rows (map-side sums, one shuffle).

    A row without a prediction counts as a wrong one for class 0: it is in ``n``, and in ``fn`` if its class is 1, but
    not in ``n_scored``.  Rows without a label are left out.
    """
    y = F.col(label)
    p = F.col(prediction) if prediction else F.lit(0)
    score = F.col(prob).cast("double") if prob else F.lit(None).cast("double")
    return df.filter(y.isNotNull()).groupBy(score.alias("s")).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y != 1) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & ~p.eqNullSafe(F.lit(1))).alias("fn"),
        F.count_if(y == p).alias("hit"),
        F.count("*").alias("n"),
        F.count(p).alias("n_scored"),
        F.count_if(y == 1).alias("pos"),
        F.count_if(y != 1).alias("neg"),
    )


def _metrics_of(table: DataFrame) -> DataFrame:
    sums = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "hit", "n", "n_scored")])
    c = F.col
    return sums.select(
        c("n"),
        c("n_scored"),
        _ratio(c("hit"), c("n")).alias("accuracy"),
        _ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        _ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
    )


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy, precision, recall, f1 of class 1 in one row; 0 where there is nothing to divide by.

    ``n`` rows have a label, ``n_scored`` of them a prediction; one without is a wrong prediction, not a missing row.
    """
    return _metrics_of(score_table(df, label, prediction, None))


def _auc_of(by_score: DataFrame, buckets: int) -> DataFrame:
    """Exact area under the ROC curve from the score table (which is read several times, so it is a stored one).

    The distinct scores are cut into ranges of about equal size (by their quantiles), so that the running count of
    negatives is taken within ranges in parallel; the ranges' own totals (at most ``buckets`` rows) supply the
    offsets.  The cut points only balance the work: the result is exact for any.
    """
    by_score = by_score.filter(F.col("s").isNotNull())
    quantiles = F.percentile_approx("s", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10_000)
    found = by_score.select(quantiles.alias("q")).first()["q"] or []
    splits = [float("-inf"), *sorted(set(found)), float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="s", outputCol="r", handleInvalid="keep").transform(by_score)
    within = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per_range = (
        ranged.withColumn("below", F.coalesce(F.sum("neg").over(within), F.lit(0)))
        .groupBy("r")
        .agg(
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("area"),
            F.sum("pos").alias("rp"),
            F.sum("neg").alias("rn"),
        )
    )
    across = Window.partitionBy().orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    total = per_range.withColumn("offset", F.coalesce(F.sum("rn").over(across), F.lit(0))).agg(
        F.sum(F.col("area") + F.col("rp") * F.col("offset")).alias("area"),
        F.sum("rp").alias("p"),
        F.sum("rn").alias("n"),
    )
    return total.select((F.col("area") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))


def roc_auc(df: DataFrame, label: str = "label", prob: str = "prob", buckets: int = 1024) -> DataFrame:
    """Exact area under the ROC curve over the rows that have a score, equal scores counted half; null when one class
    is missing."""
    table = score_table(df, label, None, prob).select("s", "pos", "neg")
    return _auc_of(materialise(table, "scores"), buckets)


def evaluate_binary(df: DataFrame, label: str = "label", prediction: str = "prediction", prob: str = "prob", buckets: int = 1024) -> DataFrame:
    """The five metrics in one row; the scored rows are read once."""
    table = materialise(score_table(df, label, prediction, prob), "scores")
    return _metrics_of(table).withColumn("auc", _auc_of(table, buckets).scalar())


def model_comparison(scored: dict[str, DataFrame], label: str = "label", prediction: str = "prediction", prob: str = "prob") -> DataFrame:
    """One row per model, metrics to four places."""
    rows = [
        evaluate_binary(df, label, prediction, prob).select(
            F.lit(name).alias("model"), *[F.round(m, 4).alias(m) for m in METRICS]
        )
        for name, df in scored.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def confusion_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    """The pre-aggregated (true, predicted) table behind the multi-class reports."""
    return df.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: list | None = None) -> DataFrame:
    """Rows are true labels, columns predicted ones; every label has its row and column."""
    labels = LABELS if labels is None else labels
    spark = df.sparkSession
    cells = confusion_counts(df, true, pred)
    by_true = cells.groupBy("true_label").agg(
        *[F.coalesce(F.sum(F.when(F.col("pred_label") == l, F.col("n"))), F.lit(0)).alias(f"pred_{l}") for l in labels]
    )
    rows = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], ["label_no", "true_label"])
    return rows.join(by_true, "true_label", "left").na.fill(0).select(
        "label_no", "true_label", *[f"pred_{l}" for l in labels]
    )


def per_class_report(df: DataFrame, true: str, pred: str, labels: list | None = None) -> DataFrame:
    """precision, recall, f1, support, weak-class flag per label."""
    labels = LABELS if labels is None else labels
    cells = confusion_counts(df, true, pred)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("true_label").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                F.struct(F.col("pred_label").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")),
            )
        ).alias("e"),
        "n",
        (F.col("true_label") == F.col("pred_label")).cast("int").alias("hit"),
    )
    sums = sides.groupBy(F.col("e.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("e.t")).alias("support"),
        F.sum(F.col("n") * F.col("e.p")).alias("predicted"),
        F.sum(F.col("n") * F.col("e.t") * F.col("hit")).alias("tp"),
    )
    spark = df.sparkSession
    rows = spark.createDataFrame([(l,) for l in labels], ["label"])
    c = F.col
    report = rows.join(sums, "label", "left").na.fill(0, ["support", "predicted", "tp"])
    return report.select(
        "label",
        _ratio(c("tp"), c("predicted")).alias("precision"),
        _ratio(c("tp"), c("support")).alias("recall"),
        _ratio(2 * c("tp"), c("support") + c("predicted")).alias("f1"),
        "support",
    ).withColumn("weak", c("f1") < WEAK_F1)


def report_summary(df: DataFrame, true: str, pred: str, labels: list | None = None) -> DataFrame:
    """Overall accuracy and unweighted means over the labels."""
    report = per_class_report(df, true, pred, labels)
    macro = report.agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.sum("support").alias("support"),
    )
    hits = df.agg(_ratio(F.count_if(F.col(true) == F.col(pred)), F.count("*")).alias("a"))
    return macro.withColumn("accuracy", hits.scalar())


def with_label_names(df: DataFrame, label_id: str, name: str) -> DataFrame:
    """Label id to label name; the dimension has four rows."""
    dim = label_dimension(df.sparkSession).select(F.col("label_id").alias("_id"), F.col("label").alias(name))
    return df.join(F.broadcast(dim), F.col(label_id) == F.col("_id"), "left").drop("_id")


def per_example(df: DataFrame, text: str, true: str, pred: str, confidence: str) -> DataFrame:
    """Text, true and predicted label, confidence to four places, correct or not."""
    return df.select(
        F.col(text).alias("text"),
        F.col(true).alias("true_label"),
        F.col(pred).alias("pred_label"),
        F.round(confidence, 4).alias("confidence"),
        (F.col(true) == F.col(pred)).alias("correct"),
    )


def evaluation_report(df: DataFrame, text: str, true: str, pred: str, confidence: str, labels: list | None = None) -> dict[str, DataFrame]:
    """The evaluation as tables: ``summary``, ``per_class``, ``confusion``, ``per_example``."""
    return {
        "summary": report_summary(df, true, pred, labels),
        "per_class": per_class_report(df, true, pred, labels),
        "confusion": confusion_matrix(df, true, pred, labels),
        "per_example": per_example(df, text, true, pred, confidence),
    }


def errors(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.filter(F.col(label) != F.col(prediction))


def error_table(
    df: DataFrame,
    n: int = 5,
    key: str = "row_id",
    text: str = "text",
    label: str = "label",
    prediction: str = "prediction",
    prob: str = "prob",
) -> DataFrame:
    """The n errors with the highest confidence in the wrong class; ``confidence`` stays P(class 1)."""
    wrong = F.when(F.col(prediction) == 1, F.col(prob)).otherwise(1.0 - F.col(prob))
    return (
        errors(df, label, prediction)
        .orderBy(wrong.desc(), F.col(key))
        .limit(n)
        .select(
            F.col(key),
            F.col(text).alias("text"),
            F.col(label).alias("true_label"),
            F.col(prediction).alias("predicted_label"),
            F.col(prob).alias("confidence"),
        )
    )


def pass_rate(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """total, correct, accuracy to four places and the verdict; no rows give no verdict row."""
    totals = df.agg(F.count("*").alias("total"), F.count_if(F.col(expected) == F.col(predicted)).alias("correct"))
    scored = totals.filter(F.col("total") > 0).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 4))
    return scored.withColumn("verdict", F.when(F.col("accuracy") >= PASS_MARK, "PASS").otherwise("FAIL"))


def stress_results(df: DataFrame, expected: str = "expected", label: str = "label", confidence: str = "confidence") -> DataFrame:
    """Per sample: expected and predicted label, confidence, passed or not, from analysed messages."""
    return df.select(
        "text",
        F.col(expected).alias("expected"),
        F.col(label).alias("predicted"),
        F.col(confidence).alias("confidence"),
        (F.col(expected) == F.col(label)).alias("passed"),
    )
