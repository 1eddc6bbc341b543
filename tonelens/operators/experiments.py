"""Train and compare all models; learning curve over training-set sizes."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from tonelens.functions.scores import threshold_label
from tonelens.operators.metrics import METRICS, confusion_matrix, error_table, evaluate_binary, model_comparison
from tonelens.operators.models import FeatureSet, MajorityModel, TextClassifier, fit_layout
from tonelens.operators.sampling import SEED, stratified_subsample

# Training fractions of the learning curve and the fold rule.
FRACTIONS = [0.10, 0.20, 0.30, 0.50, 0.75, 1.00]
SMALL_FRACTION = 0.2
FOLDS = 5
FOLDS_SMALL = 3

#: Most fractions of a learning curve that run side by side: the driver holds the plans of each.
SIDE_BY_SIDE = 2

External = DataFrame | Callable[[DataFrame], DataFrame] | None

BASELINE = "Naive Baseline"
LINEAR = "TF-IDF + LR"
EXTERNAL = "External"


@dataclass
class TrainingResult:
    """Everything a training run leaves behind, as tables and fitted models."""

    comparison: DataFrame
    scored: dict[str, DataFrame]
    confusion: dict[str, DataFrame]
    errors: dict[str, DataFrame]
    top_features: DataFrame
    majority: MajorityModel
    classifier: TextClassifier
    notes: dict[str, float] = field(default_factory=dict)


def external_predictions(test: DataFrame, scores: DataFrame) -> DataFrame:
    """Test rows with a caller's probabilities ``(row_id, prob)``; at one half and above the class is 1.

    Every test row stays: one that the caller did not score has a null prediction, which the metrics count as wrong.
    """
    joined = test.join(scores.select("row_id", "prob"), "row_id", "left")
    return joined.withColumn("prediction", threshold_label(F.col("prob")))


def train_all(features: FeatureSet, external: External = None, folds: int = FOLDS, n_errors: int = 5, **fit_args) -> TrainingResult:
    """Fit the baseline and the linear classifier on the train split and evaluate every model on the test split.

    ``external`` is a table ``(row_id, prob)`` for the test rows, or a function that makes one from them.
    """
    train, test = features.split("train"), features.split("test")
    majority = MajorityModel.fit(train)
    classifier = TextClassifier.fit(train, folds, **fit_args)
    plain = test.drop("features")
    scored = {BASELINE: majority.transform(plain), LINEAR: classifier.transform(test).drop("features")}
    if external is not None:
        scored[EXTERNAL] = external_predictions(plain, external(plain) if callable(external) else external)
    return TrainingResult(
        comparison=model_comparison(scored),
        scored=scored,
        confusion={m: confusion_matrix(df, "label", "prediction", [0, 1]) for m, df in scored.items()},
        errors={m: error_table(df, n_errors) for m, df in scored.items()},
        top_features=classifier.top_features(features.vocabulary),
        majority=majority,
        classifier=classifier,
        notes={"cv_f1": classifier.params["cv_f1"]},
    )


def learning_curve(
    features: FeatureSet,
    external: dict[float, DataFrame] | None = None,
    fractions: list[float] | None = None,
    seed: int = SEED,
    **fit_args,
) -> DataFrame:
    """Model x fraction x (n_samples, five metrics) on the fixed test split, ordered by model and fraction.

    Vocabulary and document frequencies stay those of the full train split at every fraction.  ``external`` maps a
    fraction to the probabilities of a scorer that was trained on that much data.  Fractions run side by side as far as
    their fits do not keep the cores busy.
    """
    train, test = features.split("train"), features.split("test")
    plain = test.drop("features")
    spark = train.sparkSession

    def point(f: float) -> list[tuple]:
        sub = stratified_subsample(train, f, seed=seed)
        n = sub.count()
        folds = FOLDS_SMALL if f <= SMALL_FRACTION else FOLDS
        scored = {
            BASELINE: MajorityModel.fit(sub).transform(plain),
            LINEAR: TextClassifier.fit(sub, folds, seed=seed, **fit_args).transform(test),
        }
        if external and f in external:
            scored[EXTERNAL] = external_predictions(plain, external[f])
        return [(name, f, n, *evaluate_binary(df).select(*METRICS).first()) for name, df in scored.items()]

    wanted = sorted(fractions or FRACTIONS, reverse=True)  # the longest first
    _, at_once = fit_layout(train.count(), spark.sparkContext.defaultParallelism, min(len(wanted), SIDE_BY_SIDE))
    with ThreadPoolExecutor(at_once) as pool:
        rows = [row for found in pool.map(inheritable_thread_target(spark)(point), wanted) for row in found]
    schema = ", ".join(["model string, fraction double, n_samples long", *(f"{m} double" for m in METRICS)])
    return spark.createDataFrame(rows, schema).orderBy("model", "fraction")
