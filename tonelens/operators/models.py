"""Classifiers: majority baseline, TF-IDF + logistic regression with grid search, and any external scorer."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tonelens.functions.logistic import Fit
from tonelens.operators import grid as grids
from tonelens.operators.metrics import binary_metrics
from tonelens.operators.sampling import SEED, stratified_folds, stratified_subsample
from tonelens.operators.tfidf import fit_vocabulary, read_features, with_features, write_features
from tonelens.plans.sizing import MAX_CLASSES, collect_bounded
from tonelens.plans.workdir import work_path

# The hyper-parameter grid, in the order ties are resolved, and the iteration limit.
GRID_C = [0.01, 0.1, 1.0, 10.0]
GRID_PENALTY = ["l1", "l2"]
MAX_ITER = 1000
TOLERANCE = 1e-4

#: Every iteration is a job: below this many rows per task its overhead outweighs the gradient work.
ROWS_PER_TASK = 8000

SCORE_BATCH = 64


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c): one row per class."""
    whole = Window.partitionBy()
    return (
        df.groupBy(label)
        .agg(F.count("*").alias("n"))
        .withColumn("weight", F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")))
    )


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` to every row.  The number of classes is checked, then the table is broadcast."""
    rows = collect_bounded(class_weights(df, label).select(label, "weight"), MAX_CLASSES, "classes")
    schema = T.StructType([df.schema[label], T.StructField("weight", T.DoubleType())])
    table = df.sparkSession.createDataFrame([tuple(r) for r in rows], schema)
    return df.join(F.broadcast(table), label)


def majority_class(df: DataFrame, label: str = "label") -> DataFrame:
    """The most frequent class (the smaller one on ties) and its share."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("majority"),
        (F.max("n") / F.sum("n")).alias("share"),
    )


@dataclass
class MajorityModel:
    """Always predicts the class that was most frequent in training."""

    majority: int
    share: float

    @staticmethod
    def fit(df: DataFrame, label: str = "label") -> "MajorityModel":
        row = majority_class(df, label).first()
        return MajorityModel(int(row["majority"]), float(row["share"]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``prob`` (1.0 or 0.0 for class 1)."""
        return df.withColumns(
            {"prediction": F.lit(self.majority), "prob": F.lit(1.0 if self.majority == 1 else 0.0)}
        )

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.majority, self.share)], "majority int, share double").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "MajorityModel":
        row = spark.read.parquet(path).first()
        return MajorityModel(row["majority"], row["share"])


def logistic(c: float, penalty: str, n: int, max_iter: int = MAX_ITER) -> LogisticRegression:
    """Logistic regression for inverse regularisation strength ``c``.

    The summed loss with penalty 1/C becomes an averaged loss with penalty 1/(C n).  The intercept is not
    penalised.
    """
    return LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        elasticNetParam=1.0 if penalty == "l1" else 0.0,
        regParam=1.0 / (c * n),
        standardization=False,
        maxIter=max_iter,
        tol=TOLERANCE,
    )


def fit_layout(n: int, cores: int, parallelism: int) -> tuple[int, int]:
    """Tasks of a fit over ``n`` rows, and how many fits run side by side.

    A task sends a gradient as long as the vocabulary whatever its rows are, so there are no more tasks than cores.  A fit
    keeps a copy of its rows, so fits run side by side only as far as they are needed to keep the cores busy.
    """
    tasks = max(1, min(math.ceil(n / ROWS_PER_TASK), cores))
    return tasks, max(1, min(parallelism, math.ceil(2 * cores / tasks)))


def cross_validate(rows: DataFrame, grid: list[tuple[float, str]], folds: int, n: int, max_iter: int, at_once: int) -> list[float]:
    """F1 of class 1 on every left-out fold of ``rows(label, weight, fold, features)``: the folds of one grid point after another's.

    Where all rows fit a task and would not keep the cores busy, a task makes a whole fit: no job per iteration.  Where there are
    more entries than a task may hold, all fits share one copy of the rows and one pass an iteration.  Both minimise what
    :func:`logistic` does, to its tolerance.  Else, and for other labels than 0 and 1, fits are Spark ML's, side by side.
    """
    spark = rows.sparkSession
    counted = collect_bounded(grids.extent(rows), MAX_CLASSES, "folds and classes")
    in_fold = {k: sum(r["n"] for r in counted if r["fold"] == k) for k in range(folds)}
    size, entries = max((r["size"] for r in counted), default=0), sum(r["entries"] for r in counted)
    jobs = [(c, penalty, k) for c, penalty in grid for k in range(folds)]
    fits_a_task = entries <= grids.TASK_ENTRIES
    small = fits_a_task and n <= ROWS_PER_TASK * spark.sparkContext.defaultParallelism
    if {r["label"] for r in counted} <= {0.0, 1.0} and (small or not fits_a_task):
        held = {k: [sum(r["weight"] for r in counted if r["fold"] != k and r["label"] == c) for c in (0.0, 1.0)] for k in range(folds)}
        fits = [Fit(k, penalty, 1.0 / (c * (n - in_fold[k])), *held[k]) for c, penalty, k in jobs]
        return (grids.f1_in_tasks if small else grids.f1_in_passes)(rows, fits, size, max_iter, TOLERANCE)

    def held_out_f1(job: tuple[float, str, int]) -> float:
        c, penalty, k = job
        model = logistic(c, penalty, n - in_fold[k], max_iter).fit(data.filter(F.col("fold") != k))
        return binary_metrics(model.transform(data.filter(F.col("fold") == k))).first()["f1"]

    data = rows.persist()
    try:
        with ThreadPoolExecutor(at_once) as pool:  # independent Spark jobs, all folds and points in one queue
            return list(pool.map(inheritable_thread_target(spark)(held_out_f1), jobs))
    finally:
        data.unpersist()


def top_coefficients(coefficients: DataFrame, n: int = 20) -> DataFrame:
    """The n terms of the highest and of the lowest ``coefficient``, ties alphabetical, side by side by rank."""

    def side(name: str, order: Column) -> DataFrame:
        ranked = F.row_number().over(Window.partitionBy().orderBy(order, "term"))
        best = coefficients.orderBy(order, "term").limit(n)
        return best.select(ranked.alias("rank"), F.col("term").alias(f"{name}_term"), F.col("coefficient").alias(f"{name}_coefficient"))

    up, down = side("positive", F.col("coefficient").desc()), side("negative", F.col("coefficient").asc())
    return up.join(down, "rank").orderBy("rank")


@dataclass
class TextClassifier:
    """A fitted logistic regression on TF-IDF features, with the hyper-parameters the grid search chose."""

    model: LogisticRegressionModel
    params: dict[str, Any]

    @staticmethod
    def fit(
        train: DataFrame,
        folds: int = 5,
        grid_c: list[float] | None = None,
        grid_penalty: list[str] | None = None,
        max_iter: int = MAX_ITER,
        parallelism: int = 8,
        seed: int = SEED,
        max_rows: int | None = None,
    ) -> "TextClassifier":
        """Grid search by cross-validated F1 of class 1 over ``train(row_id, label, features)``, refit on all rows.

        A grid of one point is fitted once, without folds, and has no cross-validated F1.  ``max_rows`` bounds the
        labelled rows of the fit, the first ones in a random order of their ids; by default all are used.
        Balanced class weights; folds are exact, stratified and reproducible.  Equal scores go to the first grid
        point (C outer, penalty inner).
        """
        spark = train.sparkSession
        grid = [(c, p) for c in (grid_c or GRID_C) for p in (grid_penalty or GRID_PENALTY)]
        n = train.count()
        if max_rows is not None and n > max_rows:
            train = stratified_subsample(train, max_rows / n, seed=seed)
            n = train.count()
        weighted = with_class_weights(train.select("row_id", "label", "features")).withColumn("label", F.col("label").cast("double"))
        tasks, at_once = fit_layout(n, spark.sparkContext.defaultParallelism, parallelism)
        params: dict[str, Any] = {"C": grid[0][0], "penalty": grid[0][1], "cv_f1": None, "n": n}
        if len(grid) > 1:
            folded = stratified_folds(weighted, folds, seed=seed).coalesce(tasks)
            f1 = cross_validate(folded, grid, folds, n, max_iter, at_once)
            scores = [sum(f1[i * folds : (i + 1) * folds]) / folds for i in range(len(grid))]
            best = max(range(len(grid)), key=lambda i: scores[i])
            params |= {"C": grid[best][0], "penalty": grid[best][1], "cv_f1": float(scores[best])}
        chosen = logistic(params["C"], params["penalty"], n, max_iter).fit(weighted.coalesce(tasks))
        return TextClassifier(chosen, params)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (a probability of exactly one half is class 0) and ``prob`` of class 1."""
        scored = self.model.transform(df.withColumn("label", F.col("label").cast("double")) if "label" in df.columns else df)
        out = scored.withColumn("prob", F.get(vector_to_array("probability"), F.lit(1))).withColumn(
            "prediction", F.col("prediction").cast("int")
        )
        out = out.drop("rawPrediction", "probability")
        return out.withColumn("label", F.col("label").cast("int")) if "label" in df.columns else out

    def coefficients(self, vocabulary: DataFrame) -> DataFrame:
        """``(term, coefficient)`` for the whole vocabulary, which is bounded."""
        values = [(i, float(v)) for i, v in enumerate(self.model.coefficients.toArray())]
        table = vocabulary.sparkSession.createDataFrame(values, "idx int, coefficient double")
        return vocabulary.select("term", "idx").join(F.broadcast(table), "idx").select("term", "coefficient")

    def top_features(self, vocabulary: DataFrame, n: int = 20) -> DataFrame:
        """The n terms that speak most for and against class 1, side by side by rank."""
        return top_coefficients(self.coefficients(vocabulary), n)

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(self.params),)], "params string").write.parquet(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextClassifier":
        params = json.loads(spark.read.parquet(f"{path}/params").first()["params"])
        return TextClassifier(LogisticRegressionModel.load(f"{path}/model"), params)


def optimality(classifier: TextClassifier, train: DataFrame) -> DataFrame:
    """How far a fit on ``train(row_id, label, features)`` is from the optimum: one row ``(violation, start)``.

    ``violation`` is the largest breach of the optimality conditions over all terms and the intercept: gradient plus
    penalty gradient where that exists, what the gradient has beyond the penalty at an L1 weight of zero.  ``start`` is the
    largest gradient at weights of zero, the measure of it.  One pass: gradients are summed by term, each task its own first.
    """
    c, penalty = classifier.params["C"], classifier.params["penalty"]
    n = train.count()
    strength = F.lit(1.0 / (c * n))
    truth, weight = F.col("label").cast("double"), F.col("weight")
    rows = classifier.transform(with_class_weights(train.select("row_id", "label", "features"))).select(
        (weight * (F.col("prob") - truth) / n).alias("e"), (weight * (0.5 - truth) / n).alias("s"), F.unwrap_udt("features").alias("v")
    )
    long = rows.select("e", "s", F.inline(F.arrays_zip(F.col("v.indices").alias("idx"), F.col("v.values").alias("x"))))
    gradients = long.groupBy("idx").agg(F.sum(F.col("e") * F.col("x")).alias("g"), F.sum(F.col("s") * F.col("x")).alias("s"))
    values = [(i, float(b)) for i, b in enumerate(classifier.model.coefficients.toArray())]
    weights = train.sparkSession.createDataFrame(values, "idx int, b double")
    zero = F.lit(0.0)
    g, b = F.coalesce("g", zero), F.col("b")
    breach = F.abs(g + strength * b)
    if penalty == "l1":
        breach = F.when(b == 0, F.greatest(F.abs(g) - strength, zero)).otherwise(F.abs(g + strength * F.signum(b)))
    terms = weights.join(gradients, "idx", "left").select(breach.alias("breach"), F.abs(F.coalesce("s", zero)).alias("start"))
    intercept = rows.agg(F.abs(F.sum("e")).alias("breach"), F.abs(F.sum("s")).alias("start"))
    return terms.union(intercept).agg(F.max("breach").alias("violation"), F.max("start").alias("start"))


@dataclass
class FeatureSet:
    """The vocabulary fitted on the training split and the feature table of all splits."""

    vocabulary: DataFrame
    rows: DataFrame
    path: str

    def split(self, name: str) -> DataFrame:
        """One split; a partition of the stored table."""
        return self.rows.filter(F.col("split") == name)


def build_features(corpus: DataFrame, path: str | None = None, **vocabulary_args) -> FeatureSet:
    """Fit on ``split = 'train'`` of ``corpus(row_id, text, label, split)``, transform every split, store, read back."""
    spark = corpus.sparkSession
    path = path or work_path(spark, "features")
    ngram = vocabulary_args.get("ngram")
    fit_vocabulary(corpus.filter(F.col("split") == "train"), **vocabulary_args).write.parquet(f"{path}/vocabulary")
    vocabulary = read_vocabulary(spark, path)
    rows = with_features(corpus.select("row_id", "text", "label", "split"), vocabulary, **({"ngram": ngram} if ngram else {}))
    write_features(rows, f"{path}/rows", "split")
    return load_features(spark, path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, idx int, tf long, df long, idf double").parquet(f"{path}/vocabulary")


def featurise(df: DataFrame, vocabulary: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """New rows ``(key, text)`` with the feature vectors of a fitted vocabulary, by way of a stored table."""
    spark = df.sparkSession
    path = work_path(spark, "new-features")
    write_features(with_features(df.select(key, text), vocabulary, text), path)
    return read_features(spark, path, [df.schema[key], df.schema[text]])


def load_features(spark: SparkSession, path: str) -> FeatureSet:
    """A stored feature table and its vocabulary."""
    columns = [
        T.StructField("row_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
    return FeatureSet(read_vocabulary(spark, path), read_features(spark, f"{path}/rows", columns), path)


def score_text(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable],
    text: str = "text",
    out: str = "prob",
    batch_size: int = SCORE_BATCH,
) -> DataFrame:
    """Probability of class 1 from a caller-supplied model, in Arrow batches.

    ``make_predict_fn`` runs once per Python worker (load the model there) and returns a function from an array of
    ``batch_size`` texts to an array of probabilities.
    """
    scorer = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size)
    return df.withColumn(out, scorer(F.col(text)))


def score_logits(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable],
    n_labels: int,
    text: str = "text",
    out: str = "logits",
    batch_size: int = 16,
) -> DataFrame:
    """Class logits from a caller-supplied model: an array of ``n_labels`` doubles per row."""
    scorer = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.withColumn(out, scorer(F.col(text)))
