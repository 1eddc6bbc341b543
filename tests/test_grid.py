import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tonelens.functions import logistic
from tonelens.operators import experiments, grid, models, sampling

COLUMNS = 30


def arrays(n=400):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((n, COLUMNS)) < 0.2, rng.random((n, COLUMNS)), 0.0)
    x[::50] = 0.0  # rows without any known term
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.random(n) > x[:, 2] + 0.45).astype(int)
    return x, y


@pytest.fixture(scope="module")
def train(spark):
    x, y = arrays()
    data = [(i, int(y[i]), Vectors.sparse(COLUMNS, [(j, float(x[i, j])) for j in np.flatnonzero(x[i])])) for i in range(len(y))]
    return spark.createDataFrame(data, ["row_id", "label", "features"]).repartition(3)


def blocks_of(x, y, fold):
    counts = np.count_nonzero(x, axis=1)
    return list(logistic.cut_blocks(fold, y.astype(float), np.ones(len(y)), counts, np.nonzero(x)[1], x[x != 0]))


@pytest.mark.parametrize("penalty", ["l1", "l2"])
@pytest.mark.parametrize("c", [0.1, 10.0])
def test_a_fit_is_at_its_optimum(monkeypatch, penalty, c):
    """Against the optimality conditions written out densely; blocks of a few rows give the same sums as one block."""
    x, y = arrays()
    fold = np.arange(len(y)) % 4
    rows = fold != 2
    fit = logistic.Fit(2, penalty, 1.0 / (c * rows.sum()), float((y[rows] == 0).sum()), float((y[rows] == 1).sum()))
    w = logistic.solve(fit, blocks_of(x, y, fold), COLUMNS, 1000, 1e-7)
    monkeypatch.setattr(logistic, "BLOCK_ENTRIES", 16)
    small = blocks_of(x, y, fold)
    assert len(small) > 50 and np.abs(logistic.solve(fit, small, COLUMNS, 1000, 1e-7) - w).max() < 1e-3
    b = w[:-1]
    error = (1 / (1 + np.exp(-(x[rows] @ b + w[-1]))) - y[rows]) / rows.sum()
    g = x[rows].T @ error
    breach = np.abs(g + fit.strength * b)
    if penalty == "l1":
        breach = np.where(b == 0, np.maximum(np.abs(g) - fit.strength, 0), np.abs(g + fit.strength * np.sign(b)))
    assert max(breach.max(), abs(error.sum())) < 2e-5


def test_one_class_leaves_the_intercept(monkeypatch):
    search = logistic.minimise(logistic.Fit(0, "l2", 0.1, 0.0, 5.0), 2, 10, 1e-4)
    with pytest.raises(StopIteration) as done:
        next(search)
    assert list(done.value.value) == [0.0, 0.0, np.inf]


def test_all_ways_agree_with_separate_fits(spark, train, monkeypatch):
    """Whole fits in tasks and joint passes give the scores of Spark ML's separate fits; passes are shared by the fits."""
    points, folds, n = [(c, p) for c in (0.1, 1.0, 10.0) for p in ("l1", "l2")], 3, train.count()
    rows = sampling.stratified_folds(models.with_class_weights(train), folds).withColumn("label", F.col("label").cast("double")).persist()
    got = {}
    got["tasks"] = models.cross_validate(rows, points, folds, n, 200, 2)
    passes, sums = [], grid._sums
    monkeypatch.setattr(grid, "_sums", lambda s, b, folds, w: passes.append(len(folds)) or sums(s, b, folds, w))
    monkeypatch.setattr(grid, "TASK_ENTRIES", 100)
    got["passes"] = models.cross_validate(rows, points, folds, n, 200, 2)
    assert passes[0] == len(points) * folds and passes[-1] < passes[0] and len(passes) < sum(passes) / 3
    monkeypatch.setattr(grid, "DRIVER_NUMBERS", 4 * grid.COPIES["l2"] * (COLUMNS + 1))
    got["groups of passes"] = models.cross_validate(rows, points, folds, n, 200, 2)
    monkeypatch.undo()
    monkeypatch.setattr(models, "ROWS_PER_TASK", 2)
    want = models.cross_validate(rows, points, folds, n, 200, 2)
    for way, f1 in got.items():
        assert len(f1) == len(points) * folds and np.abs(np.array(f1) - np.array(want)).max() < 0.02, way
    assert np.abs(np.array(got["tasks"]) - np.array(got["passes"])).max() < 1e-9 and got["passes"] == got["groups of passes"]
    rows.unpersist()


def test_small_grids_make_one_spark_ml_fit(spark, train, monkeypatch):
    """No job per iteration: only the chosen point is fitted by Spark ML, once a fraction of the curve."""
    seen, fit = [], models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, df: seen.append(1) or fit(self, df))
    split = train.withColumns({"split": F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"), "text": F.lit("")})
    features = models.FeatureSet(spark.createDataFrame([], "term string, idx int"), split, "")
    curve = experiments.learning_curve(features, fractions=[0.5, 1.0], max_iter=50)
    assert len(seen) == 2
    rows = [(r.model, r.fraction, r.n_samples) for r in curve.collect()]
    assert rows == [(m, f, n) for m in ("Naive Baseline", "TF-IDF + LR") for f, n in ((0.5, 160), (1.0, 320))]
