"""The stages of the batch job as plain functions: prepare, train, experiment, predict, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tonelens.functions.text import clean_text
from tonelens.operators.cleaning import prepare_corpus
from tonelens.operators.experiments import EXTERNAL, LINEAR, External, TrainingResult, learning_curve, train_all
from tonelens.operators.messages import best_available, predicted_polarity
from tonelens.operators.models import TextClassifier, build_features, featurise, load_features
from tonelens.operators.sampling import SEED, three_way_split
from tonelens.plans.workdir import materialise
from tonelens.sources import artifacts, corpus


def prepare(spark: SparkSession, raw_path: str, out_path: str, test_size: float = 0.15, val_size: float = 0.15, seed: int = SEED, fmt: str = "csv") -> DataFrame:
    """JSON Lines -> cleaned, distinct, labelled texts -> three splits on disk.  Returns the split corpus.

    Of equal texts the first in the order of the files stays.  Rows are known by their text from then on, so that the
    split, and later the folds, are the same however the files are cut.  The prepared corpus is written once, because
    the split reads it several times.
    """
    raw = corpus.with_position(corpus.read_jsonl(spark, raw_path))
    prepared = prepare_corpus(raw, "headline", "is_sarcastic", "position").drop("row_id")
    ready = materialise(corpus.with_text_id(prepared).select("row_id", "text", "label"), "corpus")
    split = three_way_split(ready, test_size, val_size, seed=seed)
    corpus.write_splits(split, out_path, fmt)
    return split


def read_corpus(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The three splits on disk as one corpus, rows known by their text; a missing split is an error."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in corpus.read_splits(spark, path, fmt).items()]
    whole = corpus.with_text_id(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return materialise(whole.select("row_id", "text", "label", "split"), "splits")


def train(spark: SparkSession, splits_path: str, out_path: str, external: External = None, fmt: str = "csv", **fit_args) -> TrainingResult:
    """Features, models, and their result tables under ``out_path``."""
    features = build_features(read_corpus(spark, splits_path, fmt), f"{out_path}/features")
    result = train_all(features, external, **fit_args)
    result.majority.save(spark, f"{out_path}/majority")
    result.classifier.save(spark, f"{out_path}/classifier")
    artifacts.write_comparison(result.comparison, f"{out_path}/model_comparison")
    artifacts.write_table(result.top_features, f"{out_path}/top_features")
    for i, name in enumerate(result.scored):
        artifacts.write_table(result.errors[name], f"{out_path}/errors_{i}")
        artifacts.write_table(result.confusion[name], f"{out_path}/confusion_{i}")
    return result


def experiment(spark: SparkSession, model_path: str, out_path: str, external: dict[float, DataFrame] | None = None, **fit_args) -> DataFrame:
    """Learning curve on the stored features, written to ``out_path``."""
    curve = learning_curve(load_features(spark, model_path + "/features"), external, **fit_args)
    artifacts.write_table(curve.coalesce(1), out_path)
    return curve


def predict(df: DataFrame, model_path: str, external: DataFrame | None = None, key: str = "row_id", text: str = "text") -> DataFrame:
    """Raw texts -> cleaned -> probability of the strongest scorer there is -> display columns.

    ``external`` holds ``(key, prob)`` of a stronger scorer; rows it does not know fall back to the stored classifier.
    """
    spark = df.sparkSession
    cleaned = df.withColumn(text, clean_text(F.col(text)))
    features = load_features(spark, model_path + "/features")
    classifier = TextClassifier.load(spark, model_path + "/classifier")
    linear = classifier.transform(featurise(cleaned, features.vocabulary, key, text)).select(key, "prob")
    scorers = {LINEAR: linear} if external is None else {EXTERNAL: external, LINEAR: linear}
    return predicted_polarity(best_available(df, scorers, key))


def compare(spark: SparkSession, out_path: str) -> DataFrame:
    """The stored model comparison."""
    return artifacts.read_comparison(spark, f"{out_path}/model_comparison")
