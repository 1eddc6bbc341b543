"""Result tables on disk: errors, top features, comparisons, learning curves, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tonelens.operators.metrics import METRICS

COMPARISON_SCHEMA = "model string, accuracy double, precision double, recall double, f1 double, auc double"


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small result table as CSV with a header, or in any other format."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.format(fmt).load(path)


def write_comparison(df: DataFrame, path: str) -> None:
    """Model comparison, metrics to four places."""
    write_table(df.select("model", *[F.round(m, 4).alias(m) for m in METRICS]), path)


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, COMPARISON_SCHEMA)


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per table of the evaluation report."""
    for name, df in report.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).json(f"{path}/{name}") for name, s in schemas.items()}
