"""Raw corpora and splits on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

RAW_SCHEMA = "headline string, is_sarcastic int, article_link string"
SPLIT_SCHEMA = "text string, label int"
SPLITS = ["train", "val", "test"]


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """JSON Lines with a declared schema; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Where a row stands: file, block, place in the block.  Put it right behind the scan.

    Positions order the rows as their files do, however the files are cut into tasks.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(name, place)


def with_text_id(df: DataFrame, text: str = "text", name: str = "row_id") -> DataFrame:
    """Number rows by their text, which must be distinct: the same numbers on every layout and after every rewrite."""
    return df.withColumn(name, F.xxhash64(text))


def write_splits(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """``text, label`` with a header, one folder per split; several files per split are written in parallel."""
    writer = df.select("text", "label", "split").write.partitionBy("split").mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def read_splits(spark: SparkSession, path: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """train, val and test; reading one split lists one folder only.  A missing split is an error."""
    reader = spark.read.schema(SPLIT_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    out = {}
    for split in SPLITS:
        try:
            out[split] = reader.format(fmt).load(f"{path}/split={split}")
        except AnalysisException as e:
            raise FileNotFoundError(f"split '{split}' is missing under {path}: prepare the corpus first") from e
    return out
