"""File sources and sinks for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tonelens.plans.workdir import work_path


def read_file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", max_files: int = 1000) -> DataFrame:
    """Parquet tables that appear in ``folder`` and match ``pattern``, as a stream of at most ``max_files`` files a batch.

    A match may be a file or a folder of files.  The pattern is part of the path, in braces so that it is one also without a
    wildcard: a filter by name would compare the names of the files in a folder, not its own.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder.rstrip('/')}/{{{pattern}}}")


def run_available(stream: DataFrame, name: str) -> tuple[StreamingQuery, DataFrame]:
    """Process everything that is available now, append it to a Parquet table in the work folder; the ended query and the table."""
    spark = stream.sparkSession
    path = work_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{path}/table")
    )
    query.awaitTermination()
    return query, spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """The table of :func:`run_available`."""
    return run_available(stream, name)[1]
