"""Streams: every row-wise operator works on a stream as it is, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import scores


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files with the schema of those there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", scores.stylometry(F.col("text")).alias("s")).select("doc_id", "s.*")


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
