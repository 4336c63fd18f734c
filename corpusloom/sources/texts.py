"""Text sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark knows has the path."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    except Exception:  # an arbitrary text is seldom a path
        return False


def literal_or_path(spark: SparkSession, given: str) -> DataFrame:
    """One document: the file's whole text if ``given`` is a path that exists, else ``given`` itself."""
    if given and len(given) < 4096 and "\n" not in given and exists(spark, given):
        return spark.read.text(given, wholetext=True).select(F.lit(0).cast("long").alias("doc_id"), F.col("value").alias("text"))
    return spark.range(1).select(F.col("id").alias("doc_id"), F.lit(given).alias("text"))


def directory(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """One document per file of the folder (not of those below it): file_name, text."""
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def write_text(df: DataFrame, path: str, column: str = "result") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_named(df: DataFrame, path: str, column: str = "result", prefix: str = "processed_") -> None:
    """A folder per input, named after it with a prefix."""
    df.select(F.col(column).alias("value"), F.concat(F.lit(prefix), "file_name").alias("file_name")).write.mode("overwrite").partitionBy("file_name").text(path)


def write_stdout(df: DataFrame, column: str = "result") -> None:
    """Print the texts one by one; one partition at a time is on the driver."""
    for row in df.select(column).toLocalIterator():
        print(row[0] or "")


def response_json(result: Column, method: Column, seconds: Column) -> Column:
    return F.to_json(F.struct(result.alias("result"), method.alias("method"), (seconds * 1000).cast("long").alias("processing_time_ms")))


def trace(df: DataFrame, *keys: str) -> DataFrame:
    """The steps of a standard chain as rows."""
    return df.select(*keys, F.inline("steps"))
