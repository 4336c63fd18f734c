"""Helpers that the operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import time

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a file of a checkpointed table whose size is known; such a table has LEAST_FILES files at least.
FILE_ROWS, LEAST_FILES = 100_000, 8


#: Bytes of input (as its files have them) that are worth a task of their own.
TASK_BYTES = 16 << 20
#: Time in which Python's side has released the plans that it no longer uses.
RELEASE_SECONDS = 2.5
#: More parts than 100 TB call for come from a size that is not known.
MOST_PARTS = (100 << 40) // TASK_BYTES


def _by_size(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(-(-size // TASK_BYTES), 1 << 30)


def tasks_for(df: DataFrame) -> int:
    """How many tasks the size of ``df`` calls for, four per core at least."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, _by_size(df))


def parts_for(df: DataFrame) -> int:
    """Parts of a table that is dealt by hash and handled part by part: as many as shuffles have, and more where the
    size of ``df`` calls for them, so that no part outgrows a task.  An unknown size (of a join, say) adds none."""
    shuffled, own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _by_size(df)
    return max(shuffled, own) if own <= MOST_PARTS else shuffled


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than its size calls for, without a shuffle: small inputs in very many files
    would else make as many tasks, blocks and files at each step."""
    return df.coalesce(tasks_for(df))


def give_back() -> None:
    """Return free memory of this Python worker to the machine, as workers stay for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of :func:`shared_folder`.

    A table of at most ``rows`` rows is written as one file per FILE_ROWS, and not one per shuffle partition.
    """
    sc = df.sparkSession.sparkContext
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no plan needs any more, as it does once the driver's garbage is collected.

    Two things would keep the last query's plan, and so its shuffles, until a later call: Python's side lets go of
    plans in a thread of its own, which looks about once a second; and the queues of Spark's listeners hold their last
    event until the next one, here that of a query of one row.
    """
    gc.collect()
    time.sleep(RELEASE_SECONDS)
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a temporary folder serves a session in this one process; on a cluster that is an error, as
    other machines don't see such a folder.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="corpusloom-")


def id_text() -> Column:
    """doc_id as text: a long beside a null would reach pandas as a double and lose digits above 2**53."""
    return F.col("doc_id").cast("string").alias("doc_id")


def partition() -> int:
    """The number of the input partition that a task reads, which a repeated attempt has again; 0 outside of tasks."""
    task = TaskContext.get()
    return 0 if task is None else task.partitionId()


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
