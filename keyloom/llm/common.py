"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space of the operators' contracts: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one, if they are one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="keyloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release() -> None:
    """Gives a Python worker's free memory back to the system: idle workers stay beside the executor for a while, also in stages without Python."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(task: Callable) -> Callable:
    """A function of an iterator's batches that releases memory at its end."""

    @wraps(task)
    def run(parts: Iterator) -> Iterator:
        yield from task(parts)
        release()

    return run


#: Paths of the tables that this process has stored, oldest first.
_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and rereads it; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, start: int = 0, keep: int = 0) -> None:
    """Deletes the tables stored from the start-th on, but the newest ones to keep; nothing that still needs them may be read later."""
    jvm = spark._jvm
    for path in _written[start : len(_written) - keep]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def count_stored() -> int:
    return len(_written)


def frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A few rows as a DataFrame, by way of Arrow: plain lists would start Python workers of another kind, which stay in the executors' memory."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)))


def small(df: DataFrame, most: int) -> DataFrame:
    """df with a hint to send it to all tasks, if it has at most so many rows; else as it is, for a join by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_of(column: str = "text") -> F.Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(c: F.Column) -> F.Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts
