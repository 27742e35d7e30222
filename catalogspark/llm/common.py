"""Shared helpers: the cluster's shared folder, tables that cut lineage, and slicing of Arrow batches.

Tables that cut lineage are written as Parquet below ``spark.checkpoint.dir``, so that a lost executor costs a
re-read and not a re-run.  The setting is read from the session; only on a local master, as in tests, may it be unset:
then a temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
    return _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut there."""
    return materialize_at(df, label)[0]


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def written_tables() -> Iterator[list[str]]:
    """The paths of the tables that operators write meanwhile: for a caller that knows when nothing reads them any more."""
    made: list[str] = []
    before = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(before)


def materialize_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table of ours from the shared folder once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one run in a folder of their own below the shared one; ``drop`` deletes them once nothing reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, new_path(spark, label)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self) -> None:
        delete_path(self.spark, self.root)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs; other columns, whatever their names, cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_key(text_col: str) -> tuple[F.Column, F.Column]:
    """t1, t2: 128 bits of hash of a text; null for a null text."""
    text = F.col(text_col).cast("string")
    return F.when(text.isNotNull(), F.xxhash64(text)).alias("t1"), F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("t2")


def text_slices(batch: pa.RecordBatch, text_col: str, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``limit`` bytes of text: (first row, rows, bytes, offsets).

    A null text counts as empty.  A single text longer than ``limit`` is a slice of its own, never cut.
    """
    col = batch.column(batch.schema.get_field_index(text_col))
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return
    wide = pa.types.is_large_string(col.type)
    _, off_buf, data_buf = col.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64 if wide else np.int32, count=n + 1 + col.offset)[col.offset:].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end - row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end
