"""Shared plumbing: tables in the shared folder, Arrow mapping, crc folds."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only in local mode, as in tests, a folder of this machine is set where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="numfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Folders made so far; clear() deletes those from a mark on.
_roots: list[str] = []


def mark() -> int:
    return len(_roots)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes the kept tables and archives made since a mark; no plan may need them any more."""
    for root in _roots[since:]:
        delete(spark, root)
    del _roots[since:]


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _roots.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._numfold_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in frames:
            delete(self.spark, df._numfold_path)


def trim() -> None:
    """Gives the memory that a task has freed back to the system; workers are used again and would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a system without it
        pass


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch. Batches are held to 8 MB (or one row) unless the session says otherwise."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, "64MB") in ("64MB", "67108864b", "67108864"):
        conf.set(BATCH, "8MB")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        trim()

    return df.mapInArrow(run, schema)


def fold(id_col: str, mod: int) -> Column:
    """crc32(id as text) mod `mod`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names of its own."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def bounded_sample(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """About `size` rows, chosen by a hash of the key columns."""
    share = min(1.0, size / max(1, rows.count()))
    return rows if share == 1.0 else rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 24)) < int(share * (1 << 24)))
