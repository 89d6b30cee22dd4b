"""What the operators of this subpackage share: staged tables, sizes and text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: The white space of the contracts, as a character class body for Java and Python patterns.
BLANK = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is set on one machine (tests); a cluster
    must name its own, as its executors do not see the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm_dir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = jvm_dir.get() if jvm_dir.isDefined() else "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Staged:
    """Tables written to the shared folder, to cut lineage or to reuse work.

    A written table survives the loss of any executor, and what its job shuffled is deleted when
    the job ends. ``drop`` removes a table that no later plan reads; what a returned DataFrame
    still reads stays until the folder is emptied.
    """

    #: Spark's setting that deletes a job's shuffle files at its end, on for the writes here only.
    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEANUP)
            else:
                self.spark.conf.set(self.CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._staged_at)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_text(text: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would also change other letters)."""
    return F.translate(plain_text(text), UPPER, LOWER)


#: Bytes of a slice that a Python worker takes in hand at a time.
SLICE = 6 << 20


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about SLICE bytes; memory of finished ones is given back, so workers stay small."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
        for low in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(low, rows)
        pa.default_memory_pool().release_unused()
