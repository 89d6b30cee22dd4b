"""What several operators share: dealing small inputs over all cores, and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inputs of fewer bytes a core are dealt anew before costly work; larger ones have enough splits of their own.
SMALL = 128 << 20


#: Bytes of a task of costly work over a small input, and the fewest and most tasks of a core.
A_TASK, TASKS = 4 << 20, (4, 16)


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """Rows dealt over all cores where the input is small.

    A file of one row group is read by one task, however many rows it has. The plan's own size
    estimate decides, so nothing is listed or counted, and a large input is not shuffled. With
    ``by``, rows of one value of it go to one task, which can do for all of them what it does for one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * SMALL:
        return df
    return df.repartition(cores) if by is None else df.repartition(cores * min(TASKS[1], max(TASKS[0], size // (cores * A_TASK))), by)


#: Rows of a shuffled task in joins of large tables.
ROWS_A_TASK = 1_000_000


def tasks_of(df: DataFrame) -> int | None:
    """Tasks for a shuffle of a table's rows, where the session's number would make a task grow beyond ``ROWS_A_TASK``; else None."""
    need = -(-df.count() // ROWS_A_TASK)
    return need if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """Rows by key in so many tasks; as they are where no number is given."""
    return df if tasks is None else df.repartition(tasks, key)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster must name its shared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Kept:
    """Tables of a loop in the shared folder: plans stay short, lost executors cost one round, old rounds are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """``files``: how many files at most, for tables known to be small."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        (df if files is None else df.coalesce(files)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._kept_at)
            path.getFileSystem(conf).delete(path, True)


#: Rows that leave a fold in one Arrow batch.
ROWS_OUT = 4_000


def per_document(rows: DataFrame, document: str, columns: list[str], out: list[tuple[str, str]], fold: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """(document, out columns): ``fold`` of each document's rows, which come as tuples of ``columns`` in their order.

    Rows are sorted in the JVM and run through ``fold`` one by one, so a Python worker holds an
    Arrow batch and what the fold keeps, however long or many the documents are. ``out`` has names and Spark types.
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    held = rows.select(document, *columns).repartition(document).sortWithinPartitions(document, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fields = [(document, first.schema.field(0).type), *((n, kinds[t]) for n, t in out)]
        every = (row for batch in chain([first], batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made = ((key, *new) for key, own in groupby(every, itemgetter(0)) for new in fold(row[1:] for row in own))
        while some := list(islice(made, ROWS_OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(zip(*some, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return held.mapInArrow(run, ", ".join([f"`{document}` {dict(rows.dtypes)[document]}", *(f"`{n}` {t}" for n, t in out)]))
