"""Resumable ingest: new documents are mined once, in micro-batches, with a checkpoint and a done-table.

Completion is recorded for each document, so one without citations is not mined again. The
stream reads what is there and stops; running it again takes only what came since.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, name: str):
    """(path, its file system) of a name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def ingest(spark: SparkSession, source: DataFrame, mine: Callable[[DataFrame], DataFrame], target: str, keys: tuple[str, ...], checkpoint: str) -> None:
    """Mines a streaming ``source`` into ``<target>/rows`` and records its documents in ``<target>/done``.

    Each micro-batch has a folder of its own that is overwritten when it is tried again, so
    a failed batch leaves nothing twice.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        fresh = df.dropDuplicates(list(keys))
        if exists(spark, f"{target}/done"):
            done = spark.read.parquet(f"{target}/done").filter(F.col("batch") != batch_id)
            fresh = fresh.join(done.select(*keys), list(keys), "left_anti")
        mine(fresh).write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")
        fresh.select(*keys).write.mode("overwrite").parquet(f"{target}/done/batch={batch_id}")

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rerun(spark: SparkSession, root: str, stage: str, make: Callable[[], DataFrame]) -> str:
    """Runs one stage again: its rows go to ``<root>/<stage>``, older ones to ``<root>/<stage>.before-<n>``; the manifest says so.

    The new rows are written beside the old ones first, so a failed run changes nothing. Returns
    the folder of the older rows, or "" where there were none.
    """
    target, fresh = f"{root}/{stage}", f"{root}/{stage}.new"
    make().write.mode("overwrite").parquet(fresh)
    aside = ""
    if exists(spark, target):
        n = 1
        while exists(spark, f"{target}.before-{n}"):
            n += 1
        aside = f"{target}.before-{n}"
        _move(spark, target, aside)
    _move(spark, fresh, target)
    entries = manifest(spark, root) | {stage: {"rows": spark.read.parquet(target).count(), "before": aside.rpartition("/")[2]}}
    path, files = _path(spark, f"{root}/manifest.json")
    out = files.create(path, True)
    out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
    out.close()
    return aside


def _move(spark: SparkSession, source: str, target: str) -> None:
    path, files = _path(spark, source)
    if not files.rename(path, _path(spark, target)[0]):
        raise OSError(f"{source} could not be moved to {target}")


def manifest(spark: SparkSession, root: str) -> dict:
    """What ``rerun`` wrote about the stages of a folder."""
    name = f"{root}/manifest.json"
    return json.loads("".join(r[0] for r in spark.read.text(name, wholetext=True).collect())) if exists(spark, name) else {}


def finalized(rows: DataFrame, entry: str, order: list[str]) -> DataFrame:
    """One row per entry, the first by a total order; rows without an entry are kept once each."""
    from citeloom.operators.citations import first_of_each

    named = rows.filter(F.col(entry).isNotNull())
    return first_of_each(named, [entry], order).unionByName(rows.filter(F.col(entry).isNull()).distinct())


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Streaming counts by event type in windows of event time; late rows within the watermark count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
