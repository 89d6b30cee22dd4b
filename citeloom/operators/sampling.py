"""Samples that are the same in every run: by seeded hash order, and windows of texts away from known spans."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.operators.work import spread


def turn(key: Column, seed: int) -> Column:
    """The place of a key in the order of a seed."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def seeded(df: DataFrame, key: str, most: int, seed: int = 42, group: list[str] | None = None) -> DataFrame:
    """``most`` rows of each group (of all rows where none is named), by the order of the seed; the number is the feature."""
    order = [turn(F.col(key), seed), F.col(key)]
    if not group:
        return df.orderBy(*order).limit(most)
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")


def apart(size: int, spans: list[tuple[int, int]], width: int, count: int, key: str, seed: int, tries: int) -> list[tuple[int, int]]:
    """Up to ``count`` windows of ``width`` inside [0, size) that meet neither a span nor each other, at places a hash of key and seed gives."""
    taken, out = sorted(spans), []
    if size < width:
        return out
    reach: list[int] = []
    for _, end in taken:
        reach.append(max(end, reach[-1] if reach else 0))
    starts = [s for s, _ in taken]
    for k in range(tries):
        if len(out) == count:
            break
        low = int(hashlib.sha256(f"{seed}:{key}:{k}".encode()).hexdigest()[:12], 16) % (size - width + 1)
        i = bisect_left(starts, low + width)
        if not (i and reach[i - 1] > low) and all(low >= b or low + width <= a for a, b in out):
            out.append((low, low + width))
    return out


def negative_windows(docs: DataFrame, spans: DataFrame, key: str, width: int, count: int, seed: int = 42, tries: int = 200) -> DataFrame:
    """(key, start, end): windows of texts (key, size) that no span (key, start, end) meets, at most ``count`` a document."""
    held = spans.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # a document's spans are bounded by its length
    rows = docs.select(key, F.col("size").cast("long").alias("size")).join(held, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, (name, size, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "size", "spans")), strict=True)):
                for window in apart(size or 0, [(s["start"], s["end"]) for s in own or ()], width, count, str(name), seed, tries):
                    at.append(k)
                    out.append(window)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array([w[i] for w in out], pa.int64()) for i in (0, 1))], names=[key, "start", "end"])

    return spread(rows).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, start long, end long")
