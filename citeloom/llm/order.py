"""Cutting a table into consecutive ranges of a bigint key, the same ones in every run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES_PER_PARTITION = 8
#: Ranges at most; the list of cut points is one literal of the plan, 2 MB at most.
MOST_RANGES = 100_000
#: Keys sampled for each cut point.
SAMPLED = 20


def cut_points(df: DataFrame, key: str, partitions: int, weight: Column | None = None) -> list[int]:
    """Ascending values of ``key``, each present in ``df``, none the smallest one; each starts a range.

    They cut the rows into about RANGES_PER_PARTITION ranges a partition of like weight (number of rows, where none is given). The keys
    are sampled by a hash of themselves, SAMPLED for each cut point, so what reaches the driver
    is bounded; a key that is sampled counts with all its rows. Balance depends on the sample,
    results do not.
    """
    count = min(RANGES_PER_PARTITION * partitions, MOST_RANGES) - 1
    found = df.agg(F.count(key).alias("n"), F.min(key).alias("low")).first()
    if count < 1 or not found["n"]:
        return []
    rate = max(1, found["n"] // (SAMPLED * (count + 1)))
    sampled = df.select(F.col(key).cast("long").alias("k"), (F.lit(1) if weight is None else weight).cast("double").alias("w")).filter(F.pmod(F.xxhash64("k", F.lit(17)), F.lit(rate)) == 0)
    rows = sampled.groupBy("k").agg(F.sum("w").alias("w")).filter("k is not null").orderBy("k").toArrow()
    if not rows.num_rows:
        return []
    keys, weights = rows.column("k").to_pylist(), rows.column("w").to_numpy()
    before = np.concatenate([[0], np.cumsum(weights)[:-1]])
    places = np.searchsorted(before, np.arange(1, count + 1) * (weights.sum() / (count + 1)))
    return sorted({keys[p] for p in places if p < len(keys) and keys[p] > found["low"]})


def range_of(key: Column, points: list[int]) -> Column:
    """The number of cut points that are not above ``key``, found by bisection; null keys give 0."""
    if not points:
        return F.lit(0)
    held, steps = F.split(F.lit(",".join(map(str, points))), ",").cast("array<bigint>"), []
    step = 1 << (len(points).bit_length() - 1)
    while step:
        steps.append(step)
        step //= 2
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= key, at + s).otherwise(at))
