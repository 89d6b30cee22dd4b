"""Scoring predictions against gold: counts, rates, intervals, matching. Plain aggregations."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.operators.work import per_document

#: Two-sided 95 % quantile of the normal distribution, fixed.
Z = 1.959963984540054


def outcomes(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome): TP, FN or FP; equal keys are paired one to one in order, surplus rows stay over."""
    def numbered(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*keys).withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(1)))).withColumn(mark, F.lit(1))

    both = numbered(gold, "__g").join(numbered(predicted, "__p"), [*keys, "__n"], "full_outer")
    outcome = F.when(F.col("__g").isNull(), "FP").when(F.col("__p").isNull(), "FN").otherwise("TP")
    return both.select(*keys, outcome.alias("outcome"))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and F1; null where they are not defined."""
    return {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)}


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null without trials."""
    p = F.try_divide(successes, trials)
    middle, spread, scale = p + Z * Z / (2 * trials), Z * F.sqrt(p * (1 - p) / trials + Z * Z / (4 * trials * trials)), 1 + Z * Z / trials
    return F.when(trials > 0, (middle - spread) / scale), F.when(trials > 0, (middle + spread) / scale)


def greedy_overlap(rows: DataFrame, document: str) -> DataFrame:
    """(document, p_id, g_id): each prediction, in order, takes the remaining gold span it overlaps most (first on a tie).

    ``rows`` has document, side ('p' or 'g'), id, start, end. A prediction waits until no span that
    it can meet is to come, and gold spans go once no prediction can meet them, so a long document
    costs its spans and their overlaps, and only those near one place are held.
    """

    def match(spans: Iterator[tuple]) -> Iterator[tuple]:
        gold: list[tuple] = []  # (start, id, end) in order, none taken
        waiting: deque[tuple] = deque()
        many = 64
        for start, own_id, side, end in chain(spans, [(None, None, None, None)]):
            while waiting and (start is None or waiting[0][2] <= start):
                p_start, p_id, p_end = waiting.popleft()
                gold = [g for g in gold if g[2] > p_start]
                best = max(((min(p_end, g[2]) - max(p_start, g[0]), -i) for i, g in enumerate(gold[: bisect_left(gold, (p_end,))])), default=(0, 0))
                if best[0] > 0:
                    yield p_id, gold.pop(-best[1])[1]
            if side == "p":
                waiting.append((start, own_id, end))
            elif side == "g":
                if len(gold) >= many:
                    gold = [g for g in gold if g[2] > (waiting[0][0] if waiting else start)]
                    many = max(64, 2 * len(gold))
                gold.append((start, own_id, end))

    return per_document(rows.select(document, F.col("start").cast("long").alias("start"), F.col("id").cast("long").alias("id"), "side", F.col("end").cast("long").alias("end")), document, ["start", "id", "side", "end"], [("p_id", "long"), ("g_id", "long")], match)


def segments(rows: DataFrame, document: str) -> DataFrame:
    """Spans that overlap none before them: by start, the longer first, then by kind. Rows: document, kind, start, end."""

    def keep(spans: Iterator[tuple]) -> Iterator[tuple]:
        last = -1
        for start, _, kind, end in spans:
            if start >= last:
                yield kind, start, end
                last = end

    held = rows.select(document, F.col("start").cast("long").alias("start"), (F.col("start") - F.col("end")).cast("long").alias("size"), "kind", F.col("end").cast("long").alias("end"))
    return per_document(held, document, ["start", "size", "kind", "end"], [("kind", "string"), ("start", "long"), ("end", "long")], keep)


def merged_windows(rows: DataFrame, document: str, longest: int) -> DataFrame:
    """Windows joined while they touch and stay within ``longest``. Rows: document, start, end."""

    def join(spans: Iterator[tuple]) -> Iterator[tuple]:
        low, high = next(spans)
        for start, end in spans:
            if start <= high and max(end, high) - low <= longest:
                high = max(end, high)
            else:
                yield low, high
                low, high = start, end
        yield low, high

    held = rows.select(document, *[F.col(c).cast("long").alias(c) for c in ("start", "end")])
    return per_document(held, document, ["start", "end"], [("start", "long"), ("end", "long")], join)
