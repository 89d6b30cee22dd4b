"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a ratio of target to present words, at most the cap. A document is taken
``floor(ratio)`` times for certain and once more with the fractional rest as its inclusion
probability. The flight moves the probabilities of three documents at a time along the
null-space of their two constraints (documents, words) until one of them is 0 or 1, so both
totals of a source stay as they were. It runs in blocks of bounded size; each block leaves at
most two documents undecided, those meet in further rounds, and the last few of each source
land, together with a few of all sizes kept out of the flight, on the choice that is nearest to
the words still owed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import BLANK, Staged, plain_text

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A flight takes at most about this many documents of one source.
BLOCK = 1024
#: The last round lands on the best choice among so many documents and the two that the flight leaves.
LANDING = 11
#: Sources up to this number are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Sources a mix can have: their totals, a row each, are gathered to deal out the words.
MOST_SOURCES = 1_000_000


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0) -> dict[str | None, float]:
    """Words for each source: ``share`` of all words dealt by weight, none above ``cap`` times its own; the excess is dealt again."""
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(totals)}
    size, left, out = dict(totals), share * sum(n for _, n in totals), {}
    while True:
        free = [s for s in size if s not in out]
        whole = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / whole > cap * size[s]]
        if not full:
            return out | {s: left * weight[s] / whole for s in free}
        for s in full:
            out[s] = cap * size[s]
        left -= sum(out[s] for s in full)


def fly(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Moves probabilities ``p`` of units with sizes ``x`` until at most two are neither 0 nor 1, keeping sum(p) and sum(p * x)."""
    p, x, eps = p.tolist(), x.tolist(), 1e-9
    held: list[int] = []
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, u, strict=True) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, u, strict=True) if v)
        # the longer way is taken with the smaller probability; a hash of the unit decides, so reruns agree
        coin = ((a * 2654435761 + b * 40503 + c * 97) & 0xFFFF) / 65536
        step = up if coin < down / (up + down) else -down
        for k, v in zip(held, u, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * v))
        for k in held:
            if not eps < p[k] < 1 - eps:
                p[k] = float(round(p[k]))
        held = [k for k in held if eps < p[k] < 1 - eps]
    return np.array(p)


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The 0/1 choice for the few units left whose words are nearest to sum(p * x), then whose number is nearest to sum(p)."""
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if not len(open_):
        return p
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float)
    words = np.abs(choices @ x[open_] - (p * x)[open_].sum())
    units = np.abs(choices.sum(1) - p[open_].sum())
    out = p.copy()
    out[open_] = choices[np.lexsort((units, words + units * 0.5))[0]]
    return out


def _flight(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents fly first, so that those left undecided are mostly small
        pdf = pdf.sort_values(["size", "turn", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p, x = pdf["p"].to_numpy(float), pdf["size"].to_numpy(float)
        # in the last round a few of all sizes stay out of the flight: they are what the landing can choose from
        open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9) & (x > 0))
        aside = np.unique(open_[np.linspace(0, len(open_) - 1, LANDING).astype(int)]) if last and len(open_) else np.empty(0, int)
        flies = np.setdiff1d(np.arange(len(p)), aside)
        p[flies] = fly(p[flies], x[flies])
        pdf["p"] = land(p, x) if last else p
        return pdf

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, times, taken.

    Size is the number of words of the whole text (null: 0), ``times`` how often the mix takes the
    document, ``taken`` its words. Sources rank by code point with null last. Rows that share a
    doc_id are separate units. A source without words has target 0, and documents without words
    are taken as their ratio says, which adds no words. No rows in, no rows out; further columns
    are ignored. The result depends on the rows alone, not on their order or partitions. More
    than MOST_SOURCES sources are refused.
    """
    spark = docs.sparkSession
    stage = Staged(spark, "mix")
    sized = stage.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(plain_text(F.col("text")), F.lit(f"[^{BLANK}]+")).cast("long").alias("size")))
    summed = sized.groupBy("source").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(summed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals = [(r["source"], r["w"], r["n"]) for r in summed]
    target = targets([(s, w) for s, w, _ in totals], weights, share, cap) if totals else {}
    plan = spark.createDataFrame(
        [(s, w, target[s], (target[s] / w if w else 0.0), max(1, math.ceil(n / block)), n) for s, w, n in totals],
        "source string, source_size long, target double, ratio double, blocks int, docs long",
    )
    plan = F.broadcast(plan) if len(totals) <= BROADCAST_SOURCES else plan
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select(
        sized["doc_id"], sized["source"], "size", "source_size", "target", "docs",
        F.floor("ratio").cast("int").alias("sure"), (F.col("ratio") - F.floor("ratio")).alias("p"), F.xxhash64("doc_id", "size").alias("turn"), "blocks",
    )
    rows = rows.withColumn("block", F.pmod("turn", F.col("blocks").cast("long")))

    schema = "doc_id long, source string, size long, source_size long, target double, docs long, sure int, p double, turn long, blocks int, block long"
    done, level = [], 0
    most = max([1, *(n for _, _, n in totals)])
    while True:
        last = most <= block
        flown = stage.write(rows.groupBy("source", "block").applyInPandas(_flight(last), schema))
        if last:
            done.append(flown)
            break
        open_ = F.col("p").between(1e-9, 1 - 1e-9)
        done.append(flown.filter(~open_))
        level, most = level + 1, 2 * math.ceil(most / block)
        rows = flown.filter(open_).withColumn("blocks", F.lit(max(1, math.ceil(most / block)))).withColumn("block", F.pmod(F.xxhash64("turn", F.lit(level)), F.col("blocks").cast("long")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    times = F.col("sure") + F.round("p").cast("int")
    return out.select("doc_id", "size", "source", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))
