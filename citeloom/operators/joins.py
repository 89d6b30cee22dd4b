"""Join shapes of citation work: as-of, interval overlap, two-key fallback, overlay, token overlap."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.operators.work import Kept, spread

#: Token postings of names up to this number go to every task; more are joined by shuffle.
BROADCAST_POSTINGS = 5_000_000


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Left rows with the ``value`` of the last right row of their key whose ``since`` is not after ``at``. Times are ISO texts, dates or timestamps.

    Both sides are sorted together by key and year and the value is carried forward, so no pair is
    made and a key with very many rows takes as many tasks as it has years. What a year begins
    with comes from a table with one row for each key and year, carried forward in the same way.
    Null keys and times match nothing.
    """
    kind = dict(right.dtypes)[value]
    nothing = F.lit(None).cast(kind)

    def year(time: str) -> Column:
        return F.substring(F.col(time).cast("string"), 1, 4)

    a = left.select(*[F.col(c) for c in left.columns], F.col(key).alias("__k"), F.col(at).alias("__t"), year(at).alias("__y"), F.lit(1).alias("__side"), nothing.alias("__v"), F.lit(False).alias("__is"))
    b = right.select(F.col(key).alias("__k"), F.col(since).alias("__t"), year(since).alias("__y"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(True).alias("__is")).filter("__k is not null and __t is not null")

    def carried_on(rows: DataFrame, partition: list[str], order: list[str], name: str, frame_end: int = 0) -> DataFrame:
        last = F.last(F.when(F.col("__is"), F.struct("__v")), ignorenulls=True)
        return rows.withColumn(name, last.over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, frame_end)))

    within = carried_on(a.unionByName(b, allowMissingColumns=True), ["__k", "__y"], ["__t", "__side", "__v"], "__here").filter("__side = 1")
    newest = b.groupBy("__k", "__y").agg(F.max(F.struct("__t", "__v")).alias("m"), F.lit(True).alias("__is")).select("__k", "__y", F.col("m.__v").alias("__v"), "__is")
    asked = a.select("__k", "__y").distinct().join(newest, ["__k", "__y"], "full_outer").withColumn("__is", F.coalesce("__is", F.lit(False)))
    before = carried_on(asked, ["__k"], ["__y"], "__before", -1).select("__k", "__y", "__before").filter("__before is not null")
    both = within.join(before, ["__k", "__y"], "left")
    found = F.coalesce(F.col("__here"), F.col("__before"))["__v"]
    return both.withColumn("__found", F.when(F.col("__t").isNotNull(), found)).select(*[F.col(c) for c in left.columns], F.col("__found").alias(value))


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """Pairs of rows (key, start, end) of both sides that overlap: an equi-join on buckets of ``width``, each pair once."""

    def buckets(df: DataFrame, side: str) -> DataFrame:
        cols = [F.col(c).alias(c if c == key else f"{side}_{c}") for c in df.columns]
        low, high = F.floor(F.col(f"{side}_start") / width), F.floor((F.col(f"{side}_end") - 1) / width)
        return df.select(*cols).withColumn(f"{side}_low", low).withColumn("bucket", F.explode(F.sequence(low, F.greatest(low, high))))

    pairs = buckets(left, "l").join(buckets(right, "r"), [key, "bucket"])
    meet = (F.col("l_start") < F.col("r_end")) & (F.col("l_end") > F.col("r_start"))
    return pairs.filter(meet & (F.col("bucket") == F.greatest("l_low", "r_low"))).drop("bucket", "l_low", "r_low")


def with_fallback(left: DataFrame, right: DataFrame, exact: str, loose: str, value: str) -> DataFrame:
    """``value`` by the exact key, else by the loose key where that names one value only."""
    by_exact = right.groupBy(exact).agg(F.min(value).alias("__e"))
    by_loose = right.groupBy(loose).agg(F.min(value).alias("__l"), F.max(value).alias("__h")).filter(F.col("__l").eqNullSafe(F.col("__h"))).drop("__h")
    return left.join(by_exact, exact, "left").join(by_loose, loose, "left").select(*left.columns, F.coalesce("__e", "__l").alias(value))


def overlay(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with the columns of their update where it has a value; unknown keys are not added."""
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    kept = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return base.join(new, key, "left").select(*kept)


def token_shortlist(queries: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(q_id, n_id, score, rank): shared tokens over the root of the name's tokens, the best ``most`` names of each query.

    Rows: (q_id, tokens) and (n_id, tokens), with bigint n_id. Names are a dictionary: their inverted index goes to
    every task where it is within BROADCAST_POSTINGS, and a query is scored by counting in it, so
    a token that all queries and names share costs no pair. A larger index meets the queries by
    token in a shuffle.
    """
    own = names.select("n_id", F.array_distinct("tokens").alias("tokens"))
    q = queries.select("q_id", F.array_distinct("tokens").alias("tokens"))
    size = own.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    if size > BROADCAST_POSTINGS:
        met = q.select("q_id", F.explode("tokens").alias("token")).join(own.select("n_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token")), "token")
        scored = met.groupBy("q_id", "n_id", "n_tokens").agg(F.count(F.lit(1)).alias("shared")).select("q_id", "n_id", (F.col("shared") / F.sqrt("n_tokens")).alias("score"))
        rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc(F.round("score", 9)), "n_id"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= most)
    postings: dict[str, list[int]] = {}
    ids, root = [], []
    for r in own.orderBy("n_id").collect():
        for t in r["tokens"] or ():
            postings.setdefault(t, []).append(len(ids))
        ids.append(r["n_id"])
        root.append(max(1, len(r["tokens"] or ())) ** 0.5)
    shared = queries.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), np.array(root), {t: np.array(p, np.int32) for t, p in postings.items()}))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_, roots, index = shared.value
        for batch in batches:
            at, out = [], ([], [], [])
            for k, tokens in enumerate(batch.column("tokens").to_pylist()):
                hits = [index[t] for t in tokens or () if t in index]
                if not hits:
                    continue
                count = np.bincount(np.concatenate(hits), minlength=len(names_))
                met = np.flatnonzero(count)
                value = count[met] / roots[met]
                best = met[np.lexsort((names_[met], -np.round(value, 9)))[:most]]
                at += [k] * len(best)
                for column, more in zip(out, (names_[best], count[best] / roots[best], np.arange(1, len(best) + 1)), strict=True):
                    column.extend(more.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("q_id").take(pa.array(at, pa.int64())), pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int32())], names=["q_id", "n_id", "score", "rank"])

    return spread(q).mapInArrow(score, f"q_id {dict(q.dtypes)['q_id']}, n_id long, score double, rank int")


def carried(value: Column, partition: list[str], order: list[str]) -> Column:
    """The last value that is not null, up to the row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def positions(df: DataFrame, *order: str) -> DataFrame:
    """All rows with their ``position`` from 1 in the given order: a distributed sort, and the sizes of the ranges before.

    Only the sizes are summed over all ranges. Nulls come first, and rows that tie get any order.
    """
    spark = df.sparkSession
    ranged = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = Kept(spark).write(ranged.withColumn("__range", F.shiftright("__at", 33)))  # the sort is not run twice, so its ranges stay the same
    sizes = sorted((r["__range"], r["n"]) for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect())
    before = list(zip((r for r, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    starts = F.broadcast(spark.createDataFrame(before, "__range long, __before long"))
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(starts, "__range").select(*df.columns, place.alias("position"))
