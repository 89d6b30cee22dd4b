"""Exact duplicates by content sort (DataFrame functions only).

Sampled splitters range-partition the rows by their normalised bytes, an external sort places
equal texts next to each other, and every row is compared in full with its neighbour.

The sort key is (the first HEAD characters of the normalised text, a hash of all of it, salt), compared byte by byte:
texts that agree in their first characters are told apart by the hash, equal texts have
equal keys, so a run never leaves its key, and only the short key travels to the driver when
splitters are sampled. A text that more than ``rows / (4 * partitions)`` rows share is salted:
its rows form several runs in several partitions, each run leaves one representative with its
text, and the representatives are compared once more. At most ``4 * partitions`` texts can be
that frequent, so their list is small by construction and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import Staged, ascii_lower, partitions


#: Characters of a text that its sort key begins with.
HEAD = 64


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. ``keep`` names the row that stays in
    a group: "smallest" or "largest" identifier. A null text is the empty text. A null
    identifier sorts below all others and is kept only where its group has no other. Rows that
    repeat both identifier and text are one group, and one of them is kept. No rows in, no rows
    out; further columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark, n_parts = docs.sparkSession, partitions(docs.sparkSession)
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm")).withColumn("fold", F.xxhash64("norm"))

    total = docs.select(F.lit(1)).count()
    often = max(64, total // (4 * n_parts))
    hot = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > often)
    hot = hot.select(F.col("fold").alias("hot_fold"), F.ceil(F.col("n") / often).cast("int").alias("shares"))

    salted = rows.join(F.broadcast(hot), F.col("fold") == F.col("hot_fold"), "left").select(
        "doc_id", "norm", F.substring("norm", 1, HEAD).alias("head"), "fold",
        F.when(F.col("shares").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("shares").cast("long")).cast("int")).otherwise(-1).alias("salt"),
    )
    key = ["head", "fold", "salt"]
    dealt = salted.repartitionByRange(n_parts, *key).select("doc_id", "norm", *key)

    along = W.partitionBy(*key).orderBy("norm", F.col("doc_id") if keep == "largest" else F.col("doc_id").desc_nulls_first())
    starts = F.when(F.col("norm") == F.lag("norm").over(along), 0).otherwise(1)
    ends = F.coalesce(F.col("norm") != F.lead("norm").over(along), F.lit(True))
    runs = dealt.withColumn("starts", starts).withColumn("last", ends).withColumn("run", F.sum("starts").over(along))
    runs = runs.select("doc_id", *key, "run", "last", F.sha2("norm", 256).alias("text_sha256"), F.when((F.col("salt") >= 0) & F.col("last"), F.col("norm")).alias("shown"))

    own = W.partitionBy(*key, "run")
    stage = Staged(spark, "content-sort")
    runs = stage.write(runs.withColumn("keep_id", best("doc_id").over(own)).withColumn("group_size", F.count(F.lit(1)).over(own)))

    out = ["doc_id", "keep_id", "group_size", "last", "text_sha256"]
    cold = runs.filter("salt < 0").select(*out)
    shown = runs.filter("salt >= 0 and last").select(*key, "run", "shown", "keep_id", "group_size")
    whole = shown.groupBy("fold", "shown").agg(best("keep_id").alias("best_id"), F.sum("group_size").alias("whole_size"))
    whole = shown.join(whole, ["fold", "shown"]).select(*key, "run", "best_id", "whole_size")
    warm = runs.filter("salt >= 0").select(*key, "run", "doc_id", "last", "text_sha256").join(whole, [*key, "run"])
    warm = warm.select("doc_id", F.col("best_id").alias("keep_id"), F.col("whole_size").alias("group_size"), "last", "text_sha256")
    return cold.unionByName(warm).select("doc_id", "keep_id", "group_size", (F.col("last") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
