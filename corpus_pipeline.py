"""Corpus pipeline: quality classifier, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns rows in
the columns of ``documents``, the last one the pieces of the packing. ``run`` writes each
stage's rows to the shared folder and reads them again, so a lost executor costs one stage.
Extra columns go along; null texts count as empty and null identifiers are kept as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import ship
from citeloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from citeloom.llm.common import Staged

#: Up to so many identifiers of dropped documents are broadcast; more are joined by shuffle.
BROADCAST_IDS = 300_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``dropped`` (a staged table of identifiers)."""
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Labels are learned outside the held-out fold."""
    ship(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest identifier.

    Rows that repeat an identifier and its text are equal, too: one of them stays.
    """
    ship(spark)
    stage = Staged(spark, "exact-stage")
    sha = F.sha2(exact_dedup.ascii_lower(F.col("text")), 256)
    rows = exact_dedup.content_sort(docs, keep="largest").groupBy("doc_id", "text_sha256").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = stage.write(rows.filter("kept = 0 or n > 1"))
    plain = odd.filter("n = 1 and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("gone"))
    twice = odd.filter("n > 1 or doc_id is null")
    if not twice.take(1):
        return without(docs, stage.write(plain.select("doc_id")))
    # identifiers or rows that repeat: decide by identifier and text
    named = docs.withColumn("__sha", sha)
    gone = odd.filter("kept = 0").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__gone"))
    left = named.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__gone")), "left_anti")
    return left.dropDuplicates(["doc_id", "__sha"]).drop("__sha")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    stage = Staged(spark, "near-stage")
    return without(docs, stage.write(near_dedup.near_duplicates(docs).filter("not kept and doc_id is not null").select("doc_id").distinct()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows of one identifier all as often as the most taken of them."""
    ship(spark)
    times = mixing.mix(docs).groupBy("doc_id").agg(F.max("times").alias("__times")).filter("__times > 0").withColumnRenamed("doc_id", "__id")
    taken = docs.join(times, F.col("doc_id").eqNullSafe(F.col("__id")))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences; a document taken twice is packed twice."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the classifier; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = spark.read.parquet(f"{sf_dir}/documents.parquet"), Staged(spark, "pipeline")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.write(docs)
    return docs
