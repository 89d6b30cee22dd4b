"""Queries of the streaming and source operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.operators.work import shared_dir
from citeloom.sources import sinks
from citeloom.streaming import ingest as S


@query("""
SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY ALL
""")
def stream_ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    target = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    for _ in range(2):  # the second run finds nothing new
        S.ingest(spark, stream, lambda df: df.select("event_id", "user_id", "event_type"), target, ("event_id",), f"{target}/checkpoint")
    rows = spark.read.parquet(f"{target}/rows")
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
SELECT o_orderkey::VARCHAR AS id, coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END, '') AS status, '["' || o_orderpriority || '"]' AS labels FROM orders
""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("status"), F.array("o_orderpriority").alias("labels"))
    return sinks.csv_ready(rows)


@query("""
SELECT 'now' AS version, o_orderkey, o_orderstatus AS status FROM orders UNION ALL SELECT 'before', o_orderkey, o_orderpriority FROM orders
""")
def stage_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, orders = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}", table(spark, sf_dir, "orders")
    S.rerun(spark, root, "laws", lambda: orders.select("o_orderkey", F.col("o_orderpriority").alias("status")))
    aside = S.rerun(spark, root, "laws", lambda: orders.select("o_orderkey", F.col("o_orderstatus").alias("status")))
    now, before = spark.read.parquet(f"{root}/laws"), spark.read.parquet(aside)
    return now.select(F.lit("now").alias("version"), "*").unionByName(before.select(F.lit("before").alias("version"), "*"))
