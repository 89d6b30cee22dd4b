"""Queries of the evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.operators import reports as R


@query("""
WITH g AS (SELECT DISTINCT o_custkey AS document, o_orderkey % 50 AS start FROM orders WHERE o_totalprice > 90000), p AS (SELECT DISTINCT o_custkey AS document, o_orderkey % 50 AS start FROM orders WHERE o_totalprice < 200000),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
""")
def anchor_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), (F.col("o_orderkey") % 50).alias("start"), "o_totalprice")
    gold, predicted = (rows.filter(f"o_totalprice {test}").select("document", "start").distinct() for test in ("> 90000", "< 200000"))
    report = R.anchor_report(gold, predicted, ["document", "start"])
    return report.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
SELECT 'priority' AS attribute, count(*) AS compared, sum((o_orderpriority = '1-URGENT')::INT)::BIGINT AS equal, round(avg((o_orderpriority = '1-URGENT')::INT), 6) AS share FROM orders
UNION ALL SELECT 'status', sum((o_custkey % 3 > 0)::INT)::BIGINT, sum((o_custkey % 3 > 0 AND o_orderstatus = 'F')::INT)::BIGINT, round(sum((o_custkey % 3 > 0 AND o_orderstatus = 'F')::INT) / sum((o_custkey % 3 > 0)::INT), 6) FROM orders
""")
def attribute_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    gold = orders.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderstatus")).alias("status"))
    predicted = orders.select("o_orderkey", F.lit("1-URGENT").alias("priority"), F.lit("F").alias("status"))
    return R.attribute_report(gold, predicted, ["o_orderkey"], ["priority", "status"]).withColumn("share", F.round("share", 6))


@query("""
WITH g AS (SELECT l_orderkey AS d, l_linenumber AS s, list_sort(list_distinct(list(l_suppkey))) AS g FROM lineitem WHERE l_quantity > 10 GROUP BY ALL), p AS (SELECT l_orderkey AS d, l_linenumber AS s, list_sort(list_distinct(list(l_suppkey))) AS p FROM lineitem WHERE l_discount > 0.03 GROUP BY ALL),
c AS (SELECT sum(len(g)) AS gold, sum(coalesce(len(p), 0)) AS predicted, sum(len(list_intersect(g, coalesce(p, [])))) AS tp, sum((p IS NULL)::INT) AS missing, sum((p IS NOT NULL AND p <> g)::INT) AS wrong FROM g LEFT JOIN p USING (d, s))
SELECT gold::BIGINT AS gold, predicted::BIGINT AS predicted, tp::BIGINT AS tp, missing::BIGINT AS missing, wrong::BIGINT AS wrong, round(tp / predicted, 6) AS precision, round(tp / gold, 6) AS recall, round(2 * tp / (gold + predicted), 6) AS f1 FROM c
""")
def link_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("start"), F.col("l_suppkey").alias("target"), "l_quantity", "l_discount")
    report = R.link_report(rows.filter("l_quantity > 10"), rows.filter("l_discount > 0.03"))
    return report.select("gold", "predicted", "tp", "missing", "wrong", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
SELECT count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS before, sum((o_orderstatus <> 'P')::INT)::BIGINT AS after FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)
""")
def routed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, keys = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    before = orders.select("o_custkey", (F.col("o_orderstatus") == "F").alias("right"))
    after = orders.select("o_custkey", (F.col("o_orderstatus") != "P").alias("right"))
    return R.routed(before, after, keys, "o_custkey", "right")
