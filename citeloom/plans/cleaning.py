"""Queries of cleaning, naming and presentation functions, on texts rendered from ``orders`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.functions import present as P
from citeloom.functions import text as T
from citeloom.sources import sinks


@query("SELECT o_orderkey, ' ' || o_orderpriority || ' ' AS part FROM orders")
def section_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("hlava O d ů v o d n ě n í "), "o_orderpriority", F.lit(" Poučení : konec"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.reasoning_part(text).alias("part"))


@query("SELECT o_orderkey, concat('a', chr(10), o_orderpriority, chr(10), 'b') AS text FROM orders")
def page_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("a\n- "), (F.col("o_custkey") % 99).cast("string"), F.lit(" -\npokračování 5 A 1\n"), "o_orderpriority", F.lit("\nIV.\nb"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.drop_page_lines(text).alias("text"))


@query("SELECT o_orderkey, o_orderpriority || 'ěříčř' AS text FROM orders")
def cp1250_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.repair_cp1250(F.concat("o_orderpriority", F.lit("ìøíèø"))).alias("text"))


@query("SELECT p_partkey, concat('https://www.zakonyprolidi.cz/cs/', 1950 + p_size, '-', p_partkey % 900 + 1) AS url FROM part")
def law_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = F.concat((F.col("p_partkey") % 900 + 1).cast("string"), F.lit("/"), (F.col("p_size") + 1950).cast("string"), F.lit(" Sb."))
    return table(spark, sf_dir, "part").select("p_partkey", P.law_url(law).alias("url"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'section 5' WHEN 1 THEN 'section 5 | paragraph 1 letter a' WHEN 2 THEN 'section 5 | paragraph 1 letter a; paragraph 2' ELSE 'section 5 | paragraph 1; letter a, b' END AS label FROM part
""")
def detail_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    none, lists = F.array().cast("array<string>"), lambda *x: F.array(*map(F.lit, x))
    odst = F.when(k == 0, none).when(k == 1, lists("1")).when(k == 2, lists("1", "2")).otherwise(lists("1"))
    pism = F.when(k == 0, none).when(k == 3, lists("a", "b")).otherwise(lists("a"))
    return table(spark, sf_dir, "part").select("p_partkey", P.detail_label(F.lit("5"), odst, pism).alias("label"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'ns' WHEN 1 THEN 'nalus' ELSE 'other' END AS source, CASE s_suppkey % 3 WHEN 0 THEN concat('25 Cdo ', s_suppkey, '_2025.txt') ELSE concat(s_suppkey, '-1-01.txt') END AS document_id FROM supplier
""")
def blob_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    blob = F.when(k == 0, F.concat(F.lit("NS/25 Cdo "), n, F.lit("/2025.pdf"))).when(k == 1, F.concat(F.lit("US/"), n, F.lit("-1-01.pdf"))).otherwise(F.concat(F.lit("Other/"), n, F.lit("-1-01.pdf")))
    return table(spark, sf_dir, "supplier").withColumn("i", P.identity(blob)).select("s_suppkey", "i.source", "i.document_id")


@query("SELECT 'ns' AS source, o_orderkey::VARCHAR AS source_document, 'nss' AS target_source, o_custkey::VARCHAR AS target_document, 'body_exact' AS method, 'exact_decision' AS scope FROM orders")
def edge_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.lit("ns").alias("source_source"), F.col("o_orderkey").cast("string").alias("source_document_id"), F.lit("nss").alias("target_source"), F.col("o_custkey").cast("string").alias("target_document_id"), F.lit("body_exact").alias("link_method"), F.lit("exact_decision").alias("target_scope"), F.lit(1).alias("other"))
    return sinks.edge_export(links)
