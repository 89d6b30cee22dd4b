"""Queries of readers, writers and the span functions: tables rendered to files of the shared folder and read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.functions import spans as P
from citeloom.functions import text as T
from citeloom.operators.work import shared_dir, spread
from citeloom.sources import corpus, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT ['nalus', 'ns', 'nss', 'uohs'][(o_orderkey % 4)::INT + 1] AS source, count(*) AS lines, count(DISTINCT o_comment_) AS texts FROM (SELECT o_orderkey, concat('věc ', o_orderkey, ' ', o_orderpriority) AS o_comment_ FROM orders) GROUP BY 1
""")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "corpus")
    for k, source in enumerate(corpus.SOURCES):
        table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 4 == k).select(F.concat(F.lit("věc "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority")).write.text(f"{root}/{source}")
    lines = corpus.read_corpus(spark, root).select("source", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("line").alias("texts"))


@query("""
SELECT concat(c_custkey, '.txt') AS document_id, c_name AS judicate_name, (1990 + c_nationkey)::INT AS decision_year FROM customer
""")
def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "metadata")
    rows = table(spark, sf_dir, "customer").select(F.lit("ns").alias("source"), F.concat(F.col("c_custkey").cast("string"), F.lit(".txt")).alias("document_id"), F.col("c_name").alias("judicate_name"), (F.col("c_nationkey") + 1990).cast("int").alias("decision_year"), F.lit("x").alias("unknown_field"))
    rows.write.option("compression", "gzip").json(path)
    return corpus.read_metadata(spark, path).select("document_id", "judicate_name", "decision_year")


@query("""
SELECT o_orderkey::VARCHAR AS document_id, o_orderstatus = 'F' AS quality_flag, array_to_string([o_orderpriority], ',') AS laws FROM orders
""")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in two appends: older rows have their flag under its former name."""
    path = _folder(spark, "jsonl")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), (F.col("o_orderstatus") == "F").alias("quality_flag"), F.array("o_orderpriority").alias("candidate_law_ids"), "o_custkey")
    sinks.write_jsonl(rows.filter("o_custkey % 2 = 0").withColumnRenamed("quality_flag", "needs_review").drop("o_custkey"), path)
    sinks.write_jsonl(rows.filter("o_custkey % 2 = 1").drop("o_custkey"), path)
    return corpus.read_occurrences(spark, path).select("document_id", "quality_flag", F.array_join("candidate_law_ids", ",").alias("laws"))


@query("""
SELECT concat(n_regionkey + 1, '/2000 Sb.') AS law_id, max_by(n_name, n_nationkey) AS name FROM nation GROUP BY 1
""")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of one object whose later entries of a law replace earlier ones; entries of another kind do not count."""
    path = _folder(spark, "registry")
    acts = table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.lit("právní-akt").alias("typ"), F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("/2000 Sb.")).alias("akt-citace"), F.col("n_name").alias("akt-název-vyhlášený")).alias("p"))
    other = F.array(F.struct(F.lit("jiný").alias("typ"), F.lit("9/1999 Sb.").alias("akt-citace"), F.lit("x").alias("akt-název-vyhlášený")))
    one = acts.groupBy().agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "p"))).alias("l")).select(F.concat(F.transform("l", lambda x: x["p"]), other).alias("položky"))
    one.select(F.to_json(F.struct("položky"))).coalesce(1).write.text(path)
    return corpus.read_registry(spark, path)


@query("""
SELECT n_name AS alias, CASE n_nationkey % 3 WHEN 2 THEN concat(n_nationkey, '/2000 Sb.,1/1999 Sb.') ELSE concat(n_nationkey, '/2000 Sb.') END AS laws, CASE WHEN n_nationkey % 3 > 0 THEN 'exact' END AS match_mode, 'seed' AS layer FROM nation
""")
def alias_layer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of one JSON object whose values are laws, objects with a law, and objects with several."""
    path, k, law = _folder(spark, "aliases"), F.col("n_nationkey") % 3, F.concat(F.col("n_nationkey").cast("string"), F.lit("/2000 Sb."))
    mode = F.lit("exact").alias("match_mode")
    value = F.when(k == 0, F.to_json(F.array(law)).substr(F.lit(2), F.length(law) + 2)).when(k == 1, F.to_json(F.struct(law.alias("law_id"), mode))).otherwise(F.to_json(F.struct(F.array(law, F.lit("1/1999 Sb.")).alias("law_ids"), mode)))
    entry = F.concat(F.lit('"'), "n_name", F.lit('": '), value)
    one = table(spark, sf_dir, "nation").groupBy().agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value"))
    one.coalesce(1).write.text(path)
    return corpus.read_alias_layer(spark, path, "seed").select("alias", F.array_join("law_ids", ",").alias("laws"), "match_mode", "layer")


@query("SELECT o_orderkey, concat('první ', o_orderkey, ' část druhá.', chr(10), 'Nový ', o_orderstatus) AS text FROM orders")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.pandas_udf(lambda a, b: (a + "|" + b).map(lambda t: P.page_text([(10, 0, 90, 10, t.split("|")[0]), (12, 15, 90, 25, "druhá."), (10, 30, 90, 40, t.split("|")[1])])), "string")
    first, last = F.concat(F.lit("první  "), F.col("o_orderkey").cast("string"), F.lit("\nčást")), F.concat(F.lit("Nový "), "o_orderstatus")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", first.alias("a"), last.alias("b"))).select("o_orderkey", page("a", "b").alias("text"))


@query("""
SELECT o_orderkey, concat('ab', n, ' ef') AS normal, 0 AS raw_start, 4 + length(n) AS raw_end, 4 + length(n) AS gap_start, 8 + length(n) AS gap_end FROM (SELECT o_orderkey, o_custkey::VARCHAR AS n, o_orderstatus FROM orders)
""")
def span_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw places of the first word, which a line break parts, and of the squeezed gap behind it."""
    @F.pandas_udf("normal string, raw_start int, raw_end int, gap_start int, gap_end int")
    def remap(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for text in raw:
            n = P.Normalized(text)
            space = n.text.index(" ")
            rows.append((n.text, *n.raw_span(0, space), *n.raw_span(space, space + 1)))
        return pd.DataFrame(rows, columns=["normal", "raw_start", "raw_end", "gap_start", "gap_end"])

    raw = F.concat(F.lit("a\u200bb"), F.lit("\u00ad"), F.col("o_custkey").cast("string"), F.lit(" \n  ef"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))).select("o_orderkey", remap("raw").alias("r")).select("o_orderkey", "r.*")


@query("SELECT doc_id, sha256(translate(upper(trim(regexp_replace(strip_accents(replace(text, 'ß', '~')), '\\s+', ' ', 'g'))), '–—_' || chr(92), '--//')) AS fuzzy_hash FROM documents")
def fuzzy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.fuzzy_text(F.translate("text", "ß", "~")), 256).alias("fuzzy_hash"))
