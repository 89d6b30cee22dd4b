"""Queries of the review operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.operators import review as R
from citeloom.operators import sampling as Z


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'filtered_out_of_scope' WHEN o_custkey % 3 > 1 THEN 'link_disambiguation' WHEN o_custkey % 3 = 1 THEN 'link_normalization_or_target_recovery' ELSE 'extraction_presence_check' END AS route FROM orders
""")
def route_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", R.route(F.col("o_custkey") % 3, F.col("o_orderstatus") == "P").alias("route"))


@query("""
SELECT entry_id, law_id, sources, rank FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY best, law_id) AS rank FROM (
  SELECT l_orderkey AS entry_id, l_suppkey AS law_id, min(l_linenumber % 3)::INT AS best, array_to_string(list_sort(list_distinct(list('s' || l_linenumber % 3))), ',') AS sources FROM lineitem GROUP BY ALL)) WHERE rank <= 4
""")
def candidate_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_suppkey").alias("law_id"), F.concat(F.lit("s"), rank.cast("string")).alias("origin"), rank.alias("origin_rank"))
    return R.bundle(rows, 4).withColumn("sources", F.array_join("sources", ","))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 5 IN (0, 1, 2) THEN o_custkey % 5 END AS chosen, CASE WHEN o_custkey % 5 IN (0, 1, 2) THEN 0.9 ELSE 0.5 END AS confidence FROM orders
""")
def post_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("chosen"), F.lit(0.9).alias("confidence"), F.array(*[F.lit(i).cast("long") for i in range(3)]).alias("candidates"))
    return R.validated(rows).select("o_orderkey", "chosen", "confidence")


@query("""
SELECT event_id, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, event_id % 5) = 1 AS promoted, CASE WHEN max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, event_id % 5) = 1 THEN greatest(0.55, (event_id % 10) / 10) ELSE (event_id % 10) / 10 END AS confidence FROM events
""")
def consistency_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 5).alias("body"), "event_type", ((F.col("event_id") % 10) / 10).alias("confidence"))
    return R.consistent(rows, ["user_id", "body"], F.col("event_type") == "purchase").select("event_id", "promoted", "confidence")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review entry of each order, its route by o_orderkey % 3."""
    routes = F.array(*map(F.lit, (R.DISAMBIGUATION, R.RECOVERY, R.PRESENCE)))
    number = (F.col("o_custkey") % 900 + 1).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.get(routes, (F.col("o_orderkey") % 3).cast("int")).alias("route"), F.concat(F.lit("21 Cdo "), number, F.lit("/2010")).alias("target_reference"),
        F.concat(F.lit("podle 21 Cdo "), number, F.lit("/2010 platí")).alias("context_block"), F.array(F.concat(number, F.lit(".txt"))).alias("candidate_targets"), F.concat(F.lit("21 Cdo "), number, F.lit("/2010")).alias("candidate_text"),
    )


@query("""
SELECT o_orderkey, r.route, CASE WHEN k < 2 THEN concat('21 Cdo ', o_custkey % 900 + 1, '/2010') END AS target_reference, CASE WHEN k = 2 THEN concat('21 Cdo ', o_custkey % 900 + 1, '/2010') END AS candidate_text, k < 2 AS dates_count
FROM orders JOIN (VALUES (0, 'link_disambiguation'), (1, 'link_normalization_or_target_recovery'), (2, 'extraction_presence_check')) r(k, route) ON o_orderkey % 3 = k
""")
def route_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = R.prompts(_queue(spark, sf_dir))
    field = lambda name: F.get_json_object("prompt", f"$.{name}")
    return made.select(F.col("entry_id").alias("o_orderkey"), field("route").alias("route"), field("target_reference").alias("target_reference"), field("candidate_text").alias("candidate_text"), F.contains("prompt", F.lit("target_decision_date_iso")).alias("dates_count"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'unresolved' ELSE 'is_reference' END AS decision, 0.0 AS confidence FROM orders")
def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.baseline(_queue(spark, sf_dir)).select(F.col("entry_id").alias("o_orderkey"), "decision", "confidence")


@query("SELECT o_orderkey, 'unresolved' AS decision, 0.0 AS confidence FROM orders")
def offline_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ask(R.prompts(_queue(spark, sf_dir))).select(F.col("entry_id").alias("o_orderkey"), "decision", "confidence")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'api_error' ELSE concat('is ', o_custkey % 900 + 1) END AS decision, CASE WHEN o_orderkey % 3 = 2 THEN 0.0 ELSE 0.9 END AS confidence, o_orderkey % 3 = 2 AS failed FROM orders
""")
def injected_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    def reviewer(prompt: str) -> dict:
        import json

        asked = json.loads(prompt)
        if asked["route"] == R.PRESENCE:
            raise TimeoutError("no answer")
        return {"decision": "is " + asked["target_reference"].split()[2].split("/")[0], "confidence": 0.9}

    answers = R.ask(R.prompts(_queue(spark, sf_dir), "v1"), reviewer, retries=0)
    return answers.select(F.col("entry_id").alias("o_orderkey"), "decision", "confidence", F.col("error").isNotNull().alias("failed"))


@query("""
SELECT c_custkey::VARCHAR AS alias, CASE c_custkey % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'ambiguous_valid' ELSE 'reject' END AS classification, CASE c_custkey % 4 WHEN 0 THEN concat(c_nationkey, '/2001 Sb.') WHEN 1 THEN concat(c_nationkey, '/2001 Sb.,', c_nationkey, '/2000 Sb.') ELSE '' END AS laws,
  CASE WHEN c_custkey % 4 = 0 THEN concat(c_nationkey, '/2001 Sb.') END AS law_id FROM customer
""")
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 4
    old, new = F.concat(n, F.lit("/2000 Sb.")), F.concat(n, F.lit("/2001 Sb."))
    answer = F.when(k == 0, "single").when(k == 1, "ambiguous_valid").when(k == 2, "reject")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("alias"), F.array(old, new).alias("candidates"), answer.alias("classification"), F.array(F.lit("9/9999 Sb."), new, old).alias("law_ids"))
    return R.resolved_conflicts(rows).select("alias", "classification", F.array_join("law_ids", ",").alias("laws"), "law_id")


@query("""
SELECT o_orderkey AS ref_id, CASE k WHEN 0 THEN 'link_disambiguation' WHEN 1 THEN 'link_normalization_or_target_recovery' ELSE 'extraction_presence_check' END AS route, CASE k WHEN 0 THEN 'a,b' WHEN 1 THEN 'a' ELSE '' END AS targets
FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders) WHERE k IN (0, 1, 2)
""")
def upload_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # by o_orderkey % 7: two candidates, one, none; a lower court, the office by body and by hint, a linked one
    k = F.col("ref_id") % 7
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), (F.col("o_custkey") % 900 + 1).cast("string").alias("n"))
    body = F.when(k == 4, F.concat(F.lit("ÚOHS-"), "n", F.lit("/2024/852"))).otherwise(F.concat(F.lit("12 T "), "n", F.lit("/2002")))
    refs = refs.select("ref_id", body.alias("body"), body.alias("text"), F.when(k == 3, "Městského soudu").when(k == 5, "předsedy Úřadu").alias("court"))
    candidates = refs.filter(k < 2).select("ref_id", F.explode(F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("target")).withColumn("rank", F.ascii("target") - 96)
    tasks = R.upload_tasks(refs, refs.filter(k == 6).select("ref_id"), candidates)
    return tasks.select("ref_id", "route", F.array_join("candidate_targets", ",").alias("targets"))


@query("""
WITH d AS (SELECT o_orderkey, concat('podle ', o_orderpriority, chr(10), 'a dále ', o_orderstatus, ' konec') AS text, length(o_orderpriority) AS l FROM orders)
SELECT o_orderkey AS entry_id, substr(text, 7, l) AS target_reference, greatest(0, 6 - 4) AS context_start, replace(substr(text, 3, l + 4 + 10), chr(10), ' ') AS context_block FROM d
""")
def packed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    docs = orders.select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("podle "), "o_orderpriority", F.lit("\na dále "), "o_orderstatus", F.lit(" konec")).alias("text"))
    spans = orders.select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderkey").alias("document_id"), F.lit(6).alias("start"), (F.length("o_orderpriority") + 6).alias("end"))
    return R.packed(spans, docs, before=4, after=10).select("entry_id", "target_reference", "context_start", "context_block")


@query("""
WITH a AS (SELECT o_orderstatus AS decision, o_orderpriority AS kind, (o_custkey % 4)::VARCHAR AS source, CASE WHEN o_orderkey % 5 = 0 THEN 'bad span' END AS issue FROM orders)
SELECT 'kind' AS part, kind AS name, decision, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'source', source, decision, count(*) FROM a GROUP BY ALL UNION ALL SELECT 'issue', issue, decision, count(*) FROM a WHERE issue IS NOT NULL GROUP BY ALL
""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("decision"), F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 4).cast("string").alias("source"), F.when(F.col("o_orderkey") % 5 == 0, "bad span").alias("issue"))
    return R.audit_summary(rows)


@query("""
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5
""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.seeded(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 5, 42, ["source"])


def negative_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 characters of documents that hold no digit; tested against brute force."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = F.split("text", "[0-9]+", -1)
    found = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    before = lambda i: F.aggregate(F.slice(F.col("p"), F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(F.col("f"), F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    rows = docs.select("doc_id", pieces.alias("p"), found.alias("f"), F.posexplode(found).alias("i", "m"))
    spans = rows.select("doc_id", before(F.col("i")).cast("long").alias("start"), F.length("m").cast("long").alias("size")).select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"))
    return Z.negative_windows(docs.select("doc_id", F.length("text").alias("size")), spans, "doc_id", 200, 3)


query()(negative_windows)


@query("""
SELECT o_orderkey FROM orders WHERE o_custkey % 3 > 0 AND o_orderkey % 2 = 0
""")
def weak_evidence_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.lit("1/2000 Sb.")).alias("law_id"), F.when(F.col("o_orderkey") % 2 == 0, 0.72).otherwise(0.99).alias("confidence"), F.lit("Level 3B: Citation Chain Carryover").alias("stage"))
    return R.weak_evidence(rows, ("Level 3",)).select("o_orderkey")
