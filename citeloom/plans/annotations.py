"""Queries of annotation, baseline and review-queue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.operators import annotation as N
from citeloom.operators import citations as C


@query("""
SELECT o_orderkey, 100 + length('podle ' || repeat('x ', (o_custkey % 4)::INT)) AS anchor FROM orders
""")
def gold_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("podle "), F.repeat(F.lit("x "), (F.col("o_custkey") % 4).cast("int")), F.lit("§ 5a odst. 1"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("surface"))
    return rows.select("o_orderkey", N.anchor_start(F.lit(100), F.col("surface"), F.lit("section"), F.lit("5a"), F.lit(None).cast("string")).cast("long").alias("anchor"))


@query("""
SELECT o_orderkey, replace(v.target, '{n}', (o_custkey % 300 + 1)::VARCHAR) AS target, v.occurrence FROM orders, (VALUES ('§ {n}', 1), ('§ {n}', 2), ('čl. 3{n}', 1)) v(target, occurrence)
""")
def annotation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.lit("Podle § {n} a znovu § {n} i čl. 3{n} platí"), F.lit("{n}"), (F.col("o_custkey") % 300 + 1).cast("string"))
    return N.tasks(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), ("o_orderkey",)).select("o_orderkey", "target", "occurrence")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 2 THEN NULL ELSE 50 + (o_custkey % 3) * 6 END AS start_char, CASE WHEN o_custkey % 3 = 2 THEN 'text_not_in_snippet' END AS error FROM orders
""")
def finalized_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("§ 1 a § 1 b").alias("snippet"), F.lit(50).alias("snippet_start"), F.lit("§ 1").alias("finding_text"), (F.col("o_custkey") % 3 + 1).cast("int").alias("occurrence"), F.lit("czech_resolved").alias("classification"))
    good, bad = N.finalized(rows)
    return good.select("o_orderkey", F.col("start_char").cast("long").alias("start_char"), F.lit(None).cast("string").alias("error")).unionByName(bad.select("o_orderkey", F.lit(None).cast("long").alias("start_char"), "error"))


@query("""
SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'missing_prediction' WHEN 1 THEN 'wrong_law' ELSE 'low_confidence' END AS reason FROM orders
""")
def fallback_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 3
    same = F.lit("x")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("g_id"), F.when(k > 0, 1).alias("p_id"), same.alias("g_class"), same.alias("p_class"), same.alias("g_law"), F.when(k == 1, "y").otherwise("x").alias("p_law"), same.alias("g_detail"), same.alias("p_detail"), F.lit(0.6).alias("p_confidence"))
    return N.fallback_reason(rows).select("o_orderkey", "reason")


@query("""
SELECT o_orderkey, concat(o_custkey % 90 + 1, '/2003 Sb.') AS law_id FROM orders
""")
def simple_law_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("viz § 7 zákona č. "), (F.col("o_custkey") % 90 + 1).cast("string"), F.lit("/03 Sb. a dále daleko jiný zákon č. 1/1999 Sb."))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return N.simple_laws(docs, ("o_orderkey",), {"obč. zák.": "40/1964 Sb."}).select("o_orderkey", "law_id")


@query("""
SELECT o_orderkey AS ref_id, s_suppkey AS document_id FROM orders JOIN supplier ON o_custkey % 150 = s_suppkey
""")
def strict_baseline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), F.lit(-1).cast("long").alias("document_id"), F.concat(F.lit("21 cdo "), (F.col("o_custkey") % 150).cast("string"), F.lit("/2001")).alias("body"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"), F.concat(F.lit("21 Cdo "), F.col("s_suppkey").cast("string"), F.lit(" / 2001")).alias("name"))
    return N.strict_links(refs, names)


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'link_disambiguation' WHEN o_custkey % 4 = 1 OR o_custkey % 4 = 2 THEN 'link_normalization_or_target_recovery' END AS route FROM orders
""")
def hard_case_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 4
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 1, "29 NSČR 5/2010").otherwise("x").alias("body"), F.when(k == 0, 2).otherwise(0).alias("a"), F.when(k == 2, 1).otherwise(0).alias("b"))
    return rows.select("o_orderkey", N.hard_case_route(F.col("body"), F.col("a"), F.col("b")).alias("route"))


@query("""
SELECT o_orderkey, 19 + l AS start, concat('5 As ', n, '/2002') AS text, 'bare_court_case' AS category FROM (SELECT o_orderkey, o_custkey % 90 AS n, length((o_custkey % 90)::VARCHAR) AS l FROM orders)
UNION ALL SELECT o_orderkey, 32 + 2 * l, concat('č. j. 12-34/', n), 'prefixed_anchor' FROM (SELECT o_orderkey, o_custkey % 90 AS n, length((o_custkey % 90)::VARCHAR) AS l FROM orders)
""")
def gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_custkey") % 90).cast("string")
    text = F.concat(F.lit("viz 21 Cdo "), n, F.lit("/2001 a 5 As "), n, F.lit("/2002 "), F.lit("i č. j. 12-34/"), n, F.lit(", ze dne 1. 1. 2001"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    covered = docs.select("o_orderkey", F.lit(4).alias("start"), (F.length("text") * 0 + 15).cast("int").alias("end"))
    found = N.gap_candidates(docs, covered, "o_orderkey", 5, (*N.BARE_CATEGORIES, "prefixed_anchor"))
    return found.select("o_orderkey", "start", "text", "category")


@query("""
SELECT s_suppkey AS ref_id, CASE WHEN s_suppkey % 2 = 0 THEN 'exact_match_exists' WHEN s_suppkey % 3 = 0 THEN 'very_similar' ELSE 'absent' END AS suspicion FROM supplier
""")
def not_in_corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref_id"))
    links = refs.filter("ref_id % 2 = 0")
    fuzzy = refs.filter("ref_id % 3 = 0").withColumn("score", F.lit(0.95))
    return N.not_in_corpus_audit(refs, links, fuzzy).select("ref_id", "suspicion")


_FEATURES = "list_filter(['l' || lang, CASE WHEN length(text) > 2000 THEN 'long' END, CASE WHEN position(chr(10) IN text) > 0 THEN 'lines' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END], lambda f: f IS NOT NULL)"


@query(f"""
WITH d AS (SELECT source, doc_id, length(text)::DOUBLE AS score, {_FEATURES} AS f FROM documents),
a AS (SELECT source, doc_id, f FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY len(f) DESC, score DESC, doc_id) AS r FROM d) WHERE r = 1),
b AS (SELECT source, doc_id FROM (SELECT d.*, row_number() OVER (PARTITION BY d.source ORDER BY len(list_filter(d.f, lambda x: NOT list_contains(a.f, x))) DESC, d.score DESC, d.doc_id) AS r FROM d JOIN a ON a.source IS NOT DISTINCT FROM d.source WHERE d.doc_id <> a.doc_id) WHERE r = 1)
SELECT source, 1 AS position, doc_id AS document_id FROM a UNION ALL SELECT source, 2, doc_id FROM b
""")
def greedy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    names = F.array(F.concat(F.lit("l"), "lang"), F.when(F.length(text) > 2000, "long"), F.when(F.position(F.lit("\n"), text) > 0, "lines"), F.when(text.rlike("[0-9]"), "digits"))
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("document_id"), F.length(text).cast("double").alias("score"), F.array_compact(names).alias("features"))
    return N.greedy_coverage(docs, "source", 2)


@query("""
SELECT o_orderkey AS doc, 1 AS page, concat('body ', o_custkey) AS text FROM orders UNION ALL SELECT o_orderkey, 2, concat('body two ', o_custkey, ' x') FROM orders UNION ALL SELECT o_orderkey, 3, concat('no notes', chr(10), '9 other') FROM orders
""")
def footer_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey").cast("string")
    pages = F.array(F.concat(F.lit("body "), n, F.lit("\n1 first note\n2 second note")), F.concat(F.lit("body two "), n, F.lit(" x\n3 third note")), F.lit("no notes\n9 other"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.posexplode(pages).alias("at", "text"))
    return N.cropped_footers(rows.select("doc", (F.col("at") + 1).alias("page"), "text"), "doc")


#: Passages by o_orderkey % 4 with {n} for a number: passage, text, offset that was told.
_REPAIRS = (("{n}abc", "{n}ab", 0), ("xxx {n}abc", "{n}abc", 0), ("{n} {n} {n}", "{n}", 7), ("abc{n}", "zz", 0))


@query("""
SELECT o_orderkey, CASE k WHEN 0 THEN 10 WHEN 1 THEN 14 WHEN 2 THEN 10 + l + 1 END AS start_char, CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'unique' WHEN 2 THEN 'nearest' ELSE 'not_found' END AS status
FROM (SELECT o_orderkey, o_orderkey % 4 AS k, length((o_custkey % 9000 + 10000)::VARCHAR) AS l FROM orders)
""")
def offset_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = (F.col("o_orderkey") % 4).cast("int"), (F.col("o_custkey") % 9000 + 10000).cast("string")

    def case(i: int):
        return F.get(F.array(*[F.lit(r[i]) for r in _REPAIRS]), k)

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.replace(case(0), F.lit("{n}"), n).alias("passage"), F.lit(10).alias("passage_start"), F.replace(case(1), F.lit("{n}"), n).alias("exact_text"), case(2).alias("start_offset"))
    return N.repaired_offsets(rows).select("o_orderkey", "start_char", "status")


_MINED = "(SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '7/2007 Sb.' END AS given, concat(o_custkey % 900 + 1, '/2001 Sb.') AS mined FROM orders)"


@query(f"""
SELECT o_orderkey, coalesce(given, mined) AS law_id, 'czech_resolved' AS classification, given IS NULL AS filled FROM {_MINED}
""")
def prefilled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Podle § 5 zákona č. "), (F.col("o_custkey") % 900 + 1).cast("string"), F.lit("/2001 Sb."))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), F.when(F.col("o_custkey") % 3 == 0, "7/2007 Sb.").alias("given"))
    done = F.when(F.col("given").isNotNull(), "czech_resolved")
    tasks = docs.select("o_orderkey", F.lit(6).alias("start"), F.lit("§ 5").alias("target"), F.col("given").alias("law_id"), done.alias("classification"))
    mined = C.law_occurrences(docs, ("o_orderkey",), fields=("start", "citation_text", "law_id", "classification"))
    return N.prefilled(tasks, mined, "o_orderkey").select("o_orderkey", "law_id", "classification", "filled")


@query("""
SELECT o_custkey AS document_id, o_orderkey % 3 AS number, count(*) > 0 AS kept FROM orders GROUP BY ALL
""")
def gold_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % 3).cast("string")
    none = F.lit(None).cast("string")
    gold = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), "o_orderkey", ((F.col("o_orderkey") % 3) * 40).alias("start_char"), F.concat(F.lit("podle § "), k).alias("citation_text"), F.lit("section").alias("citation_type"), F.lit("czech_unresolved").alias("classification"),
        none.alias("law_id"), k.alias("detail_number"), none.alias("detail_odst"), none.alias("detail_pism"),
    )
    return N.distinct_gold(gold, ["o_orderkey"]).select("document_id", F.col("detail_number").cast("long").alias("number"), F.lit(True).alias("kept"))


@query("""
SELECT v.variant, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0 AND v.a OR o_orderkey % 2 = 1 AND v.b) AS resolved FROM (VALUES ('full', true, true), ('without_global', false, true), ('without_seed', true, false)) v(variant, a, b)
""")
def resolver_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("podle § "), (F.col("o_custkey") % 300 + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " ZOHS").otherwise(" tr. ř."))
    docs = table(spark, sf_dir, "orders").groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("times"))
    layers = {"global": [("ZOHS", ["143/2001 Sb."], None)], "seed": [("tr. ř.", ["141/1961 Sb."], None)]}
    runs = N.ablations(lambda aliases: C.law_occurrences(docs, ("times",), aliases, fields=("law_id",)), layers)
    parts = [df.agg(F.coalesce(F.sum(F.when(F.col("law_id").isNotNull(), F.col("times"))), F.lit(0)).alias("resolved")).select(F.lit(name).alias("variant"), "resolved") for name, df in runs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
