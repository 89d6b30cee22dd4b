"""Queries of the text operators, over whole texts of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.functions import text as T
from citeloom.operators.work import spread

_FOLD = "strip_accents(replace(text, 'ß', '~'))"


@query(f"SELECT doc_id, sha256(regexp_replace(upper({_FOLD}), '[^A-Z0-9]+', '', 'g')) AS key_hash FROM documents")
def compact_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(T.compact_key(F.translate("text", "ß", "~")), 256).alias("key_hash"))


@query(f"SELECT doc_id, sha256({_FOLD}) AS folded_hash, length({_FOLD}) AS n_chars FROM documents")
def ascii_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("folded", T.ascii_fold(F.translate("text", "ß", "~")))
    return docs.select("doc_id", F.sha2("folded", 256).alias("folded_hash"), F.length("folded").cast("long").alias("n_chars"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squeezed_hash FROM documents")
def squeeze_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.squeeze(F.col("text")), 256).alias("squeezed_hash"))


_STOP = ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS))


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower({_FOLD}), '[a-z0-9á-ž]+'), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({_STOP})) AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, sha256(array_to_string(t, ' ')) AS tokens_hash FROM w
""")
def topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.translate("text", "ß", "~")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("tokens_hash"))


_LINES = "CASE WHEN length(text) > 0 THEN list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: trim(x, ' ')) ELSE [] END"


def _features_sql() -> str:
    def those(test: str) -> str:
        return f"CASE WHEN len(f) > 0 THEN len(list_filter(f, lambda x: {test})) / len(f) ELSE 0 END"

    return f"""
SELECT doc_id, n AS char_count, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS token_count,
  CASE WHEN n > 0 THEN length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / n ELSE 0 END AS alnum_ratio,
  CASE WHEN n > 0 THEN (n - length(regexp_replace(text, '\\s', '', 'g'))) / n ELSE 0 END AS whitespace_ratio,
  len(l) AS line_count, len(f) AS nonempty_line_count,
  CASE WHEN len(f) > 0 THEN coalesce(list_sum(list_transform(f, lambda x: length(x))), 0) / len(f) ELSE 0 END AS avg_line_length,
  {those("length(x) <= 20")} AS short_line_ratio, {those("length(x) <= 3")} AS tiny_line_ratio,
  CASE WHEN len(f) > 0 THEN (len(f) - len(list_distinct(f))) / len(f) ELSE 0 END AS duplicate_line_ratio
FROM (SELECT doc_id, text, length(text) AS n, {_LINES} AS l, list_filter({_LINES}, lambda x: length(x) > 0) AS f FROM documents)"""


_SHOWN = ("char_count", "token_count", "alnum_ratio", "whitespace_ratio", "line_count", "nonempty_line_count", "avg_line_length", "short_line_ratio", "tiny_line_ratio", "duplicate_line_ratio")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", *[c.alias(n) for n, c in T.quality_features(F.coalesce("text", F.lit(""))).items()])


@query(f"SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' if 'ratio' in c or 'avg' in c else c for c in _SHOWN)} FROM ({_features_sql()})")
def text_quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) if "ratio" in c or "avg" in c else F.col(c) for c in _SHOWN]
    return _features(spark, sf_dir).select("doc_id", *rounded)


@query(f"""
WITH q AS ({_features_sql()})
SELECT doc_id, CASE WHEN char_count < 500 OR token_count < 50 THEN 'empty_or_short'
  WHEN alnum_ratio < 0.45 OR duplicate_line_ratio > 0.2 OR (avg_line_length < 18 AND short_line_ratio > 0.55) OR short_line_ratio > 0.35 OR whitespace_ratio > 0.3
    OR page_ratio > 0.08 OR moji > 0 OR hyphens * 10000 / char_count > 12 THEN 'artifacts' ELSE 'readable' END AS category
FROM q JOIN (SELECT doc_id, CASE WHEN len(f) > 0 THEN len(list_filter(f, lambda x: regexp_full_match(lower(x), '([0-9]+|strana\\s+[0-9]+|-\\s*[0-9]+\\s*-)'))) / len(f) ELSE 0 END AS page_ratio,
  len(regexp_extract_all(text, '[ÃÂÄÅ]')) AS moji, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]-\\s*\\n\\s*[\\p{{L}}\\p{{N}}\\p{{M}}_]')) AS hyphens
  FROM (SELECT doc_id, text, list_filter({_LINES}, lambda x: length(x) > 0) AS f FROM documents)) USING (doc_id)
""")
def text_quality_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    category, _ = T.quality_class()
    return _features(spark, sf_dir).select("doc_id", category.alias("category"))


@query("""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
g AS (SELECT doc_id, line, count(*) AS times FROM l WHERE length(line) > 0 GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, count(*) AS repeated_lines, sum(times)::BIGINT AS occurrences, min(sha256(line)) AS first_hash FROM g GROUP BY doc_id
""")
def repeated_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).filter("length(line) > 0")
    often = lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("times")).filter("times >= 2")
    return often.groupBy("doc_id").agg(F.count(F.lit(1)).alias("repeated_lines"), F.sum("times").alias("occurrences"), F.min(F.sha2("line", 256)).alias("first_hash"))


@query("""
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('audit_v1:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20
""")
def sha_sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.concat(F.lit("audit_v1:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return docs.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("h", "doc_id"))).filter("r <= 20").select("source", "doc_id")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN (l_partkey % 100) <= 30 THEN concat(l_suppkey + 1, '/20', lpad((l_partkey % 100)::VARCHAR, 2, '0'), ' Sb.') ELSE concat(l_suppkey + 1, '/19', lpad((l_partkey % 100)::VARCHAR, 2, '0'), ' Sb.') END AS law_id FROM lineitem
""")
def law_id_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat((F.col("l_suppkey") + 1).cast("string"), F.lit("/"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"), F.lit("  Sb."))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.law_id(raw).alias("law_id"))


@query("""
WITH RECURSIVE v(i, val, num) AS (VALUES (1, 1000, 'M'), (2, 900, 'CM'), (3, 500, 'D'), (4, 400, 'CD'), (5, 100, 'C'), (6, 90, 'XC'), (7, 50, 'L'), (8, 40, 'XL'), (9, 10, 'X'), (10, 9, 'IX'), (11, 5, 'V'), (12, 4, 'IV'), (13, 1, 'I')),
n AS (SELECT DISTINCT p_size AS number FROM part), r AS (
  SELECT number, number AS rest, 1 AS i, '' AS out FROM n UNION ALL
  SELECT number, (rest % val)::INT, r.i + 1, out || repeat(num, (rest // val)::INT) FROM r JOIN v ON v.i = r.i)
SELECT number::BIGINT AS number, out AS numeral FROM r WHERE i = 14
""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("number")).distinct()
    return sizes.select("number", T.roman(F.col("number")).alias("numeral"))


@query("""
WITH h AS (SELECT doc_id, text, position(' ' IN text) AS p FROM documents)
SELECT doc_id, sha256(replace(substr(text, greatest(0, p - 1 - 40) + 1, (p + 40) - greatest(0, p - 1 - 40)), chr(10), ' ')) AS window_hash FROM h WHERE p > 0
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("p", F.position(F.lit(" "), F.col("text"))).filter("p > 0")
    return docs.select("doc_id", F.sha2(T.context(F.col("text"), F.col("p") - 1, F.col("p"), 40), 256).alias("window_hash"))


@query("""
SELECT lang, source, count(*) AS documents, round(median(n), 3) AS median_chars, round(avg(n), 3) AS mean_chars FROM (SELECT lang, source, length(text) AS n FROM documents) GROUP BY ALL
""")
def median_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.length("text").alias("n"))
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"), F.round(F.median("n"), 3).alias("median_chars"), F.round(F.avg("n"), 3).alias("mean_chars"))


PHRASE = "all rights reserved"


@query(f"""
SELECT doc_id, position('{PHRASE}' IN t) AS first_at FROM (SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) WHERE contains(t, '{PHRASE}')
""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.regexp_replace("text", r"(?U)\s+", " ")).alias("t"))
    return docs.filter(F.contains("t", F.lit(PHRASE))).select("doc_id", F.position(F.lit(PHRASE), F.col("t")).cast("long").alias("first_at"))
