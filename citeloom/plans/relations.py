"""Queries of joins, windows, set operations and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.operators import evaluation as E
from citeloom.operators import joins as J


@query("""
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -1 END AS k1, c_nationkey AS k2 FROM customer),
e AS (SELECT s_suppkey AS k1, min(s_name) AS v FROM supplier GROUP BY 1), l AS (SELECT s_nationkey AS k2, min(s_name) AS v FROM supplier GROUP BY 1 HAVING min(s_name) = max(s_name))
SELECT c_custkey, coalesce(e.v, l.v) AS name FROM x LEFT JOIN e USING (k1) LEFT JOIN l USING (k2)
""")
def metadata_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(-1).alias("k1"), F.col("c_nationkey").alias("k2"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k1"), F.col("s_nationkey").alias("k2"), F.col("s_name").alias("name"))
    return J.with_fallback(left, right, "k1", "k2", "name").select("c_custkey", "name")


@query("""
WITH v AS (SELECT DISTINCT l_suppkey % 50 AS law, CAST(l_shipdate AS DATE)::VARCHAR AS since FROM lineitem),
o AS (SELECT o_orderkey, o_custkey % 50 AS law, CAST(o_orderdate AS DATE)::VARCHAR AS at FROM orders)
SELECT o_orderkey, since AS version FROM o ASOF LEFT JOIN v ON o.law = v.law AND o.at >= v.since
""")
def asof_law_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("law"), F.to_date("l_shipdate").cast("string").alias("since")).distinct().withColumn("version", F.col("since"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("law"), F.to_date("o_orderdate").cast("string").alias("at"))
    return J.as_of(orders, versions, "law", "at", "since", "version").select("o_orderkey", "version")


_SPANS = "SELECT user_id AS doc, event_id AS id, event_type, (floor(epoch(ts))::BIGINT % 5000) AS s, (floor(epoch(ts))::BIGINT % 5000) + 20 + event_id % 90 AS e FROM events"


@query(f"""
WITH x AS ({_SPANS}) SELECT a.doc, a.id AS l_id, b.id AS r_id FROM x a JOIN x b ON a.doc = b.doc AND a.s < b.e AND a.e > b.s WHERE a.id % 2 = 0 AND b.id % 2 = 1
""")
def span_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).select("doc", "id", "start", "end")
    return J.overlapping(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), "doc", width=200).select("doc", "l_id", "r_id")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_timestamp("ts") % 5000
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), start.alias("start"), (start + 20 + F.col("event_id") % 90).alias("end"))


@query(f"""
WITH x AS ({_SPANS}) SELECT a.doc, a.id FROM x a WHERE a.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM x b WHERE b.id % 2 = 1 AND a.doc = b.doc AND a.s < b.e AND a.e > b.s)
""")
def interval_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).select("doc", "id", "start", "end")
    hits = J.overlapping(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), "doc", width=200).select("doc", F.col("l_id").alias("id")).distinct()
    return rows.filter("id % 2 = 0").select("doc", "id").join(hits, ["doc", "id"], "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def keyset_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(keys, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("""
WITH g AS (SELECT l_partkey % 40 AS k, l_returnflag AS f, row_number() OVER (PARTITION BY l_partkey % 40, l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_quantity > 25),
p AS (SELECT l_partkey % 40 AS k, l_returnflag AS f, row_number() OVER (PARTITION BY l_partkey % 40, l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_discount > 0.04)
SELECT k, f, sum((g.n IS NOT NULL AND p.n IS NOT NULL)::INT)::BIGINT AS tp, sum((g.n IS NULL)::INT)::BIGINT AS fp, sum((p.n IS NULL)::INT)::BIGINT AS fn FROM g FULL JOIN p USING (k, f, n) GROUP BY k, f
""")
def multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("k"), F.col("l_returnflag").alias("f"), "l_quantity", "l_discount")
    out = E.outcomes(rows.filter("l_quantity > 25"), rows.filter("l_discount > 0.04"), ["k", "f"])
    return out.groupBy("k", "f").agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "FN")])


@query("""
WITH w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS t FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS t FROM documents),
n AS (SELECT item_id, count(*) AS m FROM w GROUP BY 1)
SELECT doc_id, item_id, round(score, 6) AS score FROM (SELECT doc_id, item_id, count(*) / sqrt(any_value(m)) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(count(*) / sqrt(any_value(m)), 9) DESC, item_id) AS r FROM d JOIN w USING (t) JOIN n USING (item_id) GROUP BY doc_id, item_id) WHERE r <= 3
""")
def token_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("tokens")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("q_id"), words)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n_id"), words)
    return J.token_shortlist(docs, items, 3).select(F.col("q_id").alias("doc_id"), F.col("n_id").alias("item_id"), F.round("score", 6).alias("score"))


@query("""
SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order FROM orders
""")
def version_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(along).alias("next_order"))


@query("""
SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hint FROM events
""")
def docref_hints_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = J.carried(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), ["user_id"], ["ts", "event_id"])
    return table(spark, sf_dir, "events").select("user_id", "event_id", hint.alias("hint"))


@query("""
SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 1400 PRECEDING AND 1 PRECEDING) AS strong_before FROM (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events)
""")
def distance_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = W.partitionBy("user_id").orderBy("s").rangeBetween(-1400, -1)
    return table(spark, sf_dir, "events").withColumn("s", F.unix_timestamp("ts")).select("user_id", "event_id", F.count(F.lit(1)).over(near).alias("strong_before"))


@query("""
WITH x AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), y AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'both' AS part, k FROM (SELECT k FROM x INTERSECT SELECT k FROM y) UNION ALL SELECT 'only_f', k FROM (SELECT k FROM x EXCEPT SELECT k FROM y) UNION ALL SELECT 'only_o', k FROM (SELECT k FROM y EXCEPT SELECT k FROM x)
""")
def key_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    x, y = (orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    parts = [("both", x.intersect(y)), ("only_f", x.subtract(y)), ("only_o", y.subtract(x))]
    return parts[0][1].select(F.lit("both").alias("part"), "k").union(parts[1][1].select(F.lit("only_f"), "k")).union(parts[2][1].select(F.lit("only_o"), "k"))


@query("""
SELECT o_orderkey, coalesce(s_acctbal, o_totalprice) AS price, coalesce(s_name, o_orderpriority) AS label FROM orders LEFT JOIN supplier ON o_orderkey = s_suppkey
""")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("label"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_orderkey"), F.col("s_acctbal").alias("price"), F.col("s_name").alias("label"))
    return J.overlay(base, new, "o_orderkey", ["price", "label"])


@query(f"""
WITH RECURSIVE x AS (SELECT doc, event_type AS kind, s, e, row_number() OVER (PARTITION BY doc ORDER BY s, s - e, event_type) AS r FROM ({_SPANS})),
f(doc, r, last, kept) AS (SELECT doc, r, e, true FROM x WHERE r = 1 UNION ALL SELECT x.doc, x.r, CASE WHEN x.s >= f.last THEN x.e ELSE f.last END, x.s >= f.last FROM f JOIN x ON x.doc = f.doc AND x.r = f.r + 1)
SELECT doc, kind, s AS start, e AS "end" FROM f JOIN x USING (doc, r) WHERE kept
""")
def span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.segments(_spans(spark, sf_dir).select("doc", "kind", "start", "end"), "doc")


@query(f"""
WITH RECURSIVE x AS (SELECT doc, s, e, row_number() OVER (PARTITION BY doc ORDER BY s, e) AS r FROM ({_SPANS})),
f(doc, r, a, b) AS (SELECT doc, r, s, e FROM x WHERE r = 1 UNION ALL SELECT x.doc, x.r, CASE WHEN x.s <= f.b AND greatest(x.e, f.b) - f.a <= 300 THEN f.a ELSE x.s END, CASE WHEN x.s <= f.b AND greatest(x.e, f.b) - f.a <= 300 THEN greatest(x.e, f.b) ELSE x.e END FROM f JOIN x ON x.doc = f.doc AND x.r = f.r + 1),
w AS (SELECT doc, r, a, b, CASE WHEN lag(a) OVER p = a AND (lag(b) OVER p) <= b AND lag(r) OVER p = r - 1 THEN 0 ELSE 1 END AS fresh FROM f WINDOW p AS (PARTITION BY doc ORDER BY r)),
n AS (SELECT doc, r, a, b, sum(fresh) OVER (PARTITION BY doc ORDER BY r) AS k FROM w)
SELECT doc, min(a) AS start, max(b) AS "end" FROM n GROUP BY doc, k
""")
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merged_windows(_spans(spark, sf_dir).select("doc", "start", "end"), "doc", 300)


@query(f"""
WITH RECURSIVE x AS ({_SPANS}), p AS (SELECT doc, id, s, e, row_number() OVER (PARTITION BY doc ORDER BY s, id) AS r FROM x WHERE id % 2 = 0), g AS (SELECT doc, id, s, e FROM x WHERE id % 2 = 1),
f(doc, r, p_id, g_id, used) AS (SELECT DISTINCT doc, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM p UNION ALL
  SELECT doc, r, p_id, best, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END FROM (
    SELECT p.doc, p.r, p.id AS p_id, f.used, max_by(g.id, (least(p.e, g.e) - greatest(p.s, g.s)) * 1000000000000 - g.s * 10000000 - g.id) AS best
    FROM f JOIN p ON p.doc = f.doc AND p.r = f.r + 1 LEFT JOIN g ON g.doc = p.doc AND g.s < p.e AND g.e > p.s AND NOT list_contains(f.used, g.id) GROUP BY p.doc, p.r, p.id, f.used))
SELECT doc, p_id, g_id FROM f WHERE g_id IS NOT NULL
""")
def greedy_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).select("doc", F.when(F.col("id") % 2 == 0, "p").otherwise("g").alias("side"), "id", "start", "end")
    return E.greedy_overlap(rows, "doc")


@query("""
SELECT conv_id, turn, role, sum(fresh)::BIGINT AS island FROM (SELECT a.conv_id, a.turn, a.role, b.fresh FROM (SELECT conv_id, turn, role FROM conversations) a JOIN (SELECT conv_id, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS fresh FROM conversations) b ON a.conv_id = b.conv_id AND b.turn <= a.turn) GROUP BY ALL
""")
def item_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("fresh", F.when(F.lag("role").over(along) == F.col("role"), 0).otherwise(1))
    return rows.select("conv_id", "turn", "role", F.sum("fresh").over(along).alias("island"))


@query("""
SELECT bucket, doc_id FROM (SELECT bucket, doc_id, row_number() OVER (PARTITION BY bucket ORDER BY h, doc_id) AS r FROM (
  SELECT CASE WHEN n < 600 THEN 1 WHEN n < 2000 THEN 2 WHEN n < 6000 THEN 3 ELSE 4 END AS bucket, doc_id, h FROM (SELECT doc_id, length(text) AS n, sha256('quota:' || doc_id) AS h FROM documents))) WHERE r <= 5 * bucket
""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(n < 600, 1).when(n < 2000, 2).when(n < 6000, 3).otherwise(4).alias("bucket"), F.sha2(F.concat(F.lit("quota:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return docs.withColumn("r", F.row_number().over(W.partitionBy("bucket").orderBy("h", "doc_id"))).filter("r <= 5 * bucket").select("bucket", "doc_id")


@query("""
SELECT doc_id, least(40, n // 100) + least(30, d * 3) + CASE WHEN p > 0 THEN 30 ELSE 0 END AS score FROM (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[0-9]{2,}')) AS d, position(chr(10) IN text) AS p FROM documents)
""")
def doc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, digits = F.floor(F.length("text") / 100), F.regexp_count("text", F.lit("[0-9]{2,}")) * 3
    score = F.least(F.lit(40), size) + F.least(F.lit(30), digits) + F.when(F.position(F.lit("\n"), F.col("text")) > 0, 30).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", score.cast("long").alias("score"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS label, row_number() OVER (ORDER BY p_size % 4, p_partkey) AS position FROM part
""")
def custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, ("high", "medium", "low", "none")))
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("o"))
    return J.positions(parts, "o", "p_partkey").select("p_partkey", F.get(labels, F.col("o")).alias("label"), "position")


@query("""
SELECT o_orderkey, sha1(concat(o_orderpriority, chr(10), o_orderstatus)) AS entry_id FROM orders
""")
def entry_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha1(F.concat("o_orderpriority", F.lit("\n"), "o_orderstatus")).alias("entry_id"))


