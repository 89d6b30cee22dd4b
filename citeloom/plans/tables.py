"""Queries of aggregates, graph measures and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.operators import evaluation as E
from citeloom.operators import graph as G
from citeloom.operators.work import dealt, tasks_of


@query("SELECT lang, source, count(*) AS documents, count(DISTINCT text) AS texts FROM documents GROUP BY ALL")
def counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


@query("""
SELECT o_orderstatus AS source, count(*) AS n, sum((o_totalprice > 150000)::INT)::BIGINT AS resolved, sum((o_totalprice <= 150000)::INT)::BIGINT AS unresolved, round(sum((o_totalprice > 150000)::INT) / count(*), 6) AS share FROM orders GROUP BY 1
""")
def resolved_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_totalprice") > 150000
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("resolved"), F.count_if(~done).alias("unresolved"), F.round(F.count_if(done) / F.count(F.lit(1)), 6).alias("share"))


@query("""
SELECT year(o_orderdate)::BIGINT AS decision_year, sum((o_orderstatus = 'F')::INT)::BIGINT AS f, sum((o_orderstatus = 'O')::INT)::BIGINT AS o, sum((o_orderstatus = 'P')::INT)::BIGINT AS p, count(*) AS total FROM orders GROUP BY 1
""")
def counts_by_year_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("decision_year")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return years.select("decision_year", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"), (F.col("F") + F.col("O") + F.col("P")).alias("total"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers cite suppliers through their orders' lines; a supplier is the customer of its number, so documents cite and are cited."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    tasks = tasks_of(lines)
    orders, lines = dealt(orders, "o_orderkey", tasks), dealt(lines, "l_orderkey", tasks)
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("tgt"))


_EDGES = "SELECT o_custkey AS src, l_suppkey AS tgt FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that joins of the edges are dealt into."""
    return tasks_of(table(spark, sf_dir, "lineitem"))


@query(f"SELECT src, tgt, count(*) AS weight FROM ({_EDGES}) GROUP BY ALL")
def collapsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.collapsed(_edges(spark, sf_dir))


@query(f"""
WITH e AS (SELECT src, tgt, count(*) AS w FROM ({_EDGES}) GROUP BY ALL), i AS (SELECT tgt AS node, count(*) AS a, sum(w)::BIGINT AS b FROM e GROUP BY 1), o AS (SELECT src AS node, count(*) AS c, sum(w)::BIGINT AS d FROM e GROUP BY 1)
SELECT coalesce(i.node, o.node) AS node, coalesce(a, 0) AS in_degree, coalesce(c, 0) AS out_degree, coalesce(b, 0) AS in_occurrences, coalesce(d, 0) AS out_occurrences FROM i FULL JOIN o ON i.node = o.node
""")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir))


@query(f"""
WITH e AS (SELECT src, tgt, count(*) AS w FROM ({_EDGES}) GROUP BY ALL)
SELECT tgt AS node, count(*) AS in_degree, sum(w)::BIGINT AS occurrences FROM e GROUP BY 1 ORDER BY in_degree DESC, occurrences DESC, node LIMIT 15
""")
def top_cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = G.collapsed(_edges(spark, sf_dir))
    return pairs.groupBy(F.col("tgt").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"), F.sum("weight").alias("occurrences")).orderBy(F.desc("in_degree"), F.desc("occurrences"), "node").limit(15)


@query(f"SELECT (src % 4)::VARCHAR AS src_group, sum((tgt % 4 = 0)::INT)::BIGINT AS g0, sum((tgt % 4 = 1)::INT)::BIGINT AS g1, sum((tgt % 4 = 2)::INT)::BIGINT AS g2, sum((tgt % 4 = 3)::INT)::BIGINT AS g3 FROM ({_EDGES}) GROUP BY 1")
def source_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct().withColumn("court", (F.col("node") % 4).cast("string"))
    counts = G.matrix(edges, nodes, "court", _tasks(spark, sf_dir)).groupBy("src_group").pivot("tgt_group", ["0", "1", "2", "3"]).sum("count").na.fill(0)
    return counts.select("src_group", *[F.col(str(i)).alias(f"g{i}") for i in range(4)])


@query(f"""
WITH n AS (SELECT node % 4 AS g, count(*) AS d FROM (SELECT src AS node FROM ({_EDGES}) UNION SELECT tgt FROM ({_EDGES})) GROUP BY 1)
SELECT src % 4 AS src_group, tgt % 4 AS tgt_group, round(count(*) / any_value(d) * 1000, 6) AS per_1000 FROM ({_EDGES}) JOIN n ON n.g = src % 4 GROUP BY ALL
""")
def matrix_per_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct().withColumn("court", F.col("node") % 4)
    sizes = nodes.groupBy(F.col("court").alias("src_group")).agg(F.count(F.lit(1)).alias("documents"))
    return G.matrix(edges, nodes, "court", _tasks(spark, sf_dir)).join(sizes, "src_group").select("src_group", "tgt_group", F.round(F.col("count") / F.col("documents") * 1000, 6).alias("per_1000"))


def _pagerank_sql(rounds: int) -> str:
    steps = []
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS (SELECT n.node, (1 - 0.85) / t.n + 0.85 * coalesce(l.lost, 0) / t.n + 0.85 * coalesce(f.got, 0) AS rank FROM n CROSS JOIN t "
            f"LEFT JOIN (SELECT tgt AS node, sum(rank * share) AS got FROM s JOIN r{i} ON r{i}.node = s.src GROUP BY 1) f ON f.node = n.node "
            f"CROSS JOIN (SELECT sum(rank) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM s)) l)"
        )
    return f"""
WITH e AS MATERIALIZED (SELECT src, tgt, count(*) AS w FROM ({_EDGES}) WHERE src <> tgt GROUP BY ALL), s AS MATERIALIZED (SELECT src, tgt, w / sum(w) OVER (PARTITION BY src) AS share FROM e),
n AS MATERIALIZED (SELECT src AS node FROM ({_EDGES}) UNION SELECT tgt FROM ({_EDGES})), t AS (SELECT count(*) AS n FROM n), r0 AS (SELECT node, 1 / t.n AS rank FROM n CROSS JOIN t),
{", ".join(steps)} SELECT node, round(rank / (SELECT sum(rank) FROM r{rounds}), 8) AS rank FROM r{rounds}"""


@query(_pagerank_sql(5))
def pagerank5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(_edges(spark, sf_dir), rounds=5, tolerance=None, tasks=_tasks(spark, sf_dir)).select("node", F.round("rank", 8).alias("rank"))


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + CASE WHEN c_custkey % 50 < 49 THEN 1 ELSE 0 END AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node
""")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nxt = F.col("c_custkey") + F.when(F.col("c_custkey") % 50 < 49, 1).otherwise(0)
    edges = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), nxt.alias("tgt"))
    return G.components(edges, edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct())


@query("""
SELECT CASE WHEN o_orderstatus = 'F' THEN 'exact_decision' ELSE 'same_proceeding' END AS scope, count(*) AS total, sum((o_custkey % 3 = 0)::INT)::BIGINT AS citing, sum((o_orderkey % 3 = 0)::INT)::BIGINT AS cited FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 3 = 0 GROUP BY 1
""")
def link_scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    office = lambda c: F.when(F.col(c) % 3 == 0, "uohs").otherwise("ns")
    links = table(spark, sf_dir, "orders").select(office("o_custkey").alias("source_source"), office("o_orderkey").alias("target_source"), F.when(F.col("o_orderstatus") == "F", "exact_decision").otherwise("same_proceeding").alias("target_scope"))
    return G.scope_summary(links, "uohs")


@query(f"""
WITH e AS (SELECT src, tgt, count(*) AS w FROM ({_EDGES}) GROUP BY ALL), h AS (SELECT tgt AS hub FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
(SELECT 'in' AS side, src AS node, w AS weight FROM e JOIN h ON tgt = hub ORDER BY w DESC, src LIMIT 10) UNION ALL (SELECT 'out', tgt, w FROM e JOIN h ON src = hub ORDER BY w DESC, tgt LIMIT 4)
""")
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ego(_edges(spark, sf_dir))


@query("""
SELECT c.c_custkey AS source_document, s.s_suppkey AS target_document, c.c_nationkey AS source_date, s.s_nationkey AS target_date, c.c_custkey % 3 = 0 AS is_same_proceeding FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey WHERE s.s_suppkey IS NOT NULL
""")
def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    links = customers.join(suppliers, customers["c_custkey"] == suppliers["s_suppkey"]).select(F.col("c_custkey").alias("source_document"), F.col("s_suppkey").alias("target_document"), F.when(F.col("c_custkey") % 3 == 0, "same_proceeding").otherwise("exact_decision").alias("target_scope"))
    docs = customers.select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("date"))
    named = suppliers.select(F.col("s_suppkey").alias("document_id"), F.col("s_nationkey").alias("date"))
    source = links.join(docs.withColumnsRenamed({"document_id": "source_document", "date": "source_date"}), "source_document", "left")
    return source.join(named.withColumnsRenamed({"document_id": "target_document", "date": "target_date"}), "target_document", "left").select("source_document", "target_document", "source_date", "target_date", (F.col("target_scope") == "same_proceeding").alias("is_same_proceeding"))


@query("""
WITH h AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="/([^"/?#]+)"', 1)) AS target FROM pages)
SELECT host, count(*) AS links, count(DISTINCT target) AS targets FROM h GROUP BY host
""")
def html_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"/?#]+)"'), F.lit(1))).alias("target"))
    return links.groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("target").alias("targets"))


# --- evaluation: labels as gold, a rule on the text as prediction ---

_PRED = "SELECT l.doc_id, l.quality, l.toxic, d.lang, (length(d.text) > 600)::INT AS guess, length(d.text) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("guess", (F.col("n") > 600).cast("int"))


@query(f"""
WITH c AS (SELECT lang, sum((quality = 1 AND guess = 1)::INT)::BIGINT AS tp, sum((quality = 0 AND guess = 1)::INT)::BIGINT AS fp, sum((quality = 1 AND guess = 0)::INT)::BIGINT AS fn FROM ({_PRED}) GROUP BY 1)
SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c
""")
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, g = F.col("quality") == 1, F.col("guess") == 1
    counts = _predicted(spark, sf_dir).groupBy("lang").agg(F.count_if(q & g).alias("tp"), F.count_if(~q & g).alias("fp"), F.count_if(q & ~g).alias("fn"))
    return counts.select("*", *[F.round(c, 6).alias(n) for n, c in E.rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


@query(f"""
WITH c AS (SELECT lang, sum((quality = guess)::INT) AS k, count(*) AS n FROM ({_PRED}) GROUP BY 1), z AS (SELECT *, k / n AS p, {E.Z} AS z FROM c)
SELECT lang, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM z
""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _predicted(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("quality") == F.col("guess")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return counts.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"SELECT quality, sum((guess = 0)::INT)::BIGINT AS guessed_0, sum((guess = 1)::INT)::BIGINT AS guessed_1 FROM ({_PRED}) GROUP BY 1")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _predicted(spark, sf_dir).groupBy("quality").pivot("guess", [0, 1]).count().na.fill(0)
    return counts.select("quality", F.col("0").alias("guessed_0"), F.col("1").alias("guessed_1"))


@query(f"SELECT (n // 1000)::BIGINT AS bucket, count(*) AS n, round(avg((quality = guess)::INT), 6) AS accuracy FROM ({_PRED.replace('length(d.text) AS n', 'length(d.text) AS n')}) GROUP BY 1")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = (F.col("quality") == F.col("guess")).cast("int")
    return _predicted(spark, sf_dir).groupBy(F.floor(F.col("n") / 1000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


@query(f"""
SELECT CASE WHEN toxic = 1 AND guess = 1 THEN 'exact_linked' WHEN toxic = 1 THEN 'exact_missed' WHEN quality = 0 AND guess = 1 THEN 'absent_linked' WHEN quality = 0 THEN 'absent_unlinked' WHEN guess = 1 THEN 'unknown_linked' ELSE 'unknown_unlinked' END AS outcome, count(*) AS n FROM ({_PRED}) GROUP BY 1
""")
def availability_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = F.when(F.col("guess") == 1, "linked")
    outcome = F.when(F.col("toxic") == 1, F.concat(F.lit("exact_"), F.coalesce(linked, F.lit("missed")))).when(F.col("quality") == 0, F.concat(F.lit("absent_"), F.coalesce(linked, F.lit("unlinked")))).otherwise(F.concat(F.lit("unknown_"), F.coalesce(linked, F.lit("unlinked"))))
    return _predicted(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH x AS (SELECT doc_id, unnest(list_filter([CASE WHEN quality <> guess THEN 'wrong_quality' END, CASE WHEN toxic = 1 AND guess = 1 THEN 'toxic_kept' END, CASE WHEN n < 100 THEN 'too_short' END], lambda v: v IS NOT NULL)) AS category FROM ({_PRED})),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY category) AS n FROM x)
SELECT category, doc_id AS example, n FROM r WHERE r <= 10
""")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = F.array(F.when(F.col("quality") != F.col("guess"), "wrong_quality"), F.when((F.col("toxic") == 1) & (F.col("guess") == 1), "toxic_kept"), F.when(F.col("n") < 100, "too_short"))
    rows = _predicted(spark, sf_dir).select("doc_id", F.explode(F.array_compact(tests)).alias("category"))
    by = W.partitionBy("category")
    ranked = rows.withColumn("r", F.row_number().over(by.orderBy("doc_id"))).withColumn("n", F.count(F.lit(1)).over(by))
    return ranked.filter("r <= 10").select("category", F.col("doc_id").alias("example"), "n")


@query("""
SELECT coalesce(g.k, p.k) AS k, CASE WHEN g.k IS NULL THEN 'FP' WHEN p.k IS NULL THEN 'FN' ELSE 'TP' END AS outcome FROM (SELECT doc_id AS k FROM labels WHERE toxic = 1) g FULL JOIN (SELECT doc_id AS k FROM documents WHERE length(text) < 700) p ON g.k = p.k
""")
def gold_pred_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("k"))
    guess = table(spark, sf_dir, "documents").filter("length(text) < 700").select(F.col("doc_id").alias("k"))
    return E.outcomes(gold, guess, ["k"])


@query(f"SELECT lang, count(*) AS n, round(avg((quality = guess)::INT), 6) AS accuracy, sum((toxic = guess)::INT)::BIGINT AS toxic_agree FROM ({_PRED}) GROUP BY ROLLUP (lang)")
def route_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = (F.col("quality") == F.col("guess")).cast("int")
    return _predicted(spark, sf_dir).rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.count_if(F.col("toxic") == F.col("guess")).alias("toxic_agree"))


@query("""
WITH a AS (SELECT count(*) AS n, sum((o_orderstatus = 'F')::INT) AS r FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 2 = 1), b AS (SELECT count(*) AS n, sum((o_orderstatus <> 'P')::INT) AS r FROM orders)
SELECT a.r::BIGINT AS before, b.r::BIGINT AS after, (b.r - a.r)::BIGINT AS delta, round(b.r / b.n - a.r / a.n, 6) AS share_delta FROM a, b
""")
def before_after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("before"), F.count_if(F.col("o_orderstatus") != "P").alias("after"))
    return both.select("before", "after", (F.col("after") - F.col("before")).alias("delta"), F.round((F.col("after") - F.col("before")) / F.col("n"), 6).alias("share_delta"))


@query("""
SELECT to_json({'n': count(*), 'customers': count(DISTINCT o_custkey), 'first': min(o_orderkey)})::VARCHAR AS summary FROM orders
""")
def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("first"))
    return one.select(F.to_json(F.struct("n", "customers", "first")).alias("summary"))


@query("""
SELECT o_orderstatus AS status, count(*) AS items, sum((o_orderpriority LIKE '1%')::INT)::BIGINT AS to_review, list_sort(list_distinct(list(o_orderpriority)))[1] AS first_priority FROM orders GROUP BY 1
""")
def item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("to_review"), F.min("o_orderpriority").alias("first_priority"))
