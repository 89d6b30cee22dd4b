"""Queries of the law-citation operators: sentences rendered from ``lineitem`` and ``orders`` and mined again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.functions import text as T
from citeloom.operators import aliases as A
from citeloom.operators import citations as C


def _law(part: str, year: str):
    return F.concat((F.col(part) % 900 + 1).cast("string"), F.lit("/"), F.year(year).cast("string"), F.lit(" Sb."))


_LAW_SQL = "concat(l_partkey % 900 + 1, '/', year(l_shipdate), ' Sb.')"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each order line: a citation with details of a law by number."""
    items = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("Soud odkazuje na § "), F.col("l_linenumber").cast("string"), F.lit(" odst. "), (F.col("l_quantity") % 5 + 1).cast("int").cast("string"), F.lit(" písm. a) zákona č. "), _law("l_partkey", "l_shipdate"))
    return items.select("l_orderkey", "l_linenumber", text.alias("text"))


@query(f"""
SELECT law_id, n AS citations FROM (SELECT {_LAW_SQL} AS law_id, count(*) AS n FROM lineitem GROUP BY ALL) ORDER BY n DESC, law_id LIMIT 15
""")
def top_cited_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = C.law_anchors(_sentences(spark, sf_dir), "l_orderkey")
    return laws.groupBy("law_id").agg(F.count(F.lit(1)).alias("citations")).orderBy(F.desc("citations"), "law_id").limit(15)


@query(f"""
SELECT l_orderkey, l_linenumber, {_LAW_SQL} AS law_id, l_linenumber::VARCHAR AS number, ((l_quantity % 5)::INT + 1)::VARCHAR AS odst, 'a' AS pism, 'Level 1: Direct Match' AS stage, 0.99 AS confidence FROM lineitem
""")
def law_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.law_occurrences(_sentences(spark, sf_dir), ("l_orderkey", "l_linenumber"), fields=("citation_type", "law_id", "number", "odst", "pism", "stage", "confidence")).filter("citation_type = 'section'")
    return found.select("l_orderkey", "l_linenumber", "law_id", "number", F.array_join("odst", ",").alias("odst"), F.array_join("pism", ",").alias("pism"), "stage", "confidence")


@query(f"""
SELECT law_id, number, count(*) AS citations FROM (SELECT {_LAW_SQL} AS law_id, l_linenumber::VARCHAR AS number FROM lineitem) GROUP BY ALL ORDER BY citations DESC, law_id, number LIMIT 25
""")
def top_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _sentences(spark, sf_dir).groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    found = C.law_occurrences(texts, ("times",), fields=("citation_type", "law_id", "number")).filter("citation_type = 'section'")
    return found.groupBy("law_id", "number").agg(F.sum("times").alias("citations")).orderBy(F.desc("citations"), "law_id", "number").limit(25)


@query("""
SELECT o_orderkey % 30 AS document, concat(o_custkey % 5000 + 1, '/2000 Sb.') AS law_id, count(*) AS citations FROM orders GROUP BY ALL
""")
def dictionary_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty long documents, each with a citation for each of its orders, and a dictionary of 5,000 names."""
    names = [(f"zákon o věci {i} a jiných", [f"{i}/2000 Sb."], None) for i in range(1, 5001)]
    sentence = F.concat(F.lit("Podle § "), (F.col("o_orderkey") % 900 + 1).cast("string"), F.lit(" zákona o věci "), (F.col("o_custkey") % 5000 + 1).cast("string"), F.lit(" a jiných rozhodl."))
    docs = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 30).alias("document")).agg(F.array_join(F.collect_list(sentence), " ").alias("text"))
    found = C.law_occurrences(docs, ("document",), names, fields=("law_id",))
    return found.groupBy("document", "law_id").agg(F.count(F.lit(1)).alias("citations"))


@query("""
SELECT o_orderkey, g.n AS number FROM orders, LATERAL (SELECT unnest(generate_series(o_custkey % 7 + 1, o_custkey % 7 + 1 + o_orderkey % 4))::VARCHAR AS n) g
""")
def range_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("o_custkey") % 7 + 1
    text = F.concat(F.lit("Podle § 9 odst. "), low.cast("string"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit(" až "), (low + F.col("o_orderkey") % 4).cast("string"))).otherwise(""), F.lit(" zákona č. 1/2000 Sb."))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return C.law_occurrences(docs, ("o_orderkey",)).filter("citation_type = 'section'").select("o_orderkey", F.explode("odst").alias("number"))


@query("SELECT o_orderkey, (o_custkey % 200 + k)::VARCHAR AS number FROM orders, (VALUES (1), (2), (4)) v(k)")
def group_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second, third = ((F.col("o_custkey") % 200 + k).cast("string") for k in (1, 2, 4))
    text = F.concat(F.lit("Podle § "), first, F.lit(", "), second, F.lit(" a "), third, F.lit(" zákona č. 99/1963 Sb."))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return C.law_occurrences(docs, ("o_orderkey",), fields=("citation_type", "law_id", "number")).filter("citation_type = 'section' and law_id = '99/1963 Sb.'").select("o_orderkey", "number")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'non_citation' ELSE 'czech_resolved' END AS classification, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat(o_custkey % 900 + 1, '/2004 Sb.') END AS law_id FROM orders
""")
def law_mention_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat((F.col("o_custkey") % 900 + 1).cast("string"), F.lit("/2004 Sb."))
    text = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("publikováno pod č. "), number, F.lit(" NSS"))).otherwise(F.concat(F.lit("podle zákona č. "), number))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return C.law_occurrences(docs, ("o_orderkey",)).filter("citation_type = 'other_normative'").select("o_orderkey", "classification", "law_id")


@query("""
SELECT o_orderkey, concat(o_custkey % 900 + 1, '/1999 Sb.') AS law_id FROM orders
""")
def amendment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("novela zákona č. 7/2003 Sb. mění § 5 zákona č. "), (F.col("o_custkey") % 900 + 1).cast("string"), F.lit("/1999 Sb., ve znění zákona č. 8/2004 Sb."))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return C.law_occurrences(docs, ("o_orderkey",)).filter("citation_type = 'section'").select("o_orderkey", "law_id")


#: Texts by o_orderkey % 10, with {n} for a number of the order; dates of some.
_CASES = (
    ("čl. {n} a 390 Ústavy", None), ("Podle § {n} ZOHS", None), ("porušení čl. {n} Smlouvy o fungování Evropské unie", None), ("§ {n}f ve spojení s § 620 odst. 1 písm. a) a odst. 3 zákona o ochraně hospodářské soutěže", None),
    ("podle § {n} odst. 1 cizineckého zákona", None), ("podle § {n} odst. 1 cizineckého zákona", "2020-01-01"), ("§ {n} zákona č. 99/1963 Sb. a § 730 téhož zákona", None), ("§ {n} až § 814 zákona č. 40/64 Sb.", None),
    ("§ {n} odst. 1 tr. ř. dále namítal porušení § 942f zákona o Policii města.", None), ("Podle pravidel o úhradě, nákladech rozhodčího řízení, jejich § {n}, se nepřiznává", None),
)
_ALIASES = [("Ústava", ["1/1993 Sb."], None), ("ZOHS", ["143/2001 Sb."], None), ("zákon o ochraně hospodářské soutěže", ["143/2001 Sb."], None), ("cizinecký zákon", ["326/1999 Sb.", "123/1992 Sb."], None), ("tr. ř.", ["141/1961 Sb."], None)]
_VERSIONS = {"326/1999 Sb.": ["2000-01-01", "2019-08-01"], "123/1992 Sb.": ["1992-03-01"]}


def _cased(spark: SparkSession, sf_dir: str, cases) -> DataFrame:
    """(o_orderkey, text, date): the order's case with its number put in."""
    case = (F.col("o_orderkey") % len(cases)).cast("int")
    texts, dates = F.array(*[F.lit(t) for t, _ in cases]), F.array(*[F.lit(d).cast("string") for _, d in cases])
    text = F.replace(F.get(texts, case), F.lit("{n}"), (F.col("o_custkey") % 300 + 1).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), F.get(dates, case).alias("date"))


@query("""
WITH c(k, number, citation_type, law_id, classification, stage) AS (VALUES (0, '{n}', 'article', '1/1993 Sb.', 'czech_resolved', 'Level 6'), (0, '390', 'article', '1/1993 Sb.', 'czech_resolved', 'Level 6'), (1, '{n}', 'section', '143/2001 Sb.', 'czech_resolved', 'Level 6'),
 (2, '{n}', 'article', NULL, 'foreign_law', 'Typed'), (3, '{n}f', 'section', '143/2001 Sb.', 'czech_resolved', 'Level 6'), (3, '620', 'section', '143/2001 Sb.', 'czech_resolved', 'Level 6'),
 (4, '{n}', 'section', NULL, 'czech_unresolved', 'Level 7'), (5, '{n}', 'section', '326/1999 Sb.', 'czech_resolved', 'Level 6A'),
 (6, '{n}', 'section', '99/1963 Sb.', 'czech_resolved', 'Level 1'), (6, '730', 'section', '99/1963 Sb.', 'czech_resolved', 'Level 2'),
 (7, '{n}', 'section', '40/1964 Sb.', 'czech_resolved', 'Level 1'), (7, '814', 'section', '40/1964 Sb.', 'czech_resolved', 'Level 1'),
 (8, '{n}', 'section', '141/1961 Sb.', 'czech_resolved', 'Level 6'), (8, '942f', 'section', NULL, 'czech_unresolved', 'Level 7'), (9, '{n}', 'section', NULL, 'non_citation', 'Filtered'))
SELECT o_orderkey, replace(number, '{n}', (o_custkey % 300 + 1)::VARCHAR) AS number, citation_type, law_id, classification, stage FROM orders JOIN c ON o_orderkey % 10 = k
""")
def law_resolver_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.law_occurrences(_cased(spark, sf_dir, _CASES), ("o_orderkey",), _ALIASES, _VERSIONS).filter("citation_type <> 'other_normative'")
    return found.select("o_orderkey", "number", "citation_type", "law_id", "classification", F.regexp_extract("stage", r"^(Level \w+|Typed|Filtered)", 1).alias("stage"))


@query("""
SELECT o_orderkey, 'zákon ' || chr(65 + (o_custkey % 26)::INT) || chr(65 + (o_orderkey % 26)::INT) AS alias, concat(o_custkey % 900 + 1, '/2001 Sb.') AS law_id FROM orders
""")
def local_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("zákon "), F.char(65 + F.col("o_custkey") % 26), F.char(65 + F.col("o_orderkey") % 26))
    text = F.concat(F.lit("podle zákona č. "), (F.col("o_custkey") % 900 + 1).cast("string"), F.lit("/2001 Sb., ve znění zákona č. 5/2002 Sb., dále jen ("), name, F.lit(")"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return C.declared_aliases(docs, ("o_orderkey",)).select("o_orderkey", "alias", "law_id")


_VOTES = "SELECT c_mktsegment || '-' || c_nationkey % 5 AS alias, c_nationkey % 2 + 1 AS n, c_custkey FROM customer"


@query(f"""
WITH v AS (SELECT alias, concat(n, '/2000 Sb.') AS law_id, count(DISTINCT c_custkey) AS votes, min(c_custkey) AS first_seen FROM ({_VOTES}) GROUP BY ALL),
r AS (SELECT *, sum(votes) OVER (PARTITION BY alias) AS total, row_number() OVER (PARTITION BY alias ORDER BY votes DESC, first_seen) AS r FROM v)
SELECT alias, law_id, votes, total::BIGINT AS total, CASE WHEN votes / total > 0.55 THEN 'global' ELSE 'conflict' END AS layer FROM r WHERE r = 1 AND total >= 2
""")
def alias_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.concat("c_mktsegment", F.lit("-"), (F.col("c_nationkey") % 5).cast("string")).alias("alias"), F.concat((F.col("c_nationkey") % 2 + 1).cast("string"), F.lit("/2000 Sb.")).alias("law_id"), F.col("c_custkey").alias("document")
    )
    return A.majority_vote(rows, share=0.55)


@query("""
WITH base AS (SELECT c_custkey AS k FROM customer), seed AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 < 2), harvest AS (SELECT p_partkey AS k FROM part), ambiguous AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 = 0), over AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 = 0)
SELECT concat('alias ', k) AS alias, CASE WHEN a.k IS NOT NULL THEN concat(k, '/5,', k, '/6') WHEN s.k IS NOT NULL THEN concat(k, '/2') WHEN b.k IS NOT NULL THEN concat(k, '/1') ELSE concat(k, '/3') END AS laws,
  CASE WHEN o.k IS NOT NULL THEN 'exact' WHEN s.k IS NOT NULL AND s.k % 3 = 1 THEN 'inflect' END AS match_mode
FROM (SELECT k FROM base UNION SELECT k FROM seed UNION SELECT k FROM harvest UNION SELECT k FROM ambiguous) x
LEFT JOIN base b USING (k) LEFT JOIN seed s USING (k) LEFT JOIN ambiguous a USING (k) LEFT JOIN over o USING (k)
""")
def alias_layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def layer(name: str, key: str, *laws: str, mode=None, keep: str = "true", whole: bool = False) -> DataFrame:
        k = F.col(key).cast("string")
        ids = F.array(*[F.concat(k, F.lit(x)) for x in laws]) if laws else F.lit(None)
        return table(spark, sf_dir, name).filter(keep).select(F.concat(F.lit("alias "), k).alias("alias"), ids.cast("array<string>").alias("law_ids"), F.lit(mode).cast("string").alias("match_mode") if not hasattr(mode, "alias") else mode.alias("match_mode"), F.lit(whole).alias("whole"))

    seeds = layer("supplier", "s_suppkey", "/2", mode=F.when(F.col("s_suppkey") % 3 == 1, "inflect"), keep="s_suppkey % 3 < 2")
    layers = [
        (layer("customer", "c_custkey", "/1", whole=True), A.OVER), (seeds, A.OVER), (layer("part", "p_partkey", "/3"), A.ABSENT),
        (layer("supplier", "s_suppkey", "/5", "/6", keep="s_suppkey % 5 = 0"), A.OVER), (layer("supplier", "s_suppkey", mode="exact", keep="s_suppkey % 7 = 0"), A.OVER),
    ]
    return A.merged(layers).select("alias", F.array_join("law_ids", ",").alias("laws"), "match_mode")


@query("""
SELECT coalesce(a.n, b.n) AS alias, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.k IS NOT DISTINCT FROM b.k THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT c_custkey AS n, c_nationkey AS k FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT s_suppkey AS n, s_nationkey AS k FROM supplier) b ON a.n = b.n
""")
def alias_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("alias"), F.col("c_nationkey").alias("law"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("alias"), F.col("s_nationkey").alias("law"))
    return A.diff(a, b, "alias", "law").select("alias", "change")


_FORMS = ("zákona o", "zákon o", "zákonem o", "zákonník o", "zákoníku o")


@query("""
SELECT c_custkey, n_name AS alias_of, c_custkey % 5 < 3 AS matches FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def inflection_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.functions import law

    pattern = F.pandas_udf(lambda names: names.map(lambda n: "(?iuU)" + law.alias_pattern(f"zákon o {n}", "inflect").pattern), "string")
    aliases = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", pattern("n_name").alias("pattern"))
    texts = F.concat(F.lit("podle "), F.get(F.array(*map(F.lit, _FORMS)), (F.col("c_custkey") % 5).cast("int")), F.lit(" "))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), texts.alias("text")).join(F.broadcast(aliases), "n_nationkey")
    return rows.select("c_custkey", F.col("n_name").alias("alias_of"), F.regexp_like(F.concat("text", F.col("n_name"), F.lit(" se")), F.col("pattern")).alias("matches"))


_TITLES = """
SELECT CASE p_partkey % 4 WHEN 0 THEN concat('Zákon o rehabilitacích ', p_partkey // 12) WHEN 1 THEN concat('Zákon, kterým se mění zákon č. ', p_partkey % 900 + 1, '/1991 Sb. (zákon o soudech ', p_partkey // 12, ')')
  WHEN 2 THEN concat('Vyhláška o ', p_name, ' ', p_partkey, ' (', p_brand, ', tarif ', p_partkey, ')') ELSE concat('Sdělení o ', p_name) END AS title, concat(p_partkey, '/2000 Sb.') AS law_id FROM part
UNION ALL SELECT CASE n_nationkey % 9 WHEN 0 THEN 'Zákoník práce' WHEN 1 THEN 'Zákon o pobytu cizinců na území ' || n_name WHEN 2 THEN 'Zákon o ochraně zemědělského půdního fondu' ELSE 'Vyhláška o posuzování pracovní schopnosti pro účely invalidity ' || n_name END, concat(n_nationkey + 1, '/1965 Sb.') FROM nation
"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    twelve = F.floor(F.col("p_partkey") / 12).cast("string")
    title = (
        F.when(k == 0, F.concat(F.lit("Zákon o rehabilitacích "), twelve)).when(k == 1, F.concat(F.lit("Zákon, kterým se mění zákon č. "), (F.col("p_partkey") % 900 + 1).cast("string"), F.lit("/1991 Sb. (zákon o soudech "), twelve, F.lit(")")))
        .when(k == 2, F.concat(F.lit("Vyhláška o "), F.col("p_name"), F.lit(" "), key, F.lit(" ("), F.col("p_brand"), F.lit(", tarif "), key, F.lit(")"))).otherwise(F.concat(F.lit("Sdělení o "), F.col("p_name")))
    )
    parts = table(spark, sf_dir, "part").select(title.alias("title"), F.concat(key, F.lit("/2000 Sb.")).alias("law_id"))
    n = F.col("n_nationkey") % 9
    known = F.when(n == 0, "Zákoník práce").when(n == 1, F.concat(F.lit("Zákon o pobytu cizinců na území "), F.col("n_name"))).when(n == 2, "Zákon o ochraně zemědělského půdního fondu").otherwise(F.concat(F.lit("Vyhláška o posuzování pracovní schopnosti pro účely invalidity "), F.col("n_name")))
    return parts.unionByName(table(spark, sf_dir, "nation").select(known.alias("title"), F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit("/1965 Sb.")).alias("law_id")))


@query(f"""
WITH t AS ({_TITLES}), x AS (
  SELECT 'zákon o rehabilitacích ' || (p_partkey // 12) AS alias, concat(p_partkey, '/2000 Sb.') AS law, NULL AS mode FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT 'zákon o soudech ' || (p_partkey // 12), concat(p_partkey % 900 + 1, '/1991 Sb.'), NULL FROM part WHERE p_partkey % 4 = 1
  UNION ALL SELECT concat('vyhláška o ', p_name, ' ', p_partkey, ' (', p_brand, ', tarif ', p_partkey, ')'), concat(p_partkey, '/2000 Sb.'), NULL FROM part WHERE p_partkey % 4 = 2
  UNION ALL SELECT concat(p_brand, ', tarif ', p_partkey), concat(p_partkey, '/2000 Sb.'), NULL FROM part WHERE p_partkey % 4 = 2
  UNION ALL SELECT lower(substr(title, 1, 1)) || substr(title, 2), law_id, NULL FROM t WHERE title LIKE 'Zákon o pobytu%' OR title LIKE 'Zákon o ochraně z%'
  UNION ALL SELECT 'zák. práce', law_id, 'inflect' FROM t WHERE title = 'Zákoník práce'
  UNION ALL SELECT unnest(['cizinecký zákon', 'cizineckého zákona']), law_id, 'inflect' FROM t WHERE title LIKE 'Zákon o pobytu%'
  UNION ALL SELECT 'zákon o ochraně ZPF', law_id, 'inflect' FROM t WHERE title LIKE 'Zákon o ochraně z%'
  UNION ALL SELECT 'vyhláška o posuzování invalidity', law_id, 'inflect' FROM t WHERE title LIKE 'Vyhláška o posuzování%')
SELECT alias, array_to_string(list_sort(list(DISTINCT law)), ',') AS laws, max(mode) AS match_mode FROM x GROUP BY alias HAVING count(DISTINCT law) <= 4
""")
def title_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.harvest_titles(_titles(spark, sf_dir)).select("alias", F.array_join("law_ids", ",").alias("laws"), "match_mode")


_HEADS = ("občanský zákon", "obchodní zákon", "trestní zákon", "správní řád", "zákon o rozhodčím řízení {n} a o výkonu", "zákon o rozhodčím řízení a o výkonu rozhodčích nálezů {n}")


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey % 6 AS k, s_suppkey::VARCHAR AS n FROM supplier),
x AS (SELECT CASE k WHEN 0 THEN 'obč. zákon ' || n WHEN 1 THEN 'obch. zákon ' || n WHEN 2 THEN 'tr. zákon ' || n WHEN 3 THEN 'spr. řád ' || n WHEN 4 THEN 'zákon o rozhodčím řízení ' || n ELSE 'zákon o rozhodčím řízení' END AS alias, s_suppkey AS k2, CASE k WHEN 5 THEN 'zákon o rozhodčím řízení a o výkonu rozhodčích nálezů ' || n ELSE '' END AS source FROM s
  UNION ALL SELECT 'RozŘ', s_suppkey, 'zákon o rozhodčím řízení a o výkonu rozhodčích nálezů ' || n FROM s WHERE k = 5)
SELECT alias, concat(max_by(k2, source), '/2001 Sb.') AS laws FROM x GROUP BY alias
""")
def derived_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey").cast("string")
    head = F.get(F.array(*map(F.lit, _HEADS)), (F.col("s_suppkey") % 6).cast("int"))
    alias = F.when(F.contains(head, F.lit("{n}")), F.replace(head, F.lit("{n}"), n)).otherwise(F.concat(head, F.lit(" "), n))
    known = table(spark, sf_dir, "supplier").select(alias.alias("alias"), F.array(F.concat(n, F.lit("/2001 Sb."))).alias("law_ids"))
    return A.derived(known).select("alias", F.array_join("law_ids", ",").alias("laws"))


#: Citations by runtime aliases by o_orderkey % 9, with dates of some.
_RUNTIME_CASES = (
    ("§ {n} odst. 1 obch. zákoníku", None), ("§ {n} odst. 1 tr. zákona", None), ("§ {n} odst. 2 RozŘ", None), ("§ {n} odst. 2 zákona o rozhodčím řízení", None), ("§ {n} občanského soudu řádu", None),
    ("§ {n} odst. 1 vyhlášky o posuzování invalidity", None), ("§ {n} odst. 1 cizineckého zákona", None), ("§ {n} odst. 1 cizineckého zákona", "2020-01-01"), ("§ {n} odst. 1 větu druhou zák. práce", "2013-01-01"),
)
_SEEDS = [("obchodní zákoník", "513/1991 Sb."), ("trestní zákon", "140/1961 Sb."), ("zákon o rozhodčím řízení a o výkonu rozhodčích nálezů", "216/1994 Sb."), ("občanský soudní řád", "99/1963 Sb.")]
_LAW_TITLES = [
    ("262/2006 Sb.", "Zákoník práce"), ("65/1965 Sb.", "Zákoník práce"), ("42/1970 Sb.", "Zákon zákoník práce"), ("326/1999 Sb.", "Zákon o pobytu cizinců na území České republiky"), ("123/1992 Sb.", "Zákon o pobytu cizinců na území ČSFR"),
    ("359/2009 Sb.", "Vyhláška, kterou se stanoví procentní míry poklesu pracovní schopnosti a upravuje posuzování pracovní schopnosti pro účely invalidity"),
]
_LAW_VERSIONS = {"42/1970 Sb.": ["1970-07-01"], "65/1965 Sb.": ["1965-09-01"], "262/2006 Sb.": ["2007-01-01"], "123/1992 Sb.": ["1992-03-20"], "326/1999 Sb.": ["2000-01-01"]}


@query("""
SELECT o_orderkey, (o_custkey % 300 + 1)::VARCHAR AS number, c.law_id FROM orders JOIN (VALUES (0, '513/1991 Sb.'), (1, '140/1961 Sb.'), (2, '216/1994 Sb.'), (3, '216/1994 Sb.'), (4, '99/1963 Sb.'), (5, '359/2009 Sb.'), (6, NULL), (7, '326/1999 Sb.'), (8, '262/2006 Sb.')) c(k, law_id) ON o_orderkey % 9 = k
""")
def runtime_alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(a, [x], None) for a, x in _SEEDS], "alias string, law_ids array<string>, match_mode string")
    aliases = A.entries(A.runtime_aliases(seeds.limit(0), seeds, spark.createDataFrame(_LAW_TITLES, "law_id string, title string")))
    docs = _cased(spark, sf_dir, _RUNTIME_CASES)
    return C.law_occurrences(docs, ("o_orderkey",), aliases, _LAW_VERSIONS, ("number", "law_id")).select("o_orderkey", "number", "law_id")


@query("""
SELECT o_orderkey, v.stage, v.confidence, v.reason FROM orders JOIN (VALUES (0, 'Level 1: Direct Match', 0.99, NULL), (1, 'Level 3B: Citation Chain Carryover', 0.72, 'weak_contextual_evidence'), (2, 'Level 4: Short Structural Reference', 0.55, 'short_structural_reference'), (3, 'Level 6A: Ambiguous Global Alias + Context (''x'')', 0.78, NULL)) v(k, stage, confidence, reason) ON o_orderkey % 4 = k
""")
def confidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.operators import quality as Q

    stages = F.array(*map(F.lit, ["Level 1: Direct Match", "Level 3B: Citation Chain Carryover", "Level 4: Short Structural Reference", "Level 6A: Ambiguous Global Alias + Context ('x')"]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(stages, (F.col("o_orderkey") % 4).cast("int")).alias("stage"), F.lit("czech_resolved").alias("classification"))
    return rows.select("o_orderkey", "stage", Q.confidence(F.col("stage")).alias("confidence"), Q.reason(F.col("classification"), F.col("stage")).alias("reason"))


@query("""
SELECT user_id, event_id, (SELECT array_to_string(list_sort(list_distinct(list(e2.event_type))), ',') FROM events e2 WHERE e2.user_id = e.user_id AND (e2.ts, e2.event_id) <= (e.ts, e.event_id)) AS seen FROM events e
""")
def running_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.array_join(F.array_sort(F.collect_set("event_type").over(so_far)), ",").alias("seen"))


@query("""
SELECT entry, event_id FROM (SELECT user_id || '::' || event_type AS entry, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1
""")
def review_queue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("entry", F.concat(F.col("user_id").cast("string"), F.lit("::"), "event_type"))
    return C.first_of_each(rows, ["entry"], ["ts", "event_id"]).select("entry", "event_id")


_WHOLE = r"""trim(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(160) || chr(13), ' ' || chr(10)), '[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), '(\pL)-[ \t]*\n\s*(\pL)', '\1\2', 'g'), '[\s\x{0B}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"""


@query(f"SELECT doc_id, sha256({_WHOLE}) AS normal_hash, length({_WHOLE}) AS n_chars FROM documents")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("normal", T.normalize(F.col("text")))
    return docs.select("doc_id", F.sha2("normal", 256).alias("normal_hash"), F.length("normal").cast("long").alias("n_chars"))
