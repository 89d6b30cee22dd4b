"""Queries of the reference, key and linking operators: references rendered from ``orders``, documents named by ``supplier``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.catalog import query, table
from citeloom.operators import citations as C
from citeloom.operators import linking as L


@query("""
SELECT o_orderkey, concat(o_custkey % 40 + 1, ' Cdo ', o_orderkey % 5000 + 1, '/', year(o_orderdate)) AS body, 'spisova_znacka' AS kind, 'rozsudek' AS decision_kind FROM orders
""")
def docref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat((F.col("o_custkey") % 40 + 1).cast("string"), F.lit(" Cdo "), (F.col("o_orderkey") % 5000 + 1).cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Srov. rozsudek sp. zn. "), body, F.lit(", ze dne 1. ledna 2012.")).alias("text"))
    return C.document_references(docs, ("o_orderkey",)).select("o_orderkey", "body", "kind", "decision_kind")


@query("""
SELECT o_orderkey, unnest([concat('21 Cdo ', o_custkey + 1, '/2010'), concat('22 Cdo ', o_custkey + 2, '/2011')]) AS body FROM orders
""")
def docref_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("usnesení sp. zn. 21 Cdo "), (F.col("o_custkey") + 1).cast("string"), F.lit("/2010 a 22 Cdo "), (F.col("o_custkey") + 2).cast("string"), F.lit("/2011, která jsou dostupná"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return C.document_references(docs, ("o_orderkey",)).select("o_orderkey", "body")


#: Texts by o_orderkey % 7 with {n} for a number; '~' stands for text that comes before.
_CITING = (
    "rozsudek sp. zn. 69Co {n}/2010 Krajského soudu v Brně", "nález sp. zn. I. ÚS {n}/20 a usnesení Okresního soudu sp. zn. T {n}/2019, ze dne", "~ podle rozsudku Nejvyššího soudu 21 Cdo {n}/2005 uvádí",
    "Nejvyšší správní soud č. j. 5 As {n}/2008 a č. j. 6 As {n}/2009 dovodil", "rozhodnutí předsedy Úřadu č. j. ÚOHS-R{n}/2010, ze dne", "usnesení rozšířeného senátu č. j. 7 As {n}/2008. Dále", "~ viz 29 NSČR {n}/2010 a dále",
)
_FILLER = "Text bez odkazu. "


def _order_case(cases: tuple[str, ...], n=None):
    """The case of an order with its number put in."""
    number = F.col("o_custkey") % 900 + 1 if n is None else n
    return F.replace(F.get(F.array(*map(F.lit, cases)), (F.col("o_orderkey") % len(cases)).cast("int")), F.lit("{n}"), number.cast("string"))


@query("""
WITH c(k, body, decision_kind, court) AS (VALUES (0, '69Co {n}/2010', 'rozsudek', NULL), (1, 'I. ÚS {n}/20', 'nález', NULL), (1, 'T {n}/2019', 'usnesení', 'Okresního soudu'), (2, '21 Cdo {n}/2005', 'rozsudek', 'Nejvyššího soudu'),
 (3, '5 As {n}/2008', NULL, 'Nejvyššího správního soudu'), (3, '6 As {n}/2009', NULL, 'Nejvyššího správního soudu'), (4, 'ÚOHS-R{n}/2010', 'rozhodnutí', 'předsedy Úřadu'), (5, '7 As {n}/2008', 'usnesení', 'rozšířeného senátu'), (6, '29 NSČR {n}/2010', NULL, 'Nejvyššího soudu'))
SELECT o_orderkey, replace(body, '{n}', (o_custkey % 900 + 1)::VARCHAR) AS body, decision_kind, court FROM orders JOIN c ON o_orderkey % 7 = k
""")
def docref_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(_order_case(_CITING), F.lit("~"), F.repeat(F.lit(_FILLER), 90))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return C.document_references(docs, ("o_orderkey",)).select("o_orderkey", "body", "decision_kind", "court")


#: Bare numbers that are no references, by o_orderkey % 4: in the head of a decision, behind a digit, repeated on lines of their own, and without any hint or cue.
_NO_CITING = ("USNESENÍ\n29 Cdo {n}/2010\nsoud rozhodl", "rozsudek Nejvyššího soudu 5\n29 Cdo {n}/2010", "29 Cdo {n}/2010\nrozsudek Nejvyššího soudu\n29 Cdo {n}/2010\nkonec", "~ věc 29 Cdo {n}/2010 skončila")


@query("SELECT o_orderkey, 0 AS found FROM orders")
def docref_bare_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.replace(_order_case(_NO_CITING), F.lit("~"), F.repeat(F.lit(_FILLER), 90)).alias("text"))
    found = C.document_references(docs, ("o_orderkey",)).groupBy("o_orderkey").agg(F.count(F.lit(1)).cast("int").alias("found"))
    return docs.select("o_orderkey").join(found, "o_orderkey", "left").na.fill(0)


@query("""
SELECT s_suppkey, array_to_string(list_sort(list_distinct(k)), ',') AS keys FROM (
  SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN [concat('IIIUS', s_suppkey, '1999'), concat('US', s_suppkey, '99'), concat('IIIUS', s_suppkey, '99')]
    WHEN 1 THEN [concat('S', n, '2014VZ'), concat('S', n, '2014'), concat('S', s_suppkey, '2014')]
    WHEN 2 THEN [concat('25CDO', s_suppkey, '200712'), concat('25CDO', s_suppkey, '2007')] ELSE [concat('S12', n, '2014'), concat('S12', s_suppkey, '2014')] END AS k FROM (SELECT s_suppkey, CASE WHEN s_suppkey < 1000 THEN lpad(s_suppkey::VARCHAR, 4, '0') ELSE s_suppkey::VARCHAR END AS n FROM supplier))
""")
def selfid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    padded = F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)
    text = F.when(k == 0, F.concat(F.lit("III. ÚS "), n, F.lit("/1999"))).when(k == 1, F.concat(F.lit("S"), padded, F.lit("/2014/VZ"))).when(k == 2, F.concat(F.lit("25 Cdo "), n, F.lit("/2007 - 12"))).otherwise(F.concat(F.lit("S12,"), padded, F.lit("/2014")))
    source = F.when(k == 0, "nalus").when(k == 2, "ns").otherwise("uohs")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(L.identifier_keys(text, source), ",").alias("keys"))


#: File names by s_suppkey % 8: source and name.
_FILES = (
    ("ns", "21 Cdo {n}_2010.txt"), ("nalus", "3-{n}-94.txt"), ("nalus", "GetText.aspx_sz_1-{n}-97_2.txt"), ("nalus", "Pl-{n}-15.txt"), ("nalus", "St-{n}-09.txt"), ("uohs", "2014_S{n}_9{n}.txt"), ("uohs", "2021_S0{n}.txt"), ("uohs", "2021_pis{n}.txt"),
)


@query("""
WITH c(k, source, document_id, identifier) AS (VALUES (0, 'ns', '21 Cdo {n}_2010.txt', '21 Cdo {n}/2010'), (1, 'nalus', '3-{n}-94.txt', 'III. ÚS {n}/94'), (2, 'nalus', 'GetText.aspx_sz_1-{n}-97_2.txt', 'I. ÚS {n}/97'), (3, 'nalus', 'Pl-{n}-15.txt', 'Pl. ÚS {n}/15'),
 (4, 'nalus', 'St-{n}-09.txt', 'Pl. ÚS-st. {n}/09'), (5, 'uohs', '2014_S{n}_9{n}.txt', 'S{n}/2014'), (5, 'uohs', '2014_S{n}_9{n}.txt', 'S9{n}/2014'), (6, 'uohs', '2021_S0{n}.txt', 'S0{n}/2021'))
SELECT source, replace(document_id, '{n}', s_suppkey::VARCHAR) AS document_id, replace(identifier, '{n}', s_suppkey::VARCHAR) AS identifier FROM supplier JOIN c ON s_suppkey % 8 = k
""")
def self_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("s_suppkey") % 8).cast("int")
    name = F.replace(F.get(F.array(*[F.lit(f) for _, f in _FILES]), k), F.lit("{n}"), F.col("s_suppkey").cast("string"))
    files = table(spark, sf_dir, "supplier").select(F.get(F.array(*[F.lit(x) for x, _ in _FILES]), k).alias("source"), name.alias("document_id"))
    return L.self_identifiers(files).select("source", "document_id", "identifier")


@query("""
SELECT o_orderkey::VARCHAR AS document_id, concat('21 Cdo ', o_custkey % 900 + 1, '/2010') AS identifier FROM orders WHERE o_orderkey % 2 = 0
""")
def header_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("21 Cdo "), (F.col("o_custkey") % 900 + 1).cast("string"), F.lit("/2010"))
    text = F.concat(line, F.lit("\nprvní strana\n"), F.when(F.col("o_orderkey") % 2 == 0, line).otherwise(""), F.lit("\ndruhá strana"))
    docs = table(spark, sf_dir, "orders").select(F.lit("ns").alias("source"), F.col("o_orderkey").cast("string").alias("document_id"), text.alias("text"))
    return L.header_identifiers(docs).select("document_id", "identifier")


@query("""
WITH c(k, identifier, kind, origin) AS (VALUES (0, '3-{n}-94_1', 'unknown', 'parent_metadata_name'), (0, 'III. ÚS {n}/94', 'spisova_znacka', 'parent_metadata_name_normalized_nalus'), (1, '21 Cdo {n}/2010', 'unknown', 'parent_metadata_name'), (1, '21 Cdo {n}/2010', 'unknown', 'external_name'), (2, '5 As {n}/2011', 'cislo_jednaci', 'external_identifier'))
SELECT concat(c_custkey, '.txt') AS document_id, replace(identifier, '{n}', c_custkey::VARCHAR) AS identifier, kind, origin FROM customer JOIN c ON c_custkey % 3 = k
""")
def metadata_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    named = F.when(k == 0, F.concat(F.lit("3-"), n, F.lit("-94_1"))).when(k == 1, F.concat(F.lit("21  Cdo "), n, F.lit("/2010")))
    rows = table(spark, sf_dir, "customer").select(
        F.when(k == 0, "nalus").when(k == 1, "ns").otherwise("nss").alias("source"), F.concat(n, F.lit(".txt")).alias("document_id"), named.alias("judicate_name"), F.when(k == 1, named).alias("name"),
        F.when(k == 2, F.concat(F.lit("5 As "), n, F.lit("/2011"))).alias("identifier_text"), F.when(k == 2, "cislo_jednaci").alias("identifier_kind"), F.lit(None).cast("string").alias("iri"),
    )
    return L.metadata_identifiers(rows).select("document_id", "identifier", "kind", "origin")


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References of orders to documents of suppliers, one document a supplier; every tenth reference names none."""
    n = F.col("s_suppkey")
    docs = table(spark, sf_dir, "supplier").select(F.lit("ns").alias("source"), F.concat(F.lit("25 Cdo "), n.cast("string"), F.lit("_2007.txt")).alias("document_id"))
    identifiers = L.self_identifiers(docs)
    body = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("99 Tdo "), F.col("o_orderkey").cast("string"), F.lit("/1990"))).otherwise(F.concat(F.lit("25  Cdo "), (F.col("o_custkey") % 120).cast("string"), F.lit("/2007")))
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), F.lit("nss").alias("source"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("document_id"), body.alias("body"))
    return refs, L.identifier_index(identifiers)


@query("""
SELECT o_orderkey AS ref_id, concat('25 Cdo ', s_suppkey, '_2007.txt') AS target_document_id, 'body_exact' AS link_method, 'exact_decision' AS target_scope, 1 AS group_size
FROM orders JOIN supplier ON o_custkey % 120 = s_suppkey WHERE o_orderkey % 10 > 0
""")
def link_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = _linked(spark, sf_dir)
    return L.link(refs, index).select("ref_id", "target_document_id", "link_method", "target_scope", "group_size")


@query("""
SELECT o_orderkey AS ref_id FROM orders WHERE o_orderkey % 10 = 0 OR o_custkey % 120 NOT IN (SELECT s_suppkey FROM supplier)
""")
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = _linked(spark, sf_dir)
    return L.unlinked(refs, L.link(refs, index)).select("ref_id")


#: References to the documents of a supplier: its case, the citing document and the body.
_SPECIAL = (
    (1, "ns", "x.txt", "Pl. ÚS {m}/15"), (2, "ns", "x.txt", "ÚOHS-S{num}/{year}/VZ"), (3, "ns", "x.txt", "ÚOHS-S{num}/{year}/VZ-1234/{year}/511"), (4, "ns", "x.txt", "III. ÚS {m}/1994"), (5, "ns", "x.txt", "9 As 1/2020"),
    (6, "uohs", "x.txt", "S{num}/{year}"), (7, "uohs", "{year}_S{num}.txt", "S{num}/{year}"), (8, "ns", "x.txt", "VZ/S{num}/{yy}-153/{yy}"),
)


@query("""
WITH s AS (SELECT s_suppkey AS n, 1000000 + s_suppkey AS m, s_suppkey % 5000 + 1 AS num, 1990 + s_suppkey // 5000 AS year, s_suppkey % 2 = 0 AS twin FROM supplier),
f AS (SELECT *, concat(year, '_S', num, '.txt') AS file, concat('pis', n, '.txt') AS letter FROM s)
SELECT n * 10 + 1 AS ref_id, concat('Pl-', m, '-15_2.txt') AS target_document_id, 'body_exact_canonical_document' AS link_method, 'exact_decision' AS target_scope, 2 AS group_size FROM f
UNION ALL SELECT n * 10 + 2, file, 'body_relaxed_uohs', 'exact_decision', 1 FROM f WHERE NOT twin
UNION ALL SELECT n * 10 + 3, file, 'body_uohs_same_proceeding', 'same_proceeding', 1 + twin::INT FROM f
UNION ALL SELECT n * 10 + 4, concat('3-', m, '-94.txt'), 'body_nalus_short_year', 'exact_decision', 1 FROM f
UNION ALL SELECT n * 10 + 6, file, CASE WHEN twin THEN 'body_uohs_same_proceeding_fallback' ELSE 'body_exact' END, CASE WHEN twin THEN 'same_proceeding' ELSE 'exact_decision' END, 1 + twin::INT FROM f
UNION ALL SELECT n * 10 + 7, CASE WHEN twin THEN letter ELSE file END, CASE WHEN twin THEN 'body_exact' ELSE 'body_uohs_same_proceeding_self_anchor' END, CASE WHEN twin THEN 'exact_decision' ELSE 'same_proceeding' END, 1 FROM f
UNION ALL SELECT n * 10 + 8, CASE WHEN twin THEN letter ELSE file END, CASE WHEN twin THEN 'body_uohs_vz_short_decision' ELSE 'body_uohs_same_proceeding' END, 'same_proceeding', 1 FROM f
""")
def link_special_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    values = {"m": n + 1_000_000, "num": n % 5000 + 1, "year": F.floor(n / 5000) + 1990}
    values["yy"] = F.substring(values["year"].cast("string"), 3, 2)

    def filled(template):
        out = template
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
        return out

    suppliers = table(spark, sf_dir, "supplier")
    files = F.array(*[F.struct(F.lit(x).alias("source"), filled(F.lit(f)).alias("document_id")) for x, f in (("nalus", "Pl-{m}-15_1.txt"), ("nalus", "Pl-{m}-15_2.txt"), ("uohs", "{year}_S{num}.txt"), ("nalus", "3-{m}-94.txt"))])
    letters = suppliers.filter(n % 2 == 0).select(F.lit("uohs").alias("source"), F.concat(F.lit("pis"), n.cast("string"), F.lit(".txt")).alias("document_id"), filled(F.lit("VZ/S{num}/{yy}")).alias("name"))
    names = L.self_identifiers(suppliers.select(F.explode(files).alias("f")).select("f.*")).unionByName(L.metadata_identifiers(letters), allowMissingColumns=True)
    cases = F.explode(F.array(*[F.struct((n * 10 + k).alias("ref_id"), F.lit(x).alias("source"), filled(F.lit(d)).alias("document_id"), filled(F.lit(b)).alias("body")) for k, x, d, b in _SPECIAL]))
    refs = suppliers.select(cases.alias("r")).select("r.*")
    return L.link(refs, L.identifier_index(names)).select("ref_id", "target_document_id", "link_method", "target_scope", "group_size")


#: Bodies by o_orderkey % 9; the last two name the proceeding of a document of the office, from itself and from another one.
_SCOPES = ("1989 a {n}/1989", "C-{n}/96", "R {n}/2002", "Fj {n}/2017/KSBR", "UMCP14/14/{n}/OV/BARK", "{n}/97", "21 Cdo {n}/2010", "ÚOHS-S0{n}/2018/VS", "ÚOHS-S0{n}/2018/VS")


@query("""
SELECT o_orderkey, r.reason FROM orders JOIN (VALUES (0, 'reporter_citation'), (1, 'foreign_case_out_of_scope'), (2, 'uohs_reporter_citation'), (3, 'administrative_internal_identifier'), (4, 'administrative_internal_identifier'), (5, 'administrative_internal_identifier'), (6, NULL), (7, 'uohs_self_reference'), (8, NULL)) r(k, reason) ON o_orderkey % 9 = k
""")
def link_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("o_custkey") % 900 + 100, F.col("o_orderkey") % 9
    document = F.when(k == 7, F.concat(F.lit("2018_S0"), n.cast("string"), F.lit(".txt"))).otherwise("other.txt")
    refs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k >= 7, "uohs").otherwise("ns").alias("source"), document.alias("document_id"), _order_case(_SCOPES, n).alias("body"))
    identifiers = L.self_identifiers(refs.select("source", "document_id").distinct())
    return L.scoped(refs, identifiers).select("o_orderkey", F.col("scope_reason").alias("reason"))


@query("""
SELECT o_orderkey AS ref_id, 1 AS rank, concat('25 Cdo ', s_suppkey, '_2007.txt') AS target FROM orders JOIN supplier ON o_custkey % 120 = s_suppkey WHERE o_orderkey % 10 > 0
""")
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = _linked(spark, sf_dir)
    return L.candidate_targets(refs, index).select("ref_id", "rank", "target")


@query("""
SELECT doc_id, c AS group_size, m AS canonical_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text), lang) AS c, min(doc_id) OVER (PARTITION BY sha256(text), lang) AS m FROM documents) WHERE c > 1
""")
def duplicate_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    return L.duplicate_hints(docs, ["key", "lang"], "doc_id", F.col("doc_id"))


@query("""
SELECT s_suppkey AS ref_id, concat(200000 + s_suppkey, '.txt') AS target FROM supplier WHERE s_suppkey % 4 < 2
""")
def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # by s_suppkey % 4: misspelt agendas, another year, a lower court
    s, k = F.col("s_suppkey"), F.col("s_suppkey") % 4
    a, b, year = (s + 100_000).cast("string"), (s + 200_000).cast("string"), s % 60 + 1960
    docs = table(spark, sf_dir, "supplier")
    ids = docs.select(F.lit("ns").alias("source"), F.concat(b, F.lit(".txt")).alias("document_id"), F.concat(a, F.lit(" Cdo "), b, F.lit("/"), year.cast("string")).alias("identifier"), F.lit("spisova_znacka").alias("kind"))
    body = F.concat(a, F.when(k == 1, " Cod ").otherwise(" Cdoo "), b, F.lit("/"), F.when(k == 2, year + 1).otherwise(year).cast("string"))
    court = F.when(k == 3, "Vrchního soudu").otherwise("Nejvyššího soudu")
    refs = docs.select(s.alias("ref_id"), F.lit("nss").alias("source"), F.lit("x.txt").alias("document_id"), body.alias("body"), F.lit("spisova_znacka").alias("kind"), court.alias("court"))
    found = L.candidate_targets(refs, L.identifier_index(ids), identifiers=ids, fuzzy=True)
    return found.filter("rank = 1 and step = -1").select("ref_id", "target")


#: Bodies and court hints by o_orderkey % 9.
_ASKED = (("5 As {n}/2008", None), ("21 Cdo {n}/2010", None), ("I. ÚS {n}/20", "Ústavního soudu"), ("ÚOHS-S{n}/2014", None), ("5 Cmo {n}/2012", "Vrchního soudu"), ("5 Xyz {n}/2012", None), ("{n}", None), ("7 Xyz {n}/2012", "Nejvyššího správního soudu"), ("R{n}/2014", "předsedy Úřadu"))


@query("""
SELECT o_orderkey, s.sources FROM orders JOIN (VALUES (0, 'nss'), (1, 'ns'), (2, 'nalus'), (3, 'uohs'), (4, ''), (5, 'nss,ns'), (6, ''), (7, 'nss'), (8, 'uohs')) s(k, sources) ON o_orderkey % 9 = k
""")
def source_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.get(F.array(*[F.lit(h).cast("string") for _, h in _ASKED]), (F.col("o_orderkey") % 9).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _order_case(tuple(b for b, _ in _ASKED)).alias("body"), hint.alias("court"))
    return rows.select("o_orderkey", F.array_join(L.preferred_sources(F.col("body"), F.col("court")), ",").alias("sources"))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'linked' ELSE 'unresolved' END AS status, CASE WHEN o_custkey % 2 = 1 THEN o_totalprice END AS original FROM orders
""")
def exact_only_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 2 == 0, "exact_decision").otherwise("same_proceeding").alias("scope"))
    exact = links.filter("scope = 'exact_decision'").select("o_orderkey", F.lit("linked").alias("status"))
    rest = links.filter("scope <> 'exact_decision'").select("o_orderkey", F.lit("unresolved").alias("status"), F.struct("o_totalprice", "scope").alias("link"))
    return exact.unionByName(rest, allowMissingColumns=True).select("o_orderkey", "status", F.col("link.o_totalprice").alias("original"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(concat('21cdo', c_custkey, '2007')) ELSE lower(concat('384', c_custkey)) END AS key FROM customer
""")
def document_lookup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("string")
    even = F.col("c_custkey") % 2 == 0
    name = F.when(even, F.concat(F.lit("21 Cdo "), n, F.lit("_2007_openElement.txt"))).otherwise(F.concat(F.lit("GetText.aspx_sz_3-84-"), n, F.lit("_2.txt")))
    return table(spark, sf_dir, "customer").select("c_custkey", L.lookup_key(F.when(even, "ns").otherwise("nalus"), name).alias("key"))
