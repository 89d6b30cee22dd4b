"""Mining and resolving on small Czech strings: input and expected output pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citeloom import ship
from citeloom.functions import docref, law
from citeloom.functions import text as T
from citeloom.operators import aliases as A
from citeloom.operators import citations as C
from citeloom.operators import linking as L


def mined(text, general=(), local=(), date=None, versions=None):
    entries = lambda x: [(a, [v] if isinstance(v, str) else v, None) for a, v in x]
    rows = law.occurrences(text, law.Dictionary(entries(local)), law.Dictionary(entries(general)), date, versions)
    return [(r["number"], r["law_id"], r["classification"], r["stage"].split(":")[0]) for r in rows if r["citation_type"] != "other_normative"]


CASES = [
    ("čl. 81 a 90 Ústavy", [("Ústava", "1/1993 Sb.")], [("81", "1/1993 Sb.", "czech_resolved", "Level 6"), ("90", "1/1993 Sb.", "czech_resolved", "Level 6")]),
    ("Podle § 3 ZOHS", [("ZOHS", "143/2001 Sb.")], [("3", "143/2001 Sb.", "czech_resolved", "Level 6")]),
    ("čl. 101 Smlouvy o fungování Evropské unie", [], [("101", None, "foreign_law", "Typed")]),
    ("§ 5 vyhlášky č. 40/64 Sb.", [], [("5", "40/1964 Sb.", "czech_resolved", "Level 1")]),
    ("§ 7 bez dalšího", [], [("7", None, "czech_unresolved", "Level 7")]),
    ("§ 24 zákona č. 99/1963 Sb. a § 30 téhož zákona", [], [("24", "99/1963 Sb.", "czech_resolved", "Level 1"), ("30", "99/1963 Sb.", "czech_resolved", "Level 2")]),
    ("§ 2 pravidel o nákladech rozhodčího řízení", [], [("2", None, "non_citation", "Filtered")]),
]


@pytest.mark.parametrize("text,general,expected", CASES)
def test_waterfall(text, general, expected):
    assert mined(text, general) == expected


def test_local_alias_beats_general():
    assert mined("§ 1 tr. z.", [("tr. z.", "140/1961 Sb.")], [("tr. z.", "40/2009 Sb.")])[0][1:] == ("40/2009 Sb.", "czech_resolved", "Level 5")


def test_ambiguous_alias_needs_a_date():
    alias, versions = [("cizinecký zákon", ["326/1999 Sb.", "123/1992 Sb."])], {"326/1999 Sb.": ["2000-01-01"], "123/1992 Sb.": ["1992-03-01"]}
    assert mined("§ 42 cizineckého zákona", alias)[0][1] is None
    assert mined("§ 42 cizineckého zákona", alias, date="2020-01-01", versions=versions)[0][1] == "326/1999 Sb."
    assert mined("§ 42 cizineckého zákona", alias, date="1995-01-01", versions=versions)[0][1] == "123/1992 Sb."


def test_details_and_ranges():
    assert law.detail("§ 20", " odst. 1 až 3 písm. a) až c) a odst. l zákona") == {"number": "20", "odst": ["1", "2", "3", "1"], "pism": ["a", "b", "c"], "body": []}
    assert law.detail("§ 20", " zákona, v němž se uvádí odst. 1") == {"number": "20", "odst": [], "pism": [], "body": []}
    assert [r[0] for r in mined("§ 1 až § 14 zákona č. 1/2000 Sb.")] == ["1", "14"]


def test_declared_aliases():
    text = "zákona č. 99/1963 Sb., ve znění zákona č. 286/2021 Sb., dále jen „o.s.ř.“, a zákona č. 40/2009 Sb. dále jen (zákon, TZ)"
    assert law.declared_aliases(text) == {"o. s. ř.": "99/1963 Sb.", "TZ": "40/2009 Sb."}


def test_references():
    assert [r["body"] for r in docref.references("nález sp. zn. I. ÚS 2959/20 a usnesení sp. zn. T 162/2019, ze dne")] == ["I. ÚS 2959/20", "T 162/2019"]
    assert docref.references("sp. zn. nic") == [] and docref.references("") == []
    assert docref.repeated_headers("21 Cdo 5/2010\ntext\n21 Cdo 5/2010\n") == ["21 Cdo 5/2010"]


def test_tables_of_occurrences(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "§ 3 ZOHS a 1/2000 Sb. NSS", None), (2, None, None), (3, "", None), (4, "§ 9 ZZZ", {"ZZZ": "5/2005 Sb."})], "id int, text string, declared map<string,string>")
    rows = C.law_occurrences(docs, ("id",), [("ZOHS", ["143/2001 Sb."], None)])
    good, review = C.resolved_and_review(rows)
    assert {(r["id"], r["law_id"]) for r in good.collect()} == {(1, "143/2001 Sb."), (4, "5/2005 Sb.")}
    assert review.count() == 0 and rows.filter("classification = 'non_citation'").count() == 1


def test_text_functions(spark):
    row = spark.createDataFrame([("Příliš žlu-\nťoučký kůň – č. 5_a", "3 /2000")], "t string, u string").select(
        T.compact_key(F.col("t")).alias("key"), T.normalize(F.col("t")).alias("normal"), T.roman(F.lit(1994)).alias("roman"), T.law_id(F.lit("1/30 Sb.")).alias("new"), T.law_id(F.lit("1/31  Sb.")).alias("old"),
        T.reasoning_part(F.lit("x Odůvodnění: proto Poučení: y")).alias("part"), T.drop_page_lines(F.lit("a\n- 3 -\npokračování 5 A\nb")).alias("lines"), T.repair_cp1250(F.lit("ìøíèø")).alias("fixed"),
    ).first()
    assert row["key"] == "PRILISZLUTOUCKYKUNC5A" and row["normal"] == "Příliš žluťoučký kůň – č. 5_a" and row["roman"] == "MCMXCIV"
    assert (row["new"], row["old"], row["part"], row["lines"]) == ("1/2030 Sb.", "1/1931 Sb.", ": proto ", "a\nb") and row["fixed"] == "ěříčř"


def test_alias_json_shapes(spark):
    raw = spark.createDataFrame([("a", '"1/2000 Sb."'), ("b", '{"law_id": "2/2000 Sb.", "match_mode": "exact"}'), ("c", '{"law_ids": ["3/2000 Sb.", "4/2000 Sb."]}'), ("d", '["5/2000 Sb."]')], "alias string, payload string")
    got = {r["alias"]: (r["law_ids"], r["match_mode"]) for r in A.from_json(raw, "seed").collect()}
    assert got == {"a": (["1/2000 Sb."], None), "b": (["2/2000 Sb."], "exact"), "c": (["3/2000 Sb.", "4/2000 Sb."], None), "d": (["5/2000 Sb."], None)}


def test_links_need_one_document(spark):
    files = spark.createDataFrame([("ns", "21 Cdo 5_2010.txt"), ("ns", "22 Cdo 5_2010.txt"), ("nss", "x.txt")], "source string, document_id string")
    index = L.identifier_index(L.self_identifiers(files).withColumn("source_iri", F.lit(None).cast("string")))
    refs = spark.createDataFrame([(1, "nss", "x.txt", "21 Cdo 5/2010"), (2, "ns", "21 Cdo 5_2010.txt", "21 Cdo 5/2010"), (3, "nss", "x.txt", "21 Cdo 5/"), (4, "nss", "x.txt", "")], "ref_id int, source string, document_id string, body string")
    assert [(r["ref_id"], r["target_document_id"]) for r in L.link(refs, index).collect()] == [(1, "21 Cdo 5_2010.txt")]
