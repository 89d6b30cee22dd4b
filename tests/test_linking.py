"""Keys, identifiers, links, scopes and similar identifiers on small cases; review tasks of uploads."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeloom import ship
from citeloom.operators import linking as L
from citeloom.operators import review as R

REF = "ref_id int, source string, document_id string, body string"


def links(spark, files, refs, metadata=None):
    names = L.self_identifiers(spark.createDataFrame(files, "source string, document_id string"))
    if metadata is not None:
        names = names.unionByName(L.metadata_identifiers(metadata), allowMissingColumns=True)
    rows = L.link(spark.createDataFrame(refs, REF), L.identifier_index(names)).collect()
    return {r["ref_id"]: (r["target_document_id"], r["link_method"], r["target_scope"], r["group_size"]) for r in rows}


def test_several_case_numbers_share_a_year(spark):
    bodies = ["S423,424/2014", "S0423,0424/2014/VZ", "S1,2-R/98", "UOHS-R5/31", "VZ/S7/2014", "S5/2014-12/2014/510", "21 Cdo 5/2010"]
    got = spark.createDataFrame([(b,) for b in bodies], "body string").select("body", L.root_key(F.col("body")).alias("k"))
    assert {r["body"]: r["k"] for r in got.collect()} == dict(zip(bodies, ["S4234242014", "S4234242014", "S121998", "R51931", "S72014", "S52014", None]))


def test_proceedings_fall_back(spark):
    ship(spark)
    files = [("uohs", "2014_S5.txt"), ("uohs", "2014_S9.txt"), ("ns", "x.txt")]
    twin = spark.createDataFrame([("uohs", "pis5.txt", "VZ/S5/14")], "source string, document_id string, name string")
    refs = [(1, "uohs", "2014_S9.txt", "S5/2014"), (2, "ns", "x.txt", "S5/2014"), (3, "uohs", "2014_S9.txt", "S9/2014"), (4, "uohs", "2014_S9.txt", "S8/2014"), (5, "uohs", "2014_S5.txt", "S5/2014")]
    assert links(spark, files, refs, twin) == {
        1: ("2014_S5.txt", "body_uohs_same_proceeding_fallback", "same_proceeding", 2),
        3: ("2014_S9.txt", "body_uohs_same_proceeding_self_anchor", "same_proceeding", 1),
        5: ("pis5.txt", "body_exact", "exact_decision", 1),
    }


def test_merged_case_and_copies(spark):
    files = [("uohs", "2014_S423_424.txt"), ("nalus", "Pl-20-15_1.txt"), ("nalus", "Pl-20-15_2.txt")]
    refs = [(1, "ns", "x.txt", "S424/2014/VZ"), (2, "nalus", "Pl-20-15_2.txt", "Pl. ÚS 20/15"), (3, "ns", "x.txt", "Pl. ÚS 20/15")]
    got = links(spark, files, refs)
    assert got[1][:2] == ("2014_S423_424.txt", "body_relaxed_uohs")
    assert got[2] == ("Pl-20-15_1.txt", "body_exact", "exact_decision", 1) and got[3] == ("Pl-20-15_2.txt", "body_exact_canonical_document", "exact_decision", 2)


def test_links_equal_a_plain_loop(spark):
    """The key table gives what counting the documents under each key gives, with the citing document left out."""
    rng = random.Random(3)
    files = [("uohs", f"{rng.choice([2013, 2014])}_S{rng.randrange(1, 9)}{rng.choice(['', '_3', '-4'])}.txt") for _ in range(12)] + [("nalus", f"Pl-{rng.randrange(1, 4)}-15_{rng.randrange(1, 3)}.txt") for _ in range(4)]
    files = sorted(set(files))
    bodies = ["S3/2013", "S3/2014/VZ", "S4/2014/VZ-11/2014/5", "Pl. ÚS 1/15", "Pl. ÚS 2/2015", "ÚS 3/15", "S1/2013", "S5/2014"]
    refs = [(i, *rng.choice([*files, ("ns", "x.txt")]), rng.choice(bodies)) for i in range(120)]
    index = [tuple(r) for r in L.identifier_index(L.self_identifiers(spark.createDataFrame(files, "source string, document_id string"))).select("key", "t_source", "t_document_id", "t_group", "t_pref", "t_root").collect()]
    steps = {}
    for r in L.laddered(spark.createDataFrame(refs, REF)).collect():
        steps.setdefault(r["ref_id"], []).append((r["step"], r["method"], r["key"]))
    expected = {}
    for ref, source, document, _ in refs:
        for _, method, key in sorted(steps.get(ref, ())):
            met = [x for x in index if x[0] == key and (x[1], x[2]) != (source, document)]
            if method == L.PROCEEDING_STEP:
                met = [x for x in met if x[5]]
                works = len({x[5] for x in met}) == 1
            else:
                works = len(met) == 1 or len({x[3] for x in met}) == 1
            if works:
                suffix = "_canonical_document" if len(met) > 1 and method != L.PROCEEDING_STEP else ""
                expected[ref] = (min(met, key=lambda x: (x[4], x[1], x[2]))[2], method + suffix, "same_proceeding" if method in L.NEAR_STEPS else "exact_decision", len(met))
                break
    got = {k: v for k, v in links(spark, files, refs).items() if "fallback" not in v[1] and "anchor" not in v[1]}
    assert got == expected and len(expected) > 30


def test_self_references_of_the_office(spark):
    names = L.self_identifiers(spark.createDataFrame([("uohs", "2018_S0181.txt")], "source string, document_id string"))
    letters = L.metadata_identifiers(spark.createDataFrame([("uohs", "pis32510.txt", "VZ/S250/06")], "source string, document_id string, name string"))
    refs = spark.createDataFrame([(1, "uohs", "2018_S0181.txt", "ÚOHS-S0181/2018/VS"), (2, "uohs", "pis32510.txt", "S250/2006/SZ-15118/2006/520-KV"), (3, "ns", "2018_S0181.txt", "S0181/2018"), (4, "uohs", "other.txt", "R 53/2002"), (5, "uohs", "other.txt", "S0181/2018"), (6, "ns", "x", None)], REF)
    got = {r["ref_id"]: r["scope_reason"] for r in L.scoped(refs, names.unionByName(letters, allowMissingColumns=True)).collect()}
    assert got == {1: "uohs_self_reference", 2: "uohs_self_reference", 3: None, 4: "uohs_reporter_citation", 5: None, 6: None}


def test_identifiers_of_texts_and_metadata(spark):
    ship(spark)
    docs = spark.createDataFrame([("ns", "a.txt", "21 Cdo 5/2010\nx\n 21 Cdo 5/2010 \n6 As 1/2001"), ("ns", "b.txt", None)], "source string, document_id string, text string")
    assert [tuple(r) for r in L.header_identifiers(docs).select("document_id", "identifier").collect()] == [("a.txt", "21 Cdo 5/2010")]
    meta = spark.createDataFrame([("nalus", "n.txt", "Pl-20-15_1", "iri"), ("nalus", "n.txt", "Pl-20-15_1", "iri"), ("nss", "s.txt", " ", None), ("nss", None, "x 1", None)], "source string, document_id string, judicate_name string, judicate_iri string")
    assert {(r["identifier"], r["origin"], r["source_iri"]) for r in L.metadata_identifiers(meta).collect()} == {("Pl-20-15_1", "parent_metadata_name", "iri"), ("Pl. ÚS 20/15", "parent_metadata_name_normalized_nalus", "iri")}
    assert L.all_identifiers(docs, meta).count() == 3 and L.all_identifiers(docs).count() == 1


def _plain_score(a, b, same_kind):
    import re

    x, y = set(re.findall(r"\d{1,6}", a)), set(re.findall(r"\d{1,6}", b))
    years = [{g for g in s if len(g) in (2, 4)} for s in (x, y)]
    if not x & y or all(years) and not years[0] & years[1] or len(x) >= 2 and len(x & y) / len(x) < 0.5:
        return None
    ratio = SequenceMatcher(None, a, b).ratio()
    score = ratio + min(0.12, 0.04 * len(x & y)) + (0.05 if years[0] & years[1] else 0) + (0.03 if same_kind else 0)
    if len(a) <= 12 and ratio < 0.92 or len(a) <= 18 and score < 0.83 or score < 0.74:
        return None
    return round(min(score, 1.0), 4)


def test_similar_identifiers_equal_all_pairs(spark):
    ship(spark)
    rng = random.Random(5)
    number = lambda: f"{rng.randrange(1, 40)} {rng.choice(['Cdo', 'Cdoo', 'Tdo', 'Odo'])} {rng.randrange(1, 60)}/{rng.choice([2007, 2008, 99])}"
    named = [("ns", f"{i}.txt", number(), "spisova_znacka") for i in range(60)]
    asked = [(i, "nss", "x.txt", number(), rng.choice(["spisova_znacka", "cislo_jednaci"]), "Nejvyššího soudu") for i in range(60)]
    ids = spark.createDataFrame(named, "source string, document_id string, identifier string, kind string")
    refs = spark.createDataFrame(asked, "ref_id int, source string, document_id string, body string, kind string, court string")
    got = {(r["ref_id"], r["target"]): r["score"] for r in L.fuzzy_candidates(refs, ids, most=100).collect()}
    expected = {(r[0], n[1]): s for r in asked for n in named if len(r[3]) >= 8 and (s := _plain_score(r[3].upper(), n[2].upper(), r[4] == n[3])) is not None}
    assert got.keys() == expected.keys() and len(expected) > 10
    assert all(got[k] == pytest.approx(expected[k], abs=1e-4) for k in expected)


def test_lower_courts_have_no_similar_documents(spark):
    ship(spark)
    ids = spark.createDataFrame([("ns", "25 Cdo 407_2012.txt", "25 Cdo 407/2012", "spisova_znacka")], "source string, document_id string, identifier string, kind string")
    refs = spark.createDataFrame([(1, "uploaded", "x", "5 Cmo 407/2012-191", "cislo_jednaci", "Vrchního soudu")], REF + ", kind string, court string")
    assert L.candidate_targets(refs, L.identifier_index(ids), identifiers=ids, fuzzy=True).count() == 0


def test_upload_tasks_skip_known_strangers(spark):
    rows = [(1, "12 T 79/2002", "sp. zn. 12 T 79/2002", "Městského soudu"), (2, "ÚOHS-15369/2024/852", "č. j. ÚOHS-15369/2024/852", None), (3, "5 As 1/2008", "x", "předsedy Úřadu"), (4, "5 As 1/2008", "x", None)]
    refs = spark.createDataFrame(rows, "ref_id int, body string, text string, court string")
    none = spark.createDataFrame([], "ref_id int, rank int, target string")
    assert [(r["ref_id"], r["route"]) for r in R.upload_tasks(refs, none.select("ref_id"), none).collect()] == [(4, R.PRESENCE)]


def test_prompts_tell_what_counts(spark):
    queue = spark.createDataFrame([("e", R.DISAMBIGUATION, "č. j. 62 Af 57/2011-96", "rozsudku ze dne 1. 11. 2012", ["555342.txt"])], "entry_id string, route string, target_reference string, context_block string, candidate_targets array<string>")
    prompt = R.prompts(queue).first()["prompt"]
    assert all(x in prompt for x in ("target_decision_date_iso", "target_duplicate_canonical_document_id", "date agreement", "555342.txt"))
    assert "policy" not in R.prompts(queue, "v1").first()["prompt"]
