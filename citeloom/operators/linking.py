"""Linking references to documents: identifiers, keys, the key ladder, decisions, scopes and candidates.

Everything is joins and windows on keys. A reference's keys are tried in order, all in one
equi-join with a table that has one row for each key, so a key that very many documents share
costs a reference no more than any other; the first step that names one document (or copies of
one) wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import docref
from citeloom.functions import text as T
from citeloom.operators.work import Kept, spread

#: Sources of the antitrust office, whose numbers have forms of their own, and of the constitutional court.
OFFICE, CONSTITUTIONAL = "uohs", "nalus"


@dataclass(frozen=True)
class Body:
    """A body with single spaces, and its letters upper case, folded and without spaces."""

    plain: Column
    upper: Column


def _with_body(body: Column, then: Callable[[Body], Column]) -> Column:
    """``then`` of a body's forms. They are plain expressions, of which Spark evaluates equal ones once; a lambda would leave compiled code."""
    plain = T.squeeze(body)
    return then(Body(plain, F.regexp_replace(F.translate(F.upper(T.ascii_fold(plain)), "–—_", "--/"), r"(?U)\s+", "")))


def _year4(year: Column) -> Column:
    return F.when(F.length(year) == 4, year).when(year.cast("int") <= 30, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))


def _office(b: Body) -> Column:
    return F.regexp_replace(b.upper, "^UOHS-?", "")


# --- keys of a body; null where it has no such form ---


def _compact(b: Body) -> Column:
    return T.compact_key(b.plain)


def _relaxed(b: Body) -> Column:
    """The office's number without its prefix, separators and short trailing letter groups."""
    parts = F.filter(F.split(_office(b), "[^A-Z0-9]+"), lambda p: p != "")
    return F.regexp_replace(F.regexp_replace(F.array_join(parts, "|"), r"(?:(?:^|\|)[A-Z]{1,4})+$", ""), r"\|", "")


#: Case numbers of the office, several of which may share a year ('S423,424/2014').
NUMBERS = r"\d{1,4}(?:,\d{1,4})*"
APPEAL = rf"^S({NUMBERS})-R/(\d{{4}}|\d{{2}})(?:[-/].*)?$"
PROCEEDING = rf"^([SR])({NUMBERS})/(\d{{4}}|\d{{2}})(?:/[A-Z]{{2,3}})?(?:[-/].*)?$"
ROOT_ONLY = rf"^(?:[SR]{NUMBERS}/\d{{2,4}}(?:/[A-Z0-9]{{2,4}})?|S{NUMBERS}-R/\d{{2,4}})$"


def _root(b: Body) -> Column:
    """Key of a proceeding: letter, numbers and four-digit year."""
    plain = F.regexp_replace(_office(b), "^VZ/", "")

    def numbers(group: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(group, r"(^|,)0+(?=\d)", "$1"), ",", "")

    appeal = F.concat(F.lit("S"), numbers(F.regexp_extract(plain, APPEAL, 1)), _year4(F.regexp_extract(plain, APPEAL, 2)))
    usual = F.concat(F.regexp_extract(plain, PROCEEDING, 1), numbers(F.regexp_extract(plain, PROCEEDING, 2)), _year4(F.regexp_extract(plain, PROCEEDING, 3)))
    return F.when(plain.rlike(APPEAL), appeal).when(plain.rlike(PROCEEDING), usual)


def _names_root_only(b: Body) -> Column:
    """Whether a reference names the proceeding only, not a decision in it."""
    return _office(b).rlike(ROOT_ONLY)


def _suffix(b: Body) -> Column:
    tail = F.regexp_extract(_office(b), r"(?:^|/)(?:VZ-)?(\d{1,6}/\d{2,4}/\d{1,6})$", 1)
    return F.when(F.length(tail) > 0, F.regexp_replace(tail, "/", ""))


def _short_decision(b: Body) -> Column:
    pattern = r"^VZ/S0*(\d{1,4})/\d{2,4}-(?:\d{1,6}/)?(\d{2,4})(?:/\d+)?(?:[-/].*)?$"
    number, year = (F.regexp_extract(b.upper, pattern, i) for i in (1, 2))
    return F.when(F.length(number) > 0, F.concat(F.lit("VZS"), number, F.substring(_year4(year), 3, 2)))


_COURT = r"(?iuU)^(?:[IVXLCDM]+\.\s*|Pl\.?\s*)?ÚS(?:-st\.)?\s+0*(\d+)/(\d{2,4})"
_SHORT_YEAR = r"(?iuU)^((?:(?:[IVXLCDM]+\.\s*)|Pl\.?\s*)?ÚS(?:-st\.)?)\s+0*(\d+)/(\d{4})(.*)$"
_TAIL = r"(?iuU)^(\d+\s+[A-Za-zÁ-Ž]{1,12}\s+\d+/\d{2,4}|(?:[IVXLCDM]+\.\s*|Pl\.?\s*)?ÚS(?:-st\.)?\s+\d+/\d{2,4})\s*[-–—]\s*\d+$"


def _chamberless(b: Body) -> Column:
    number, year = (F.regexp_extract(b.plain, _COURT, i) for i in (1, 2))
    return F.when(F.length(number) > 0, F.concat(F.lit("US"), number, F.substring(year, -2, 2)))


def _short_year(b: Body) -> Column:
    head, number, year, tail = (F.regexp_extract(b.plain, _SHORT_YEAR, i) for i in (1, 2, 3, 4))
    return F.when(F.length(number) > 0, T.compact_key(F.concat(head, number, F.substring(year, -2, 2), tail)))


def _tailless(b: Body) -> Column:
    base = F.regexp_extract(b.plain, _TAIL, 1)
    return F.when(F.length(base) > 0, T.compact_key(base))


def relaxed_key(body: Column) -> Column:
    return _with_body(body, _relaxed)


def root_key(body: Column) -> Column:
    return _with_body(body, _root)


def identifier_keys(identifier: Column, source: Column) -> Column:
    """All keys under which a document's own identifier is found, sorted."""
    court, office = source == CONSTITUTIONAL, source == OFFICE

    def keys(b: Body) -> Column:
        for_court = [F.when(court, k(b)) for k in (_chamberless, _short_year)]
        for_office = [F.when(office, k(b)) for k in (_relaxed, _root, _suffix, _short_decision)]
        return F.array_compact(F.array(_compact(b), _tailless(b), *for_court, *for_office))

    return F.array_sort(F.array_distinct(F.filter(_with_body(identifier, keys), lambda k: k != "")))


#: Steps of the ladder in order, with their keys; the last two name a proceeding.
LADDER: tuple[tuple[str, Callable[[Body], Column]], ...] = (
    ("body_exact", _compact),
    ("body_nalus_without_chamber", lambda b: F.when(b.plain.rlike(r"(?iuU)^ÚS\s"), _chamberless(b))),
    ("body_nalus_short_year", _short_year),
    ("body_relaxed_uohs", _relaxed),
    ("body_uohs_decision_suffix", _suffix),
    ("body_uohs_vz_short_decision", _short_decision),
    ("body_uohs_root", lambda b: F.when(_names_root_only(b), _root(b))),
    ("body_uohs_same_proceeding", lambda b: F.when(~_names_root_only(b), _root(b))),
)
STEPS = tuple(name for name, _ in LADDER)
PROCEEDING_STEP = "body_uohs_same_proceeding"
#: Steps that link to a proceeding, not to a decision.
NEAR_STEPS = (PROCEEDING_STEP, "body_uohs_vz_short_decision")


def ladder_keys(body: Column) -> Column:
    """The key of a reference for each step, "" where it has none; no keys at all for cut-off bodies."""

    def keys(b: Body) -> Column:
        made = F.array(*[F.coalesce(key(b), F.lit("")) for _, key in LADDER])
        return F.when(b.plain.rlike(r"[-–—/:]$") | (b.plain == ""), F.array().cast("array<string>")).otherwise(made)

    return _with_body(body, keys)


def ladder_steps(keys: Column) -> Column:
    """array<struct<step, method, key>> of ``ladder_keys``, each key once. ``keys`` should be a column, not an expression."""
    names = F.array(*map(F.lit, STEPS))
    rows = F.transform(keys, lambda k, i: F.struct(i.alias("step"), F.get(names, i).alias("method"), k.alias("key")))
    return F.filter(rows, lambda s: (s["key"] != "") & (F.array_position(keys, s["key"]) == s["step"] + 1))


# --- identifiers of documents ---

IDENTIFIER = "source string, document_id string, identifier string, kind string, origin string"


def _court_numbers(stem: Column) -> Column:
    """'3-84-94' -> 'III. ÚS 84/94'; plenary and opinion files have letters instead of a chamber. Null for others."""
    pattern = r"(?iU)^(\d+|Pl|St)-(\d+)-(\d{2,4})(?:_\d+)?$"
    chamber, number, year = (F.regexp_extract(stem, pattern, i) for i in (1, 2, 3))
    named = F.upper(chamber)
    head = F.when(named == "PL", "Pl. ÚS").when(named == "ST", "Pl. ÚS-st.").otherwise(F.concat(T.roman(F.when(chamber.rlike("^[0-9]+$"), chamber).otherwise("0").cast("int")), F.lit(". ÚS")))
    return F.when((F.length(number) > 0) & (chamber != "0"), F.concat(head, F.lit(" "), number, F.lit("/"), year))


def self_identifiers(docs: DataFrame) -> DataFrame:
    """(source, document_id, identifier, kind, origin) from file names: numbers with year by the conventions of each source."""
    stem = F.regexp_replace("document_id", r"\.txt$", "")
    court = F.array_compact(F.array(_court_numbers(F.regexp_replace(stem, r"^GetText\.aspx_sz_", ""))))
    supreme_stem = F.trim(F.regexp_replace(stem, "_openElement$", ""))
    supreme = F.when(supreme_stem.rlike(r"^.+\s\d+_\d{4}$"), F.array(F.regexp_replace(supreme_stem, r"_(\d{4})$", "/$1")))
    at, rest = F.regexp_extract(stem, r"^(\d{4})_([A-Za-z0-9_-]+)$", 1), F.regexp_extract(stem, r"^(\d{4})_([A-Za-z0-9_-]+)$", 2)
    parts = F.split(rest, "[-_]")
    merged = F.transform(F.filter(F.concat(F.array(F.substr(F.get(parts, F.lit(0)), F.lit(2))), F.slice(parts, F.lit(2), F.size(parts))), lambda p: p.rlike("^[0-9]+$")), lambda p: F.concat(F.substr(rest, F.lit(1), F.lit(1)), p, F.lit("/"), at))
    office = F.when(F.lower(rest).startswith("pis") | (F.length(rest) == 0), None).when(F.get(parts, F.lit(0)).rlike(r"^[A-Za-z]\d+$"), merged).otherwise(F.array(F.concat(rest, F.lit("/"), at)))
    by_source = F.when(F.col("source") == CONSTITUTIONAL, court).when(F.col("source") == OFFICE, office).when(F.col("source") == "ns", supreme)
    return docs.select("source", "document_id", F.explode(by_source).alias("identifier"), F.lit("spisova_znacka").alias("kind"), F.concat(F.lit("filename_"), F.col("source")).alias("origin"))


def header_identifiers(docs: DataFrame) -> DataFrame:
    """(source, document_id, identifier, kind, origin): numbers that stand alone on lines of a document's ``text`` at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [docref.repeated_headers(t or "") for t in batch.column("text").to_pylist()]
            at = pa.array([k for k, bodies in enumerate(found) for _ in bodies], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("source").take(at), batch.column("document_id").take(at), pa.array([b for bodies in found for b in bodies], pa.string())], names=["source", "document_id", "identifier"])

    rows = spread(docs.select("source", "document_id", "text")).mapInArrow(run, "source string, document_id string, identifier string")
    return rows.select("*", F.lit("cislo_jednaci").alias("kind"), F.lit("repeated_header_line").alias("origin"))


#: Fields of a metadata row that hold identifiers, and the origins they give; fixed values.
METADATA_FIELDS = (
    ("self_identifier_text", "external_self_identifier"),
    ("identifier_text", "external_identifier"),
    ("judicate_name", "parent_metadata_name"),
    ("name", "external_name"),
)


def metadata_identifiers(metadata: DataFrame) -> DataFrame:
    """(source, document_id, identifier, kind, origin, source_iri, decision_date_iso, judicate_name) of metadata rows, each once.

    A name of the constitutional court also gives its number in the usual form.
    """
    has = set(metadata.columns)

    def column(name: str) -> Column:
        return (F.col(name) if name in has else F.lit(None)).cast("string")

    fields = F.array(*[F.struct(column(f).alias("identifier"), F.lit(o).alias("origin")) for f, o in METADATA_FIELDS])
    own_kind = F.coalesce(F.nullif(column("identifier_kind"), F.lit("")), F.lit("unknown"))
    iri = F.coalesce(column("judicate_iri"), column("iri"))
    rows = metadata.select("source", "document_id", F.explode(fields).alias("f"), own_kind.alias("own"), iri.alias("source_iri"), column("decision_date_iso").alias("decision_date_iso"), column("judicate_name").alias("judicate_name"))
    rows = rows.withColumn("text", T.squeeze(F.col("f.identifier"))).filter("text <> '' and source <> '' and document_id <> ''")
    usual = F.when((F.col("source") == CONSTITUTIONAL) & F.col("f.origin").isin("parent_metadata_name", "external_name"), _court_numbers(F.col("text")))
    as_is = F.struct(F.col("text").alias("identifier"), F.col("own").alias("kind"), F.col("f.origin").alias("origin"))
    normal = F.when(usual.isNotNull(), F.struct(usual.alias("identifier"), F.lit("spisova_znacka").alias("kind"), F.concat(F.col("f.origin"), F.lit("_normalized_nalus")).alias("origin")))
    each = rows.select("source", "document_id", F.explode(F.array_compact(F.array(as_is, normal))).alias("v"), "source_iri", "decision_date_iso", "judicate_name").select("source", "document_id", "v.*", "source_iri", "decision_date_iso", "judicate_name")
    return each.filter(F.size(identifier_keys(F.col("identifier"), F.col("source"))) > 0).dropDuplicates(["source", "document_id", "identifier", "origin", "source_iri"])


def all_identifiers(docs: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Identifiers from file names, texts and metadata, with ``source_iri`` where metadata has one."""
    own = self_identifiers(docs)
    if "text" in docs.columns:
        own = own.unionByName(header_identifiers(docs))
    return own.unionByName(metadata_identifiers(metadata), allowMissingColumns=True) if metadata is not None else own.withColumn("source_iri", F.lit(None).cast("string"))


def canonical_name(source: Column, document_id: Column) -> Column:
    """File name without the marks of older exports, lower case and without its suffix."""
    stem = F.lower(F.regexp_replace(document_id, r"\.txt$", ""))
    return F.when(source == CONSTITUTIONAL, F.regexp_replace(F.regexp_replace(stem, r"^gettext\.aspx_sz_", ""), r"_\d+$", "")).when(source == "ns", F.trim(F.regexp_replace(stem, "_openelement$", ""))).otherwise(stem)


def lookup_key(source: Column, document_id: Column) -> Column:
    """Shared key of older and newer names; supreme court names end with their last four-digit group."""
    name = canonical_name(source, document_id)
    return F.regexp_replace(F.when((source == "ns") & name.rlike(r"\d{4}"), F.regexp_extract(name, r"^(.*\d{4})", 1)).otherwise(name), "[^a-z0-9]+", "")


def preference(source: Column, document_id: Column, iri: Column) -> Column:
    """Orders copies of a decision: with an address, newer export names, higher copy number, then by name."""
    stem = F.regexp_replace(document_id, r"\.txt$", "")
    copy = F.coalesce(F.when(source == CONSTITUTIONAL, F.try_to_number(F.regexp_extract(stem, r"_(\d+)$", 1), F.lit("999999"))).cast("int"), F.lit(0))
    return F.struct(iri.isNull().cast("int"), F.lower(stem).startswith("gettext.aspx_sz_").cast("int"), F.lower(stem).endswith("_openelement").cast("int"), -copy, canonical_name(source, document_id), document_id)


def identifier_index(identifiers: DataFrame) -> DataFrame:
    """(key, t_source, t_document_id, t_group, t_pref, t_root), one row for each key of a document."""
    s, d = F.col("source"), F.col("document_id")
    iri = F.col("source_iri") if "source_iri" in identifiers.columns else F.lit(None).cast("string")
    rows = identifiers.select(F.explode(identifier_keys(F.col("identifier"), s)).alias("key"), s.alias("t_source"), d.alias("t_document_id"), F.concat_ws("|", s, canonical_name(s, d)).alias("t_group"), preference(s, d, iri).alias("t_pref"), F.when(s == OFFICE, root_key(F.col("identifier"))).alias("t_root"))
    return rows.groupBy("key", "t_source", "t_document_id").agg(*[F.min(c).alias(c) for c in ("t_group", "t_pref", "t_root")])


# --- links ---


def laddered(refs: DataFrame) -> DataFrame:
    """References (ref_id, source, document_id, body) with one row for each step of their ladder: step, method, key."""
    keyed = spread(refs.select("ref_id", "source", "document_id", "body")).withColumn("keys", ladder_keys(F.col("body")))
    return keyed.select("ref_id", "source", "document_id", "body", F.explode(ladder_steps(F.col("keys"))).alias("s")).select("ref_id", "source", "document_id", "body", "s.*")


def _lanes(index: DataFrame) -> DataFrame:
    """Lane 0 has all documents, lane 1 those with a proceeding, among which the proceeding step looks."""
    return index.withColumn("lane", F.explode(F.when(F.col("t_root").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))


def _by_key(lanes: DataFrame) -> DataFrame:
    """(lane, key, documents, groups, roots, best, second): one row for each key, made by partial sums only."""
    at = ["lane", "key"]
    groups = lanes.groupBy(*at, "t_group").agg(F.count(F.lit(1)).alias("n")).groupBy(*at).agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("groups"))
    roots = lanes.filter("lane = 1").groupBy(*at, "t_root").agg(F.lit(1).alias("one")).groupBy(*at).agg(F.sum("one").alias("roots"))
    target = F.struct("t_pref", "t_source", "t_document_id")
    place = F.row_number().over(W.partitionBy(*at).orderBy("t_pref", "t_source", "t_document_id"))
    best = lanes.select(*at, "t_pref", "t_source", "t_document_id").withColumn("r", place).filter("r <= 2").groupBy(*at).agg(F.min(F.when(F.col("r") == 1, target)).alias("best"), F.min(F.when(F.col("r") == 2, target)).alias("second"))
    return groups.join(roots, at, "left").join(best, at)


def _own(lanes: DataFrame) -> DataFrame:
    """(lane, key, source, document_id, own_group, own_root): for each document and key, whether its group and its proceeding have no other document there."""
    group = lanes.groupBy("lane", "key", "t_group").agg(F.count(F.lit(1)).alias("g"))
    root = lanes.groupBy("lane", "key", "t_root").agg(F.count(F.lit(1)).alias("r"))
    rows = lanes.join(group, ["lane", "key", "t_group"]).join(root.filter("t_root is not null"), ["lane", "key", "t_root"], "left")
    return rows.select("lane", "key", F.col("t_source").alias("source"), F.col("t_document_id").alias("document_id"), (F.col("g") == 1).cast("int").alias("own_group"), F.coalesce((F.col("r") == 1).cast("int"), F.lit(0)).alias("own_root"), F.lit(1).alias("own"))


def link(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(ref_id, target_source, target_document_id, link_method, link_key, target_scope, group_size).

    The first step of the ladder that names one document besides the citing one, or copies of one
    document, decides; the proceeding step needs one proceeding. References of the office that
    no step links fall back to another document of their proceeding, else to the citing document.
    """
    kept = Kept(refs.sparkSession)
    lanes = kept.write(_lanes(index))  # read by several joins, so the identifiers' keys are made once
    steps = laddered(refs).withColumn("lane", F.when(F.col("method") == PROCEEDING_STEP, 1).otherwise(0))
    met = steps.join(_by_key(lanes), ["lane", "key"]).join(_own(lanes), ["lane", "key", "source", "document_id"], "left")
    own = F.coalesce("own", F.lit(0))
    left = {"documents": F.col("documents") - own, "groups": F.col("groups") - F.coalesce("own_group", F.lit(0)), "roots": F.coalesce("roots", F.lit(0)) - F.coalesce("own_root", F.lit(0))}
    citing = (F.col("best.t_source") == F.col("source")) & (F.col("best.t_document_id") == F.col("document_id"))
    seen = met.select("ref_id", "step", "method", "key", F.when(citing, F.col("second")).otherwise(F.col("best")).alias("best"), *[c.alias(n) for n, c in left.items()]).filter("documents > 0")
    works = F.when(F.col("method") == PROCEEDING_STEP, F.col("roots") == 1).otherwise((F.col("documents") == 1) | (F.col("groups") == 1))
    first = seen.filter(works).groupBy("ref_id").agg(F.min_by(F.struct("best", "method", "key", "documents"), "step").alias("x"))
    copies = (F.col("x.documents") > 1) & (F.col("x.method") != PROCEEDING_STEP)
    method = F.when(copies, F.concat("x.method", F.lit("_canonical_document"))).otherwise(F.col("x.method"))
    scope = F.when(F.col("x.method").isin(*NEAR_STEPS), "same_proceeding").otherwise("exact_decision")
    decided = first.select("ref_id", F.col("x.best.t_source").alias("target_source"), F.col("x.best.t_document_id").alias("target_document_id"), method.alias("link_method"), F.col("x.key").alias("link_key"), scope.alias("target_scope"), F.col("x.documents").alias("group_size"))
    if not refs.filter(F.col("source") == OFFICE).take(1):
        return decided
    decided = kept.write(decided)
    return decided.unionByName(same_proceeding(refs.join(decided, "ref_id", "left_anti"), lanes))


def same_proceeding(refs: DataFrame, lanes: DataFrame) -> DataFrame:
    """Links of the office's references that have a proceeding: to the preferred other document of it, else to the citing one."""
    at = ["lane", "key"]
    asked = refs.filter(F.col("source") == OFFICE).select("ref_id", "source", "document_id", root_key(F.col("body")).alias("key"), F.lit(1).alias("lane")).filter("key is not null")
    rooted = lanes.filter("lane = 1 and t_root = key")
    met = asked.join(_by_key(rooted), at).join(_own(rooted), [*at, "source", "document_id"], "left")
    citing = (F.col("best.t_source") == F.col("source")) & (F.col("best.t_document_id") == F.col("document_id"))
    others = F.col("documents") - F.coalesce("own", F.lit(0))
    target = F.when((others > 0) & citing, F.col("second")).otherwise(F.col("best"))
    method = F.when(others > 0, "body_uohs_same_proceeding_fallback").otherwise("body_uohs_same_proceeding_self_anchor")
    rows = met.select("ref_id", target.alias("t"), method.alias("link_method"), F.col("key").alias("link_key"), F.lit("same_proceeding").alias("target_scope"), F.when(others > 0, others).otherwise(F.col("documents")).alias("group_size"))
    return rows.select("ref_id", F.col("t.t_source").alias("target_source"), F.col("t.t_document_id").alias("target_document_id"), "link_method", "link_key", "target_scope", "group_size")


def unlinked(refs: DataFrame, links: DataFrame) -> DataFrame:
    return refs.join(links, "ref_id", "left_anti")


# --- scopes ---

#: Out-of-scope shapes in the order they are tried, fixed values: reason, form it is tried on, pattern.
OUT_OF_SCOPE = (
    ("reporter_citation", "plain", r"^\d{4}\s+a\s+\d+/\d{4}$"),
    ("foreign_case_out_of_scope", "folded", r"^(?:C|T|F)-\d+/\d{2,4}$"),
    ("uohs_reporter_citation", "plain", r"^R\s*\d+/\d{2,4}$"),
    ("administrative_internal_identifier", "folded", r"\b(?:UMCP|MHMP|MZE|KSBR|LPTP|PRP|FJ|NK)\b|046100|RF-"),
    ("administrative_internal_identifier", "plain", r"^\d{3,6}/\d{2}$"),
    ("administrative_internal_identifier", "plain", r"^\d{1,6}/\d{1,6}/\d{2,4}$"),
    ("administrative_internal_identifier", "plain", r"^\d{1,6}/\d{4}/[A-Z]{2,5}$"),
    ("administrative_internal_identifier", "plain", r"^\d+\s+EX\s+\d+/\d{2}-\d+$"),
    ("administrative_internal_identifier", "plain", r"^\d+RP\d+/\d{4}-\d+$"),
    ("administrative_internal_identifier", "plain", r"^[A-Z]-[A-Z]+\d+/\d{4}/[A-Z]{2,5}$"),
    ("administrative_internal_identifier", "plain", r"^[A-Z]{2,}\d+/\d{2,4}(?:/[A-Z0-9-]+)+$"),
)


def scope_reason(body: Column) -> Column:
    """Why a reference's shape makes it no candidate for linking, or null."""
    plain = T.squeeze(body)
    forms = {"plain": plain, "folded": F.translate(F.upper(T.ascii_fold(plain)), "–—", "--")}
    out = F.lit(None).cast("string")
    for reason, form, pattern in reversed(OUT_OF_SCOPE):
        out = F.when(forms[form].rlike(f"(?i){pattern}"), reason).otherwise(out)
    return out


def scoped(refs: DataFrame, identifiers: DataFrame) -> DataFrame:
    """References with ``scope_reason``: a shape out of scope, or 'uohs_self_reference' where one of the office's documents names its own proceeding."""
    own = identifiers.filter(F.col("source") == OFFICE).select(F.col("source").alias("__s"), F.col("document_id").alias("__d"), root_key(F.col("identifier")).alias("__k")).filter("__k is not null").distinct()
    key = F.when(F.col("source") == OFFICE, root_key(F.col("body")))
    rows = spread(refs).withColumn("__root", key).withColumn("scope_reason", scope_reason(F.col("body")))
    joined = rows.join(own, (F.col("source") == F.col("__s")) & (F.col("document_id") == F.col("__d")) & (F.col("__root") == F.col("__k")), "left")
    return joined.withColumn("scope_reason", F.coalesce("scope_reason", F.when(F.col("__k").isNotNull(), "uohs_self_reference"))).select(*refs.columns, "scope_reason")


# --- candidates ---

#: Candidates listed for a reference; the list is the feature.
LISTED = 12


def candidate_targets(refs: DataFrame, index: DataFrame, most: int = LISTED, identifiers: DataFrame | None = None, fuzzy: bool = False) -> DataFrame:
    """(ref_id, rank, target, step, score): the best document of each group of copies, over all steps, the first ``most``.

    With ``fuzzy`` and the identifiers, references without any get similar identifiers of their
    preferred source, with step -1 and a score. A key gives ``most`` groups and one more, as the citing document's
    own may fall away, so a key of very many documents costs a reference no more than that.
    """
    index = Kept(refs.sparkSession).write(index)
    group = index.groupBy("key", "t_group").agg(F.min(F.struct("t_pref", "t_source", "t_document_id")).alias("t"), F.min_by(F.struct("t_source", "t_document_id"), "t_pref").alias("best"))
    second = index.join(group.select("key", "t_group", F.col("best").alias("__b")), ["key", "t_group"]).filter(F.struct("t_source", "t_document_id") != F.col("__b")).groupBy("key", "t_group").agg(F.min(F.struct("t_pref", "t_source", "t_document_id")).alias("t2"))
    listed = group.join(second, ["key", "t_group"], "left").withColumn("__r", F.row_number().over(W.partitionBy("key").orderBy("t"))).filter(F.col("__r") <= most + 1)
    met = laddered(refs).join(listed, "key")
    citing = (F.col("t.t_source") == F.col("source")) & (F.col("t.t_document_id") == F.col("document_id"))
    met = met.withColumn("t", F.when(citing, F.col("t2")).otherwise(F.col("t"))).filter("t is not null")
    best = met.groupBy("ref_id", "t_group").agg(F.min(F.struct("step", "t")).alias("m"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("ref_id").orderBy("m", "t_group"))).filter(F.col("rank") <= most)
    found = ranked.select("ref_id", "rank", F.col("m.t.t_document_id").alias("target"), F.col("m.step").alias("step"), F.lit(None).cast("double").alias("score"))
    if not fuzzy or identifiers is None:
        return found
    rest = refs.join(found.select("ref_id").distinct(), "ref_id", "left_anti")
    return found.unionByName(fuzzy_candidates(rest, identifiers, most).withColumn("step", F.lit(-1)))


def duplicate_hints(docs: DataFrame, keys: list[str], id_col: str, order: Column) -> DataFrame:
    """Groups of more than one document with equal keys: size, ids and the preferred id on every member."""
    groups = docs.groupBy(*keys).agg(F.count_distinct(id_col).alias("group_size"), F.min_by(id_col, order).alias("canonical_id")).filter("group_size > 1")
    return docs.join(groups, keys).select(id_col, "group_size", "canonical_id")


# --- similar identifiers ---

#: Agenda codes of the two supreme courts, and shapes of the office's and the constitutional court's numbers.
NSS_AGENDAS = "A AD ADS AFS ANS AO AOS APS ARS AS AZS KOMP KSE KSS NAO NAD NTS PO PST VOL".split()
NS_AGENDAS = "CDO CO CMO CPO CPJ ICDO ND NTD TCU TDO TO ZP".split()
OFFICE_SHAPE = r"\b(?:UOHS|VZ/S|[SR]\s*\d{1,4}(?:[A-Z])?(?:,\d{1,4})*/\d{2,4})"
COURT_SHAPE = r"\b(?:PL\.?\s*US(?:-ST\.)?|[IVXLCDM]+\.\s*US|US)\b"
AGENDA = r"\b\d+\s+([A-Z]{1,8})\s+\d+/\d{2,4}\b"


def preferred_sources(body: Column, court: Column) -> Column:
    """Sources to look in, by the court hint, then the agenda code, then the shape; none for lower courts and where nothing tells."""
    plain, hint = T.fuzzy_text(body), F.lower(F.coalesce(court, F.lit("")))
    agenda, office = F.regexp_extract(plain, AGENDA, 1), plain.rlike(OFFICE_SHAPE)

    def sources(*names: str) -> Column:
        return F.array(*map(F.lit, names)).cast("array<string>")

    told = hint.contains("úřadu") | plain.contains("UOHS") | plain.rlike("^(?:VZ/S|S|R)")
    return (
        F.when(hint.rlike("vrchní|krajsk|městsk|mestsk|okresn"), sources()).when(hint.contains("ústav") | plain.rlike(COURT_SHAPE), sources(CONSTITUTIONAL))
        .when(hint.contains("správní"), sources("nss")).when(hint.contains("nejvyššího soudu"), sources("ns")).when(told & office, sources(OFFICE))
        .when(agenda.isin(*NSS_AGENDAS), sources("nss")).when(agenda.isin(*NS_AGENDAS), sources("ns")).when(office, sources(OFFICE))
        .when(F.length(agenda) > 0, sources("nss", "ns")).otherwise(sources())
    )


#: Shortest body that is compared, what shared digit groups, a shared year and an equal kind add, and the scores that
#: bodies of up to so many characters need (of the ratio alone for the shortest ones).
SHORTEST, PER_GROUP, GROUPS_AT_MOST, SAME_YEAR, SAME_KIND = 8, 0.04, 0.12, 0.05, 0.03
LEAST_RATIO, LEAST_SHORT, LEAST = (12, 0.92), (18, 0.83), 0.74


def digit_groups(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d{1,6}"), F.lit(0)))


def similarity(a: str, b: str, shared: int, same_year: bool, same_kind: bool) -> float | None:
    """Score of two bodies of which both have digit groups in common, or None below the limits."""
    from difflib import SequenceMatcher

    bonus = min(GROUPS_AT_MOST, PER_GROUP * shared) + SAME_YEAR * same_year + SAME_KIND * same_kind
    need = max(LEAST - bonus, LEAST_SHORT[1] - bonus if len(a) <= LEAST_SHORT[0] else 0.0, LEAST_RATIO[1] if len(a) <= LEAST_RATIO[0] else 0.0)
    match = SequenceMatcher(None, a, b)
    if match.real_quick_ratio() < need or match.quick_ratio() < need:  # upper bounds of the ratio
        return None
    ratio = match.ratio()
    return ratio + bonus if ratio >= need else None


def fuzzy_candidates(refs: DataFrame, identifiers: DataFrame, most: int = LISTED) -> DataFrame:
    """(ref_id, rank, target, score): similar identifiers in the preferred sources of references (ref_id, source, document_id, body, kind, court).

    A candidate shares half of a reference's digit groups at least (one where it has one or two),
    and a year where both have years; years are groups of two or four digits. So it shares one
    of the reference's rarest groups, as many as half of them leave over and one: those are joined on, not
    the years that most identifiers have. Scores are made in Arrow batches and only for pairs that pass.
    """
    refs_ = refs.select(*[F.col(c) if c in refs.columns else F.lit(None).cast("string").alias(c) for c in ("ref_id", "source", "document_id", "body", "kind", "court")])
    asked = spread(refs_).withColumn("a", T.fuzzy_text(F.col("body"))).filter(F.length("a") >= SHORTEST)
    asked = asked.withColumn("groups", digit_groups(F.col("a"))).filter(F.size("groups") > 0).withColumn("among", F.explode(preferred_sources(F.col("body"), F.col("court"))))
    s, d = F.col("source"), F.col("document_id")
    iri = F.col("source_iri") if "source_iri" in identifiers.columns else F.lit(None).cast("string")
    kind = F.col("kind") if "kind" in identifiers.columns else F.lit(None).cast("string")
    named = identifiers.select(s.alias("among"), d.alias("target"), kind.alias("t_kind"), T.fuzzy_text(F.col("identifier")).alias("b"), F.concat_ws("|", s, canonical_name(s, d)).alias("t_group"), preference(s, d, iri).alias("t_pref"))
    named = named.withColumn("t_groups", digit_groups(F.col("b"))).filter(F.size("t_groups") > 0)
    posted = named.withColumn("g", F.explode("t_groups"))
    common = posted.groupBy("among", "g").agg(F.count(F.lit(1)).alias("n"))
    each = asked.withColumn("g", F.explode("groups")).join(common, ["among", "g"], "left")
    n = F.size("groups")
    rare = W.partitionBy("ref_id", "among").orderBy(F.coalesce("n", F.lit(0)), F.length("g").desc(), "g")
    probes = each.withColumn("__r", F.row_number().over(rare)).filter((F.col("__r") <= n - F.ceil(n / 2) + 1) & F.col("n").isNotNull())

    def years(groups: Column) -> Column:
        return F.filter(groups, lambda g: F.length(g).isin(2, 4))

    pairs = probes.join(posted, ["among", "g"]).filter((F.col("among") != F.col("source")) | (F.col("target") != F.col("document_id")))
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("groups", "t_groups"))).filter((n < 2) | (F.col("shared") * 2 >= n))
    mine, theirs = years(F.col("groups")), years(F.col("t_groups"))
    pairs = pairs.withColumn("same_year", F.size(F.array_intersect(mine, theirs)) > 0).filter(F.col("same_year") | (F.size(mine) == 0) | (F.size(theirs) == 0))
    pairs = pairs.select("ref_id", "target", "t_group", "t_pref", "a", "b", "shared", "same_year", F.coalesce(F.col("kind") == F.col("t_kind"), F.lit(False)).alias("same_kind")).distinct()

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, shared: pd.Series, same_year: pd.Series, same_kind: pd.Series) -> pd.Series:
        return pd.Series([similarity(*x) for x in zip(a, b, shared, same_year, same_kind, strict=True)], dtype="float64")

    scored = pairs.withColumn("score", score("a", "b", "shared", "same_year", "same_kind")).filter("score is not null and not isnan(score)")
    best = scored.groupBy("ref_id", "t_group").agg(F.max("score").alias("score"), F.min_by(F.struct("t_pref", "target"), F.struct(-F.col("score"), F.col("t_pref"))).alias("m"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("score"), "m"))).filter(F.col("rank") <= most)
    return ranked.select("ref_id", "rank", F.col("m.target").alias("target"), F.round(F.least(F.col("score"), F.lit(1.0)), 4).alias("score"))
