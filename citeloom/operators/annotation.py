"""Annotation sets and baselines: gold anchors, tasks, finalizing, offset repair, page footers, selection, simple miners."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import docref, law
from citeloom.functions import text as T
from citeloom.operators.work import per_document, spread

#: Characters between footnotes of one page, and from the last one to its end; fixed value.
FOOTER_GAP = 600
NOTE = re.compile(r"^\s*(\d+)(?!\.)\s+.*$", re.M)


# --- gold ---


def anchor_start(start: Column, surface: Column, kind: Column, number: Column, law_id: Column) -> Column:
    """Where the anchor itself begins inside a longer gold span; the span's start where it is not found."""

    def place(pattern: Column) -> Column:
        whole = F.concat(F.lit("(?iuU)"), pattern)
        return F.when(F.regexp_like(surface, whole), F.length(F.get(F.split(surface, whole, 2), F.lit(0))))

    quoted = F.concat(F.lit(r"\Q"), F.coalesce(number, F.lit("")), F.lit(r"\E\b"))
    own = F.when((kind == "section") & (F.length(number) > 0), F.coalesce(place(F.concat(F.lit(r"§{1,2}\s*"), quoted)), F.lit(0)))
    own = own.when((kind == "article") & (F.length(number) > 0), F.coalesce(place(F.concat(F.lit(r"(?:čl\.|článek)\s*"), quoted)), F.lit(0)))
    own = own.when((kind == "other_normative") & (F.length(law_id) > 0), place(F.concat(F.lit(r"\Q"), law_id, F.lit(r"\E"))))
    return start + F.coalesce(own, place(F.lit(r"§{1,2}|čl\.|článek|\d{1,4}/(?:\d{4}|\d{2})\s*Sb\.")), F.lit(0))


def distinct_gold(gold: DataFrame, order: list[str]) -> DataFrame:
    """Gold citations without repetitions: one row per anchor, type, class, law and details."""
    keyed = gold.withColumn("anchor", anchor_start(F.col("start_char"), F.col("citation_text"), F.col("citation_type"), F.col("detail_number"), F.col("law_id")))
    keys = ["document_id", "anchor", "citation_type", "classification", "law_id", "detail_number", "detail_odst", "detail_pism"]
    return keyed.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def tasks(docs: DataFrame, keys: tuple[str, ...], radius: int = 200) -> DataFrame:
    """(keys, seq, target, snippet_start, snippet, occurrence): one annotation task for each anchor, with the count of its text in the snippet up to it."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                for seq, m in enumerate(law.ANCHOR.finditer(text)):
                    low = max(0, m.start() - radius)
                    snippet = text[low : m.end() + radius]
                    count = sum(1 for x in re.finditer(f"(?={re.escape(m[0])})", snippet) if x.start() <= m.start() - low)
                    at.append(k)
                    out.append((seq, m[0], low, snippet, count))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32())))], names=[*keys, "seq", "target", "snippet_start", "snippet", "occurrence"])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "seq int, target string, snippet_start int, snippet string, occurrence int"]))


def prefilled(tasks_: DataFrame, occurrences: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Tasks (key, start, target, law_id, classification) with the labels of the miner's occurrences (key, start, citation_text, law_id, classification) at the same place with the same text.

    Labels that are there stay, but with ``force``. ``filled`` says where a label came from the miner.
    """
    mined = occurrences.select(key, "start", F.col("citation_text").alias("target"), F.col("law_id").alias("__law"), F.col("classification").alias("__class")).dropDuplicates([key, "start", "target"])
    rows = tasks_.join(mined, [key, "start", "target"], "left")
    fill = F.col("__class").isNotNull() & (F.lit(force) | F.col("classification").isNull())
    labels = {"law_id": F.when(fill, F.col("__law")).otherwise(F.col("law_id")), "classification": F.when(fill, F.col("__class")).otherwise(F.col("classification"))}
    return rows.select(*[labels.get(c, F.col(c)).alias(c) for c in tasks_.columns], fill.alias("filled"))


def nth_place(text: Column, needle: Column, nth: Column) -> Column:
    """Start of the n-th occurrence (from 1) of a needle that does not overlap itself, or null."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), -1)
    before = F.aggregate(F.slice(pieces, F.lit(1), nth), F.lit(0), lambda a, x: a + F.length(x))
    return F.when((nth >= 1) & (nth < F.size(pieces)) & (F.length(needle) > 0), before + (nth - 1) * F.length(needle))


def finalized(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, errors) of rows (snippet, snippet_start, finding_text, occurrence, classification): findings get document offsets."""
    known = F.col("classification").isin("czech_resolved", "czech_unresolved", "foreign_law", "non_citation")
    at = nth_place(F.col("snippet"), F.col("finding_text"), F.col("occurrence"))
    error = F.when(F.coalesce(F.length("finding_text"), F.lit(0)) == 0, "missing_text").when(~F.coalesce(known, F.lit(False)), "bad_classification").when(at.isNull(), "text_not_in_snippet")
    rows = annotations.withColumn("error", error).withColumn("start_char", F.col("snippet_start") + at).withColumn("end_char", F.col("start_char") + F.length("finding_text"))
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").drop("start_char", "end_char")


def repaired_offsets(predictions: DataFrame) -> DataFrame:
    """Adds (start_char, status) to rows (passage, passage_start, exact_text, start_offset): as given, unique in the passage, nearest, or not found."""

    @F.pandas_udf("start int, status string")
    def repair(passage: pd.Series, base: pd.Series, exact: pd.Series, offset: pd.Series) -> pd.DataFrame:
        out = []
        for text, low, needle, start in zip(passage, base, exact, offset, strict=True):
            if text[start : start + len(needle)] == needle:
                out.append((low + start, "exact"))
                continue
            places = [m.start() for m in re.finditer(f"(?={re.escape(needle)})", text)] if needle else []
            best = min(places, key=lambda p: abs(p - start), default=None)
            out.append((None, "not_found") if best is None else (low + best, "unique" if len(places) == 1 else "nearest"))
        return pd.DataFrame(out, columns=["start", "status"])

    fixed = predictions.withColumn("__f", repair("passage", "passage_start", "exact_text", "start_offset"))
    return fixed.withColumn("start_char", F.col("__f.start")).withColumn("status", F.col("__f.status")).drop("__f")


def fallback_reason(rows: DataFrame) -> DataFrame:
    """Adds ``reason`` to gold and predictions joined outer (g_* and p_* columns): the first thing that is wrong, or null."""
    reason = (
        F.when(F.col("p_id").isNull(), "missing_prediction").when(F.col("g_id").isNull(), "spurious_prediction").when(~F.col("g_class").eqNullSafe(F.col("p_class")), "wrong_classification")
        .when(~F.col("g_law").eqNullSafe(F.col("p_law")), "wrong_law").when(~F.col("g_detail").eqNullSafe(F.col("p_detail")), "wrong_detail").when(F.col("p_confidence") < law.LOW_CONFIDENCE, "low_confidence")
    )
    return rows.withColumn("reason", reason)


# --- pages ---


def cropped_footers(pages: DataFrame, document: str) -> DataFrame:
    """(document, page, text) of page texts without their footnotes, whose numbers go on from page to page.

    A chain of footnotes starts with the number after the last one seen, has small gaps and ends
    near the end of the page. A document's pages are one group, in order.
    """

    def crop(pages_: Iterator[tuple]) -> Iterator[tuple]:
        last = 0
        for page, text in pages_:
            notes = [(m.start(), m.end(), int(m[1])) for m in NOTE.finditer(text)]
            for i, note in enumerate(notes):
                if note[2] != last + 1:
                    continue
                chain = [note]
                for other in notes[i + 1 :]:
                    if other[2] == chain[-1][2] + 1:
                        if other[0] - chain[-1][1] >= FOOTER_GAP:
                            break
                        chain.append(other)
                if len(text) - chain[-1][1] < FOOTER_GAP:
                    text, last = text[: note[0]].rstrip(), chain[-1][2]
                    break
            yield page, text

    rows = pages.select(document, F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return per_document(rows, document, ["page", "text"], [("page", "int"), ("text", "string")], crop)


# --- selection ---


def greedy_coverage(docs: DataFrame, group: str, k: int) -> DataFrame:
    """(group, position, document_id): per group the ``k`` documents that add most features not yet covered, then score (the count is the feature).

    Rows: group, document_id, score, features (array of names). Only the best rows of each
    feature set can be chosen, so the group is cut to them before it goes to one task.
    """
    same = W.partitionBy(group, F.array_sort("features")).orderBy(F.desc("score"), "document_id")
    best = docs.withColumn("__r", F.row_number().over(same)).filter(F.col("__r") <= k).drop("__r")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = sorted(pdf.itertuples(index=False), key=lambda r: (-r.score, r.document_id))
        covered, out = set(), []
        while left and len(out) < k:
            pick = max(range(len(left)), key=lambda i: (len(set(left[i].features) - covered), left[i].score, -i))
            r = left.pop(pick)
            covered |= set(r.features)
            out.append((getattr(r, group), len(out) + 1, r.document_id))
        return pd.DataFrame(out, columns=[group, "position", "document_id"])

    kinds = dict(docs.dtypes)
    return best.select(group, "document_id", "score", "features").groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, position int, document_id {kinds['document_id']}")


# --- baselines and review queues ---


def simple_laws(docs: DataFrame, keys: tuple[str, ...], aliases: dict[str, str]) -> DataFrame:
    """(keys, start, citation_text, law_id): each anchor with the nearest law number around it, else the longest alias that is there."""
    kinds, names = dict(docs.dtypes), sorted(aliases, key=lambda a: (-len(a), a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                for m in law.ANCHOR.finditer(text):
                    low = max(0, m.start() - 80)
                    window = text[low : m.end() + 260]
                    near = min(law.LAW.finditer(window), key=lambda x: (abs(x.start() + low - m.start()), x.start()), default=None)
                    named = next((a for a in names if re.search(rf"(?<!\w){re.escape(a)}(?!\w)", window)), None)
                    at.append(k)
                    out.append((m.start(), m[0], law.law_id(near[1]) if near else aliases.get(named)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string())))], names=[*keys, "start", "citation_text", "law_id"])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "start int, citation_text string, law_id string"]))


def strict_links(refs: DataFrame, names: DataFrame) -> DataFrame:
    """(ref_id, document_id): references whose compact body is the compact name of exactly one other document."""
    a = refs.select("ref_id", F.col("document_id").alias("own"), T.compact_key(F.col("body")).alias("key")).filter("key <> ''")
    b = names.select("document_id", T.compact_key(F.col("name")).alias("key"))
    met = a.join(b, "key").filter(F.col("document_id") != F.col("own"))
    return met.groupBy("ref_id").agg(F.min("document_id").alias("document_id"), F.max("document_id").alias("__m")).filter(F.col("document_id") == F.col("__m")).drop("__m")


def hard_case_route(body: Column, chamberless: Column, short_year: Column) -> Column:
    """Route of an unresolved reference: counts of documents under its chamberless and short-year keys, then two shapes."""
    recovery = "link_normalization_or_target_recovery"
    return F.when(chamberless > 1, "link_disambiguation").when(short_year >= 1, recovery).when(F.upper(body).rlike(r"(?U)\b29\s+(?:NSČR|ICDO)\b"), recovery).when(body.rlike(r"(?U)\b[IVXLCDM]+\.\s*ÚS\s+\d+/\d{4}\b"), recovery)


#: Categories of loose candidates that a review looks at.
BARE_CATEGORIES = ("ustavni_soud", "bare_court_case")


def gap_candidates(docs: DataFrame, covered: DataFrame, key: str, most: int, categories: tuple[str, ...] = BARE_CATEGORIES) -> DataFrame:
    """(key, start, end, text, category): loose reference shapes of a document that no known span (key, start, end) and no earlier one overlaps, the first ``most`` of each document.

    A document's known spans go with its text, as they are bounded by its length.
    """
    held = covered.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("known"))
    fields = (("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("category", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, (text, known) in enumerate(zip(batch.column("text").to_pylist(), batch.column("known").to_pylist(), strict=True)):
                found = docref.gaps(text or "", [(s["start"], s["end"]) for s in known or ()], categories)[:most]
                at += [k] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(fields))], names=[key, *(n for n, _ in fields)])

    return spread(docs.select(key, "text").join(held, key, "left")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, start int, end int, text string, category string")


def not_in_corpus_audit(refs: DataFrame, links: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """(ref_id, suspicion): references said to be absent, by whether an exact or a similar document exists after all, most suspicious first."""
    best = fuzzy.groupBy("ref_id").agg(F.max("score").alias("score"))
    rows = refs.select("ref_id").join(links.select("ref_id", F.lit(1).alias("__l")), "ref_id", "left").join(best, "ref_id", "left")
    label = F.when(F.col("__l").isNotNull(), "exact_match_exists").when(F.col("score") >= 0.92, "very_similar").when(F.col("score") >= 0.83, "similar").otherwise("absent")
    return rows.select("ref_id", label.alias("suspicion"), F.when(F.col("__l").isNotNull(), 0).otherwise(1).alias("order"), F.coalesce("score", F.lit(0.0)).alias("score"))


def ablations(run, layers: dict[str, list]) -> dict[str, DataFrame]:
    """Results of ``run(aliases)`` with all layers and without each one."""
    every = [a for entries in layers.values() for a in entries]
    return {"full": run(every)} | {f"without_{name}": run([a for other, entries in layers.items() if other != name for a in entries]) for name in layers}
