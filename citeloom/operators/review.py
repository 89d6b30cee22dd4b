"""Review queues: routes, prompts, an injected reviewer, and what its answers may change."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Routes of references to a reviewer, and that of those which need none; fixed values.
DISAMBIGUATION, RECOVERY, PRESENCE, FILTERED = "link_disambiguation", "link_normalization_or_target_recovery", "extraction_presence_check", "filtered_out_of_scope"


def route(groups: Column, filtered: Column) -> Column:
    """Where a reference goes: filtered, presence check, recovery of one target or choice between several."""
    return F.when(filtered, FILTERED).when(groups > 1, DISAMBIGUATION).when(groups == 1, RECOVERY).otherwise(PRESENCE)


def bundle(candidates: DataFrame, most: int = 12) -> DataFrame:
    """(entry_id, law_id, sources, rank): candidates (entry_id, law_id, origin, origin_rank) once each, best origin first."""
    each = candidates.groupBy("entry_id", "law_id").agg(F.min("origin_rank").alias("best"), F.array_sort(F.collect_set("origin")).alias("sources"))
    rank = F.row_number().over(W.partitionBy("entry_id").orderBy("best", "law_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= most).select("entry_id", "law_id", "sources", "rank")


#: What a reviewer is told, by route, from the second version of the prompts on.
POLICIES = {
    DISAMBIGUATION: (
        "Decide from target_reference, context_block and candidate_targets alone; nothing remembered or looked up counts.",
        "target_decision_date_iso, target_judicate_name and target_duplicate_canonical_document_id of a candidate are evidence; date agreement with a date in the context is strong evidence.",
        "A court that the context names is a hard limit: a lower court's decision is none of a supreme court's documents.",
        "Of duplicate records choose the one in target_duplicate_canonical_document_id. Where several documents stay possible, or a chamber number is missing, answer ambiguous.",
    ),
    RECOVERY: (
        "Choose among candidate_targets only: exact_target, same_proceeding or unresolved.",
        "target_decision_date_iso and target_duplicate_canonical_document_id are evidence; date agreement counts for a target. A sheet number at the end does not make another decision.",
        "Same root and another decision is same_proceeding, as is one part of a merged document. Another court than the context names is unresolved.",
    ),
    PRESENCE: (
        "Count references to other decisions or files only: no reporter or collection citations, no page headers, not the document's own number in its head.",
        "A number in running text that tells what another court decided is a reference, whether or not the corpus has its target.",
    ),
}
PROMPT_FIELDS = {DISAMBIGUATION: ("target_reference", "context_block", "candidate_targets"), RECOVERY: ("target_reference", "context_block", "candidate_targets"), PRESENCE: ("candidate_text", "context_block", "reference_type_hint")}


def prompts(queue: DataFrame, version: str = "v2") -> DataFrame:
    """(entry_id, prompt): the JSON payload of each queue row for its ``route``; rows of no known route carry all their columns.

    From v2 on a payload has the policy of its route.
    """
    columns = [c for c in queue.columns if c not in ("entry_id", "route")]
    route = F.col("route") if "route" in queue.columns else F.lit(None).cast("string")
    prompt = F.to_json(F.struct(F.lit(version).alias("version"), *columns))
    for name, fields in PROMPT_FIELDS.items():
        policy = [F.array(*map(F.lit, POLICIES[name])).alias("policy")] if version != "v1" else []
        own = F.to_json(F.struct(F.lit(name).alias("route"), *[F.col(f) for f in fields if f in columns], *policy))
        prompt = F.when(route == name, own).otherwise(prompt)
    return queue.select("entry_id", prompt.alias("prompt"))


#: Answers of a baseline that reads nothing, by route.
CONSTANT = {DISAMBIGUATION: "ambiguous", RECOVERY: "unresolved", PRESENCE: "is_reference"}


def baseline(queue: DataFrame) -> DataFrame:
    """(entry_id, route, decision, confidence): one constant decision for each route."""
    answers = F.create_map(*[F.lit(x) for pair in CONSTANT.items() for x in pair])
    return queue.select("entry_id", "route", F.coalesce(F.element_at(answers, F.col("route")), F.lit("unresolved")).alias("decision"), F.lit(0.0).alias("confidence"))


# What tells of a lower court, or of the antitrust office, whose documents the corpus would have named.
LOWER_COURT = r"(?iu)vrchn[ií]|krajsk|městsk|mestsk|okresn|obvodn"
OFFICE_BODY = r"(?iu)(?:^|[\s./-])(?:úohs|uohs)(?:[-/\s]|$)"
OFFICE_HINT = r"(?iu)předsed[ay]?\s+úřadu|predsed[ay]?\s+uradu|úohs|uohs"


def needs_no_check(body: Column, text: Column, court: Column) -> Column:
    """Whether an uploaded reference without candidates is known to be none of the corpus: of a lower court or of the office."""
    hint = F.trim(F.coalesce(court, F.lit("")))
    return hint.rlike(LOWER_COURT) | hint.rlike(OFFICE_HINT) | F.trim(F.coalesce(body, F.lit(""))).rlike(OFFICE_BODY) | F.trim(F.coalesce(text, F.lit(""))).rlike(OFFICE_BODY)


def upload_tasks(refs: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ref_id, route, candidate_targets): review tasks of the unlinked references of an upload.

    ``candidates`` has (ref_id, rank, target). References out of scope, and those without
    candidates that need no check, give none.
    """
    listed = candidates.groupBy("ref_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda c: c["target"]).alias("candidate_targets"))  # at most a dozen each
    rows = refs.join(links.select("ref_id"), "ref_id", "left_anti").join(listed, "ref_id", "left")
    n = F.coalesce(F.size("candidate_targets"), F.lit(0))
    route = F.when(n > 1, DISAMBIGUATION).when(n == 1, RECOVERY).when(~needs_no_check(F.col("body"), F.col("text"), F.col("court")), PRESENCE)
    scope = F.col("scope_reason").isNull() if "scope_reason" in refs.columns else F.lit(True)
    return rows.filter(scope).select("ref_id", route.alias("route"), F.coalesce("candidate_targets", F.array().cast("array<string>")).alias("candidate_targets")).filter("route is not null")


def packed(spans: DataFrame, docs: DataFrame, candidates: DataFrame | None = None, before: int = 350, after: int = 350) -> DataFrame:
    """(entry_id, document_id, start, end, target_reference, context_start, context_block, candidate_targets): spans with the text around them, for audits, pilots and benchmarks.

    ``spans``: entry_id, document_id, start, end (code points); ``docs``: document_id, text;
    ``candidates``: entry_id, rank, target.
    """
    rows = spans.select("entry_id", "document_id", "start", "end").join(docs.select("document_id", "text"), "document_id")
    low = F.greatest(F.lit(0), F.col("start") - before)
    out = rows.select("entry_id", "document_id", "start", "end", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("target_reference"), low.alias("context_start"), F.translate(F.substr("text", low + 1, F.col("end") + after - low), "\n", " ").alias("context_block"))
    none = F.array().cast("array<string>")
    if candidates is None:
        return out.withColumn("candidate_targets", none)
    listed = candidates.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda c: c["target"]).alias("candidate_targets"))
    return out.join(listed, "entry_id", "left").withColumn("candidate_targets", F.coalesce("candidate_targets", none))


def audit_summary(audit: DataFrame) -> DataFrame:
    """(part, name, decision, n) of audit rows (decision, kind, source, issue): decisions by kind and by source, and issues."""
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(c).alias("name")) for p, c in (("kind", "kind"), ("source", "source"), ("issue", "issue"))]))
    return audit.select("decision", parts.alias("p")).select("p.part", "p.name", "decision").filter("name is not null").groupBy("part", "name", "decision").agg(F.count(F.lit(1)).alias("n"))


def offline(prompt: str) -> dict:
    """The reviewer of tests and of runs without a network: it decides nothing."""
    return {"decision": "unresolved", "confidence": 0.0, "rationale": "offline"}


def ask(queue: DataFrame, reviewer: Callable[[str], dict] = offline, retries: int = 2) -> DataFrame:
    """(entry_id, decision, confidence, error) of a reviewer for rows (entry_id, prompt); failures give a row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for prompt in batch.column("prompt").to_pylist():
                for attempt in range(retries + 1):
                    try:
                        answer = reviewer(prompt)
                        out.append((str(answer["decision"]), float(answer.get("confidence", 0.0)), None))
                        break
                    except Exception as error:  # a row must say what went wrong, whatever the client raises
                        if attempt == retries:
                            out.append(("api_error", 0.0, json.dumps(str(error))))
                        else:
                            time.sleep(min(2.0, 0.5 * attempt))
            yield pa.RecordBatch.from_arrays([batch.column("entry_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string())))], names=["entry_id", "decision", "confidence", "error"])

    return queue.select("entry_id", "prompt").mapInArrow(run, f"entry_id {dict(queue.dtypes)['entry_id']}, decision string, confidence double, error string")


def resolved_conflicts(answers: DataFrame) -> DataFrame:
    """(alias, classification, law_ids, law_id) of answers (alias, candidates, classification, law_ids) about aliases of several laws.

    Laws outside the candidates do not count. 'single' keeps the first one, 'reject' none, and
    'ambiguous_valid' all; no answer is a rejection. ``law_id`` is there where one law is left.
    """
    inside = F.filter(F.coalesce("law_ids", F.array().cast("array<string>")), lambda x: F.array_contains("candidates", x))
    rows = answers.withColumn("inside", inside).withColumn("classification", F.coalesce("classification", F.lit("reject")))
    laws = F.when(F.col("classification") == "single", F.slice("inside", 1, 1)).when(F.col("classification") == "ambiguous_valid", F.col("inside")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("alias", "classification", laws.alias("law_ids"))
    return rows.withColumn("law_id", F.when(F.size("law_ids") == 1, F.get("law_ids", F.lit(0))))


def validated(results: DataFrame, allowed: str = "candidates", chosen: str = "chosen", sure: str = "confidence") -> DataFrame:
    """Choices outside the shortlist become null, with confidence at most 0.5."""
    inside = F.coalesce(F.array_contains(allowed, F.col(chosen)), F.lit(False))
    return results.withColumn(sure, F.when(inside | F.col(chosen).isNull(), F.col(sure)).otherwise(F.least(F.col(sure), F.lit(0.5)))).withColumn(chosen, F.when(inside, F.col(chosen)))


def consistent(rows: DataFrame, keys: list[str], positive: Column, sure: str = "confidence") -> DataFrame:
    """One positive row promotes all rows of its document and body: (…, promoted), with confidence 0.55 at least."""
    any_positive = F.max(F.when(positive, 1).otherwise(0)).over(W.partitionBy(*keys)) == 1
    return rows.withColumn("promoted", any_positive).withColumn(sure, F.when(F.col("promoted"), F.greatest(F.col(sure), F.lit(0.55))).otherwise(F.col(sure)))


def weak_evidence(rows: DataFrame, prefixes: tuple[str, ...], below: float = 0.75) -> DataFrame:
    """Resolved rows of low confidence by stage."""
    staged = F.lit(False)
    for p in prefixes:
        staged = staged | F.col("stage").startswith(p)
    return rows.filter(F.col("law_id").isNotNull() & (F.col("confidence") < below) & staged)
