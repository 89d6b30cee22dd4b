"""Readers: corpus text files, JSON lines, registry and dictionary JSON, metadata, HTML pages, PDF files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The folders of a corpus, one for each source; fixed values.
SOURCES = ("nalus", "ns", "nss", "uohs")
METADATA = "source string, document_id string, processed_rel_path string, judicate_name string, name string, judicate_iri string, iri string, blob_name string, decision_date string, decision_date_iso string, decision_year int, decision_date_precision string, self_identifier_text string, identifier_text string, identifier_kind string"
LAW_OCCURRENCES = "document_id string, source string, document_path string, citation_text string, citation_type string, resolved_law_id string, predicted_classification string, resolver_stage string, confidence double, quality_flag boolean, needs_review boolean, context string, candidate_law_ids array<string>"


def read_corpus(spark: SparkSession, root: str, limit_per_source: int | None = None) -> DataFrame:
    """(source, document_id, document_path, text) of ``<root>/<source>/*.txt``; the cap, where given, is by document id."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("document_path"), F.col("value").alias("text"))
    name = F.url_decode(F.regexp_replace("document_path", r"\+", "%2B"))
    docs = files.select(F.regexp_extract(name, r"/([^/]+)/[^/]+$", 1).alias("source"), F.regexp_extract(name, r"/([^/]+)$", 1).alias("document_id"), "document_path", "text").filter(F.col("source").isin(*SOURCES))
    if limit_per_source is None:
        return docs
    rank = F.row_number().over(W.partitionBy("source").orderBy("document_id"))
    return docs.withColumn("__r", rank).filter(F.col("__r") <= limit_per_source).drop("__r")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip, by schema; broken lines are dropped, missing fields are null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, METADATA)


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Law occurrences; the flag of older files counts where the newer one is absent."""
    return read_jsonl(spark, path, LAW_OCCURRENCES).withColumn("quality_flag", F.coalesce("quality_flag", "needs_review")).drop("needs_review")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(law_id, name) of the legal acts of a registry file; the last entry of a law counts."""
    items = "`položky` array<struct<typ:string,`akt-citace`:string,`akt-název-vyhlášený`:string>>"
    raw = spark.read.schema(items).option("multiLine", "true").json(path).select(F.posexplode("`položky`").alias("at", "p"))
    rows = raw.select("at", F.col("p.`akt-citace`").alias("law_id"), F.col("p.`akt-název-vyhlášený`").alias("name"), F.col("p.typ").alias("typ"))
    return rows.filter("typ = 'právní-akt' and law_id is not null and name is not null").groupBy("law_id").agg(F.max_by("name", "at").alias("name"))


def read_alias_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(alias, law_ids, match_mode, layer) of a JSON object whose values are laws, lists or objects."""
    from citeloom.operators.aliases import from_json

    raw = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "payload"))
    return from_json(raw, layer)


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """(law_id, effective_from, effective_to): one row for each version, each ending where the next one starts."""
    kind = "map<string,struct<timeline:array<struct<iri:string,effective_from:string>>>>"
    laws = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", kind)).alias("law_id", "law"))
    rows = laws.select("law_id", F.explode("law.timeline").alias("v")).select("law_id", "v.iri", "v.effective_from")
    return rows.withColumn("effective_to", F.lead("effective_from").over(W.partitionBy("law_id").orderBy(F.col("effective_from").asc_nulls_last(), "iri")))


def gold_citations(spark: SparkSession, path: str) -> DataFrame:
    """One row per gold citation of per-document JSON files."""
    citation = "struct<citation_text:string,citation_type:string,start_char:int,end_char:int,law_id:string,classification:string,detail_number:string,detail_odst:array<string>,detail_pism:array<string>>"
    docs = spark.read.schema(f"document_id string, source string, citations array<{citation}>").option("multiLine", "true").json(path)
    return docs.select("document_id", "source", F.explode("citations").alias("c")).select("document_id", "source", "c.*")


def gold_references(spark: SparkSession, path: str) -> DataFrame:
    """One row per gold document reference of per-document JSON files."""
    reference = "struct<reference_text:string,start_char:int,end_char:int,reference_type:string,reference_prefix:string,reference_body:string,decision_kind_hint:string,court_hint:string>"
    docs = spark.read.schema(f"document_id string, source string, references array<{reference}>").option("multiLine", "true").json(path)
    return docs.select("document_id", "source", F.explode("references").alias("r")).select("document_id", "source", "r.*")


def decision_page(html: str) -> str:
    """Text of a decision page: the content cell, else the hidden content field, else nothing."""
    from html.parser import HTMLParser

    class Page(HTMLParser):
        depth, found, hidden = 0, None, None

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "input" and a.get("id") == "docContentHidden":
                self.hidden = a.get("value") or ""
            elif self.depth and tag == "td":
                self.depth += 1
            elif tag == "td" and "DocContent" in (a.get("class") or "").split():
                self.depth, self.found = 1, []
            elif self.depth and tag in ("br", "p", "div"):
                self.found.append("\n")

        def handle_endtag(self, tag):
            if self.depth and tag == "td":
                self.depth -= 1

        def handle_data(self, data):
            if self.depth:
                self.found.append(data)

    page = Page()
    page.feed(html)
    text = "".join(page.found) if page.found else (page.hidden or "").replace("\\par", "\n")
    return "\n".join(line for x in text.split("\n") if (line := " ".join(x.split())))


def decision_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) of rows (page_id, html), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([decision_page(h or "") for h in batch.column("html").to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string")


def read_pdf(spark: SparkSession, path: str, to_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(document_path, text) of PDF files through ``to_text``; by default PyMuPDF, where it is installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = to_text
        if convert is None:
            import fitz  # optional

            def convert(data: bytes) -> str:
                with fitz.open(stream=data, filetype="pdf") as doc:
                    return "\n".join(page.get_text() for page in doc)

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("document_path"), pa.array([convert(b) for b in batch.column("content").to_pylist()], pa.string())], names=["document_path", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("document_path"), "content").mapInArrow(run, "document_path string, text string")
