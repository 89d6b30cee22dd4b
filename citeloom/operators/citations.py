"""Documents to citation rows: law occurrences, document references, local aliases, self identifiers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions import docref, law
from citeloom.functions import text as T
from citeloom.operators.work import spread

LAW_FIELDS = [
    ("seq", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("citation_text", pa.string()), ("citation_type", pa.string()), ("number", pa.string()), ("odst", pa.list_(pa.string())), ("pism", pa.list_(pa.string())), ("body", pa.list_(pa.string())),
    ("law_id", pa.string()), ("classification", pa.string()), ("stage", pa.string()), ("confidence", pa.float64()), ("quality_flag", pa.bool_()), ("quality_reason", pa.string()), ("context", pa.string()), ("candidates", pa.list_(pa.string())),
]
REF_FIELDS = [("seq", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("prefix", pa.string()), ("body", pa.string()), ("text", pa.string()), ("kind", pa.string()), ("decision_kind", pa.string()), ("court", pa.string()), ("context", pa.string())]
SPARK = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}

Entries = Iterable[tuple[str, Iterable[str], str | None]]


#: Texts of so many characters at most are remembered with their rows, and a task remembers so many bytes (estimated).
SHORT, REMEMBERED = 4_096, 256 << 20
#: Bytes that a remembered row takes about, and rows that leave a worker in one Arrow batch.
ROW_BYTES, ROWS_OUT = 250, 10_000
#: Bytes of a batch that become Python objects at once.
AT_ONCE = 4 << 20


def _rows(fields, keys: tuple[str, ...], start):
    """mapInArrow function: key columns, then the fields of every row that ``start()(columns)`` gives for a document.

    ``start`` is called once a task, so what all its documents share is made once. Short texts that
    come again in a task are not mined again. Rows of long documents leave as they are found.
    """
    wanted = [n for n, _ in fields if n != "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, known, room = start(), {}, REMEMBERED
        for whole in batches:
            step = max(1, len(whole) * AT_ONCE // max(1, whole.nbytes))
            for low in range(0, len(whole), step):
                batch = whole.slice(low, step)
                names = [n for n in batch.schema.names if n not in keys]
                held = [batch.column(k) for k in keys]
                at, found, numbers = [], [], []

                def flushed() -> pa.RecordBatch:
                    columns = dict(zip(wanted, zip(*found, strict=True) if found else [()] * len(wanted), strict=True)) | {"seq": numbers}
                    out = pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in held), *(pa.array(columns[n], kind) for n, kind in fields)], names=[*keys, *(n for n, _ in fields)])
                    at.clear(), found.clear(), numbers.clear()
                    return out

                for k, values in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                    same = values if len(values) == 1 else tuple(tuple(v) if isinstance(v, list) else v for v in values)
                    rows = known.get(same)
                    if rows is None:
                        made = (tuple([r[n] for n in wanted]) for r in mine(dict(zip(names, values, strict=True))))
                        size = sum(len(v) for v in values if isinstance(v, str))
                        if size > SHORT:
                            for i, row in enumerate(made):
                                at.append(k)
                                numbers.append(i)
                                found.append(row)
                                if len(at) >= ROWS_OUT:
                                    yield flushed()
                            continue
                        rows = tuple(made)
                        room -= 2 * size + ROW_BYTES * (len(rows) + 1)
                        if room < 0:
                            known.clear()
                            room = REMEMBERED
                        known[same] = rows
                    at += [k] * len(rows)
                    numbers += range(len(rows))
                    found += rows
                    if len(at) >= ROWS_OUT:
                        yield flushed()
                if at:
                    yield flushed()

    return run


def _schema(docs: DataFrame, keys: tuple[str, ...], fields) -> str:
    kinds = dict(docs.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{n}` {SPARK[t]}" for n, t in fields)])


def law_occurrences(docs: DataFrame, keys: tuple[str, ...], aliases: Entries = (), versions: dict[str, list[str]] | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row per law citation. ``docs`` has ``text`` and may have ``date`` (ISO) and ``declared`` (map of local aliases).

    Texts should be normalized; the general dictionary and the versions go to every task with
    the function, so they must be small, as dictionaries are. The document is the unit of work.
    Only ``fields`` (all where none are named) are made and leave the Python workers.
    """
    general, dates = tuple((a, tuple(laws), mode) for a, laws, mode in aliases), versions or {}
    wanted = LAW_FIELDS if fields is None else [f for f in LAW_FIELDS if f[0] in fields]
    listed = any(n == "candidates" for n, _ in wanted)

    def start():
        everyone, nobody = law.Dictionary(general), law.Dictionary(())

        def mine(doc: dict) -> Iterable[dict]:
            declared = doc.get("declared")
            local = law.Dictionary((a, (x,), None) for a, x in declared) if declared else nobody
            return law.found(doc["text"] or "", local, everyone, doc.get("date"), dates, listed)

        return mine

    read = [c for c in (*keys, "text", "date", "declared") if c in docs.columns]
    return spread(docs.select(*read), "text").mapInArrow(_rows(wanted, keys, start), _schema(docs, keys, wanted))


def document_references(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per reference to another decision in ``text``."""
    start = lambda: lambda d: docref.references(d["text"] or "")
    return spread(docs.select(*keys, "text"), "text").mapInArrow(_rows(REF_FIELDS, keys, start), _schema(docs, keys, REF_FIELDS))


def declared_aliases(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, seq, alias, law_id): what documents declare as short names."""
    fields = [("seq", pa.int32()), ("alias", pa.string()), ("law_id", pa.string())]
    start = lambda: lambda d: [dict(alias=a, law_id=x) for a, x in law.declared_aliases(d["text"] or "").items()]
    return spread(docs.select(*keys, "text"), "text").mapInArrow(_rows(fields, keys, start), _schema(docs, keys, fields))


def law_anchors(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, law_id) for every law number of the text, native: for counts that need no places."""
    found = F.regexp_extract_all("text", F.lit(r"(\d{1,4}/(?:\d{4}|\d{2})\s*Sb\.)"), F.lit(1))
    return spread(docs.select(*keys, "text")).select(*keys, F.explode(found).alias("raw")).select(*keys, T.law_id(F.col("raw")).alias("law_id"))


def resolved_and_review(rows: DataFrame, with_foreign: bool = False) -> tuple[DataFrame, DataFrame]:
    """Occurrences with a law, and those for review: unresolved, foreign (if asked for) and ambiguous ones of low confidence."""
    kind = F.col("classification")
    weak = (kind == "czech_resolved") & (F.col("confidence") < law.LOW_CONFIDENCE) & F.contains("stage", F.lit("Ambiguous"))
    review = (kind == "czech_unresolved") | weak | (F.lit(with_foreign) & (kind == "foreign_law"))
    return rows.filter((kind == "czech_resolved") & F.col("law_id").isNotNull()), rows.filter(review)


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by a total order."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
