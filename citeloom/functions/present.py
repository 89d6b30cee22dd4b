"""Presentation and naming as native columns: law addresses, detail labels, identities from storage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions import text as T

#: Folder names of the storage and the sources they hold, fixed values.
FOLDERS = {"UOHS": "uohs", "NS": "ns", "NSS": "nss", "NALUS": "nalus", "US": "nalus"}


def law_url(law_id: Column) -> Column:
    """Public address of a law's text, or null for other strings."""
    full = T.law_id(law_id)
    number, year = (F.regexp_extract(full, r"^0*(\d{1,4})/(\d{4}) Sb\.$", i) for i in (1, 2))
    return F.when(F.length(number) > 0, F.concat(F.lit("https://www.zakonyprolidi.cz/cs/"), year, F.lit("-"), number))


def detail_label(number: Column, odst: Column, pism: Column) -> Column:
    """'section 5 | paragraph 1 letter a': letters go with their paragraphs where there are as many, or one fewer."""
    odst, pism = F.coalesce(odst, F.array().cast("array<string>")), F.coalesce(pism, F.array().cast("array<string>"))
    n, m = F.size(odst), F.size(pism)
    pairs = F.zip_with(odst, pism, lambda o, p: F.concat(F.lit("paragraph "), o, F.when(p.isNotNull(), F.concat(F.lit(" letter "), p)).otherwise("")))
    lists = F.concat_ws("; ", F.concat(F.lit("paragraph "), F.array_join(odst, ", ")), F.when(m > 0, F.concat(F.lit("letter "), F.array_join(pism, ", "))))
    paragraph = F.when((n > 0) & (m > 0) & ((m == n) | (m == n - 1)), F.array_join(pairs, "; ")).when(n > 0, lists).when(m > 0, F.concat(F.lit("letter "), F.array_join(pism, ", ")))
    label = F.concat_ws(" | ", F.when(F.length(number) > 0, F.concat(F.lit("section "), number)), paragraph)
    return F.when(F.length(label) > 0, label)


def identity(blob: Column) -> Column:
    """struct<source, document_id> of a storage path: the folder's source, and the rest of the path flattened with underscores."""
    parts = F.filter(F.split(blob, "/"), lambda p: F.trim(p) != "")
    folder = F.upper(F.get(parts, F.lit(0)))
    known = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    tail = F.array_join(F.transform(F.slice(parts, 2, 999), lambda p: F.trim(p)), "_")
    name = F.concat(F.regexp_replace(tail, r"\.[^._/]+$", ""), F.lit(".txt"))
    return F.struct(F.when(F.size(parts) > 1, F.coalesce(F.element_at(known, folder), F.lower(folder))).alias("source"), F.when(F.size(parts) > 1, name).alias("document_id"))
