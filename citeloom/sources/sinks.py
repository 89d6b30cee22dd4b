"""Writers: JSON lines, CSV with JSON in complex cells, one-object summaries, the edge export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, nulls as empty text."""
    cells = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    return df.select(*cells).na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    csv_ready(df).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_summary(one_row: DataFrame, path: str) -> None:
    one_row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def edge_export(links: DataFrame) -> DataFrame:
    """The columns of the simplified edge list."""
    names = {"source_source": "source", "source_document_id": "source_document", "target_source": "target_source", "target_document_id": "target_document", "link_method": "method", "target_scope": "scope"}
    return links.select(*[F.col(a).alias(b) for a, b in names.items() if a in links.columns])
