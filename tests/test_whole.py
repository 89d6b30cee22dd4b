"""Queries that read whole tables and texts: rows that a filter, prefix or row cap would leave out."""

from __future__ import annotations

import hashlib
import re

import __spark_entry__ as entry


def run(spark, folder, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return [tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()]


def test_versions_of_all_lineitem_rows(spark, tmp_path):
    lineitem = [(7, 1, "2020-01-01"), (8, 1, "2020-03-01"), (9, 2, "2020-02-01")]
    orders = [(1, 1, "2020-04-01"), (2, 2, "2020-04-01"), (3, 1, "2020-02-01"), (4, 2, "2020-01-01")]
    got = run(spark, tmp_path, "asof_law_version", lineitem=(lineitem, "l_orderkey long, l_suppkey long, l_shipdate string"), orders=(orders, "o_orderkey long, o_custkey long, o_orderdate string"))
    assert sorted(got) == [(1, "2020-03-01"), (2, "2020-02-01"), (3, "2020-01-01"), (4, None)]


def test_keys_of_all_suppliers(spark, tmp_path):
    got = dict(run(spark, tmp_path, "selfid_keys", supplier=([(9001,), (12345,), (12346,), (12347,), (12348,), (5,)], "s_suppkey long")))
    assert got[9001] == "S90012014,S90012014VZ" and got[12345] == "S123452014,S123452014VZ" and got[5] == "S00052014,S00052014VZ,S52014"
    assert got[12348] == "IIIUS123481999,IIIUS1234899,US1234899" and got[12346] == "25CDO123462007,25CDO12346200712" and got[12347] == "S12123472014"


def test_normalized_text_beyond_200_characters(spark, tmp_path):
    texts = ["a " * 200 + "end-\nless\u00a0\u200bx", "a " * 200 + "other", None]
    got = run(spark, tmp_path, "normalized_text", documents=(list(enumerate(texts)), "doc_id long, text string"))
    normal = ["a " * 200 + "endless x", "a " * 200 + "other"]
    assert sorted(got)[:2] == [(i, hashlib.sha256(x.encode()).hexdigest(), len(x)) for i, x in enumerate(normal)] and sorted(got)[2] == (2, None, None)


def test_texts_with_one_opening_count_apart(spark, tmp_path):
    rows = [("cs", "s", "x" * 40 + end) for end in ("a", "b", "b")] + [("cs", "s", None)]
    assert run(spark, tmp_path, "counts_by_source", documents=(rows, "lang string, source string, text string")) == [("cs", "s", 4, 2)]


def test_position_of_every_part(spark, tmp_path):
    sizes = [(k, k * 7 % 11) for k in range(1, 301)]
    got = run(spark, tmp_path, "custom_order", part=(sizes, "p_partkey long, p_size int"))
    expected = sorted(sizes, key=lambda p: (p[1] % 4, p[0]))
    labels = ("high", "medium", "low", "none")
    assert sorted(got, key=lambda r: r[2]) == [(k, labels[n % 4], i + 1) for i, (k, n) in enumerate(expected)]
    assert run(spark, tmp_path, "custom_order", part=([], "p_partkey long, p_size int")) == []


def test_windows_without_digits(spark, tmp_path):
    """The windows of each document are those that trying the same places one by one gives."""
    texts = ["word " * 200, "7 " * 300, ("plain text " * 40 + "12 345 ") * 5, "short 1", None, "é😀 " * 150 + "9" + " x" * 200]
    got = run(spark, tmp_path, "negative_windows", documents=(list(enumerate(texts)), "doc_id long, text string"))
    expected = []
    for doc_id, text in enumerate(texts):
        text, found = text or "", []
        for k in range(200 if len(text) >= 200 else 0):
            low = int(hashlib.sha256(f"42:{doc_id}:{k}".encode()).hexdigest()[:12], 16) % (len(text) - 200 + 1)
            if len(found) < 3 and not re.search("[0-9]", text[low : low + 200]) and all(abs(low - x) >= 200 for x in found):
                found.append(low)
        expected += [(doc_id, low, low + 200) for low in found]
    assert sorted(got) == sorted(expected) and len(expected) > 5


def test_law_numbers_of_any_length(spark, tmp_path):
    rows = [(1, 1, 9999, 64), (2, 1, 123455, 5), (3, 1, 7, 30)]
    got = run(spark, tmp_path, "law_id_canonical", lineitem=(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long"))
    assert sorted(got) == [(1, 1, "10000/1964 Sb."), (2, 1, "123456/2005 Sb."), (3, 1, "8/2030 Sb.")]
