"""Normalized texts map back to the raw ones; blocks become paragraphs."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from citeloom.functions.spans import Normalized, joined_lines, page_text


@pytest.mark.parametrize(
    "raw,text",
    [("  a  b \tc ", "a b c"), ("obec-\nného zá-\r\n  kona", "obecného zákona"), ("a​b", "ab"), ("", ""), (" \n ", ""), ("5-\n6", "5- 6"), ("x -\ny", "x - y"), ("😀a  §", "😀a §")],
)
def test_normalized(raw, text):
    assert Normalized(raw).text == text


def test_spans_cover_squeezed_runs():
    n = Normalized("ab-\ncd  \n ef")
    assert n.text == "abcd ef" and n.raw_span(0, 4) == (0, 6) and n.raw_span(4, 5) == (6, 10) and n.raw_span(5, 7) == (10, 12)
    assert n.raw_span(-3, 99) == (0, 12) and n.raw_span(99, 99) == (12, 12) and Normalized("").raw_span(0, 1) == (0, 0)


@given(st.text(alphabet="ab -\n\r\t​ é§", max_size=40))
def test_every_character_maps_to_itself(raw):
    n = Normalized(raw)
    assert n.text == n.text.strip() and "  " not in n.text
    for k, c in enumerate(n.text):
        start, end = n.raw_span(k, k + 1)
        assert 0 <= start < end <= len(raw) and (raw[start] == c or c == " " and raw[start].isspace())


def test_blocks():
    assert joined_lines("roz-\nhodl soud\nv Brně.\nDále") == "rozhodl soud v Brně.\nDále"
    assert page_text([(10, 0, 90, 10, "první část"), (12, 15, 90, 25, "druhá."), (10, 30, 90, 40, "Nový odstavec"), (200, 32, 290, 42, "jiný sloupec"), (10, 44, 20, 50, "II."), (10, 52, 20, 60, "text")]) == "první část druhá.\nNový odstavec\njiný sloupec\nII.\ntext"
