"""Long texts are read in pages, and texts that come again are mined once; both give the rows of plain mining."""

from __future__ import annotations

import random

import pytest

from citeloom.functions import law
from citeloom.operators import citations as C

WORDS = (
    "§ 5", "§ 24, 25 a 26", "§ 7 až § 9", "čl. 4", "článek 8", "§§ 12a", "zákona č. 40/64 Sb.", "č. 99/1963 Sb.", "zák. č. 40 1964 Sb.", "ve znění zákona č. 8/2004 Sb.", "téhož zákona", "tohoto §  5", "zákona", "tr. ř.", "Tr.  Ř.", "občanského zákoníku",
    "zákona o věci 7 a jiných", "odst. 1 písm. a)", "směrnice", "řádu rozhodčího soudu", "pravidel o nákladech", ". Dále", "; ", "!", "publikováno pod Sb. NSS", "sp. zn. 5 As 1/2008", "jejich §", "nález ze dne", "dále jen „zákon“", "slovo " * 30, "x" * 700, "\n\n", "až", "§", "$%",
)
ALIASES = [("tr. ř.", ["141/1961 Sb."], None), ("Tr. ř.", ["1/1111 Sb."], "inflect"), ("občanský zákoník", ["40/1964 Sb.", "89/2012 Sb."], None), ("$%", ["2/2000 Sb."], None), ("zákoník", ["3/2003 Sb."], None)]
VERSIONS = {"40/1964 Sb.": ["1964-01-01"], "89/2012 Sb.": ["2014-01-01"]}


@pytest.mark.parametrize("many", [0, 60])
@pytest.mark.parametrize("page", [40, 700])
def test_pages_give_the_rows_of_the_whole_text(monkeypatch, many, page):
    general = law.Dictionary([*ALIASES, *((f"zákon o věci {i} a jiných", [f"{i}/2000 Sb."], None) for i in range(many))])
    local = law.Dictionary([("ZOHS", ("143/2001 Sb.",), None), ("věc", ("5/2005 Sb.",), None)])
    total = 0
    for seed in range(40):
        r = random.Random(seed)
        text = " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 400)))
        plain = law.occurrences(text, local, general, "2015-05-05", VERSIONS)
        with monkeypatch.context() as m:
            for name, value in (("LONG", 0), ("PAGE", page), ("MANY_PLACES", 3)):
                m.setattr(law, name, value)
            assert law.occurrences(text, local, general, "2015-05-05", VERSIONS) == plain
        total += len(plain)
    assert total > 3000


def test_rows_of_a_long_text_leave_one_by_one():
    """Places of a text of 2 million characters are held by the page."""
    text, none = "Podle § 5 zákona č. 1/2000 Sb. rozhodl. " * 50_000, law.Dictionary(())
    rows = law.found(text, none, none, with_candidates=False)
    first = next(rows)
    source = rows.gi_frame.f_locals["source"]
    assert first["law_id"] == "1/2000 Sb." and len(source.numbers) < 3_000 and sum(1 for _ in rows) == 99_999


def test_texts_that_come_again_are_mined_once(spark, monkeypatch):
    mined, plain = [], C.law.found
    monkeypatch.setattr(C.law, "found", lambda text, *more: mined.append(text) or plain(text, *more))
    run = {}
    monkeypatch.setattr(C, "spread", lambda df, by: type("Batches", (), {"mapInArrow": lambda self, f, schema: run.update(f=f)})())
    import pyarrow as pa

    docs = spark.createDataFrame([(1, "")], "k long, text string")
    C.law_occurrences(docs, ("k",), fields=("seq", "law_id", "number"))
    texts = ["§ 5 zákona č. 1/2000 Sb.", None, "nic", "§ 6 zákona č. 2/2000 Sb. " * 300]
    batch = pa.RecordBatch.from_pydict({"k": list(range(40)), "text": texts * 10})
    got = [r for b in run["f"](iter([batch, batch])) for r in b.to_pylist()]
    assert len(mined) == 3 + 20 and len(got) == 2 * 10 * (2 + 600)
    assert [(r["seq"], r["law_id"], r["number"]) for r in got if r["k"] == 36] == [(0, "1/2000 Sb.", "5"), (1, "1/2000 Sb.", None)] * 2
    assert [r["seq"] for r in got if r["k"] == 3][:600] == list(range(600))
