"""Folds over documents hold what lies near one place, not the whole document, and give what a plain loop over all of it gives."""

from __future__ import annotations

import random

import pytest

from citeloom.operators import evaluation as E
from citeloom.operators import work


def greedy(rows):
    """[(document, p_id, g_id)]: every prediction against every gold span."""
    out = []
    for doc in sorted({r[0] for r in rows}):
        own = sorted((start, n, side, end) for d, side, n, start, end in rows if d == doc)
        gold = [s for s in own if s[2] == "g"]
        for start, n, side, end in own:
            found = [(min(end, g[3]) - max(start, g[0]), -i) for i, g in enumerate(gold) if g is not None] if side == "p" else []
            if found and max(found)[0] > 0:
                at = -max(found)[1]
                out.append((doc, n, gold[at][1]))
                gold[at] = None
    return out


def spans(seed: int, n: int, place: int, longest: int):
    r = random.Random(seed)
    return [(r.randrange(3), r.choice("pg"), i, start := r.randrange(place), start + r.randrange(longest)) for i in range(n)]


@pytest.mark.parametrize("seed,n,place,longest", [(1, 300, 2000, 40), (2, 400, 60, 30), (3, 500, 4000, 3000), (4, 0, 1, 1)])
def test_greedy_overlap(spark, seed, n, place, longest):
    rows = spans(seed, n, place, longest)
    got = E.greedy_overlap(spark.createDataFrame(rows, "doc long, side string, id long, start long, end long"), "doc")
    assert sorted(tuple(r) for r in got.collect()) == sorted(greedy(rows))


def test_segments_and_windows(spark):
    rows = spans(5, 400, 3000, 60) + [(None, "p", 900, 5, 9), (None, "g", 901, 7, 12)]
    df = spark.createDataFrame(rows, "doc long, kind string, id long, start long, end long")
    kept, joined = [], []
    for doc in {r[0] for r in rows}:
        last, windows = -1, []
        for start, _, kind, end in sorted((s, s - e, k, e) for d, k, _, s, e in rows if d == doc):
            if start >= last:
                kept.append((doc, kind, start, end))
                last = end
        for start, end in sorted((s, e) for d, _, _, s, e in rows if d == doc):
            if windows and start <= windows[-1][1] and max(end, windows[-1][1]) - windows[-1][0] <= 100:
                windows[-1][1] = max(end, windows[-1][1])
            else:
                windows.append([start, end])
        joined += [(doc, *w) for w in windows]
    assert sorted(map(str, (tuple(r) for r in E.segments(df.drop("id"), "doc").collect()))) == sorted(map(str, kept))
    assert sorted(map(str, (tuple(r) for r in E.merged_windows(df.select("doc", "start", "end"), "doc", 100).collect()))) == sorted(map(str, joined))


def test_rows_go_through_a_fold_one_by_one(spark):
    """A document of 40,000 rows is never held: the fold has given its first rows before the last ones are read."""
    rows = spark.range(40_000).selectExpr("id % 1 as doc", "id as n")

    def fold(own):
        for (n,) in own:
            yield n, type(own).__name__

    got = work.per_document(rows, "doc", ["n"], [("at", "long"), ("held", "string")], fold)
    assert [tuple(r) for r in got.selectExpr("count(*)", "min(at)", "max(at)", "max(held)").collect()] == [(40_000, 0, 39_999, "generator")]
