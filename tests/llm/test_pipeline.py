"""The pipeline's stages: columns, decisions and counts against brute force."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from citeloom import ship
from citeloom.llm import mixing

from .test_operators import LOWER, components, lines, rows_of

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality classifier", "exact dedup", "minhash near-dedup", "mixing to target weights", "packing"]
    for name, stage in P.STAGES[:-1]:
        before, docs = rows_of(docs), stage(spark, docs, SF).cache()
        after = rows_of(docs)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "exact dedup":
            best: dict = {}
            for i, t in before:
                best[t.translate(LOWER)] = max(best.get(t.translate(LOWER), i), i)
            assert sorted(i for i, _ in after) == sorted(best.values())
        if name == "minhash near-dedup":
            assert sorted(i for i, _ in after) == sorted(i for i, c in components(before, 5).items() if i == c)
        if name == "mixing to target weights":
            frame = spark.createDataFrame([(i, t, s) for (i, t), s in zip(before, sources, strict=True)], "doc_id long, text string, source string")
            assert Counter(i for i, _ in after) == Counter({r["doc_id"]: r["times"] for r in mixing.mix(frame).collect() if r["times"]})
        sources = [r["source"] for r in docs.select("source").collect()]
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.collect()} == {i for i, _ in rows_of(docs)}


def test_run_reads_whole_table(spark):
    assert P.run(spark, SF).count() > 0


def test_odd_rows(spark):
    ship(spark)
    text = lines(1, 30)
    rows = [(1, text), (1, text), (2, text.replace("a", "A")), (3, None), (4, ""), (None, text), (None, None), (5, text + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s" if i != 5 else None, 0, "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fold string")
    exact = P.exact_stage(spark, docs, SF).cache()
    assert Counter((t or "").translate(LOWER) for _, t in rows_of(exact)) == Counter({text.translate(LOWER): 1, "": 1, (text + " tail").translate(LOWER): 1})
    near = P.near_stage(spark, exact, SF).cache()
    assert len(rows_of(near)) == 2
    assert P.mixing_stage(spark, near, SF).columns == docs.columns
    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs.limit(0), SF).count() == 0
    # the classifier judges each row by its text, nulls as empty ones, and keeps all columns
    kept = P.quality_stage(spark, docs, SF)
    model = P.quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {t: s >= 0.3 for t, s in zip([text, "", text + " tail", text.replace("a", "A")], model.score([text, "", text + " tail", text.replace("a", "A")]))}
    assert kept.columns == docs.columns and Counter(rows_of(kept)) == Counter((i, t) for i, t in rows if good[t or ""])
    # near duplicates: rows of one identifier go together, one without is kept only where no other has its text
    near = P.near_stage(spark, docs, SF)
    assert Counter(i for i, t in rows_of(near) if t == text) == Counter({1: 2, None: 1}) and {i for i, _ in rows_of(near)} == {1, 3, 4, None}
    # repeated rows are packed as often as they occur, nulls as one id
    pieces = P.packing_stage(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(i for i, _ in rows)
    assert all(r["doc_tokens"] == 1 for r in pieces if r["doc_id"] in (3, 4))
    assert P.quality_stage(spark, docs.limit(0), SF).count() == 0
