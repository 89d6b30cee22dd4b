"""Sources, sinks, streaming, graph and review operators on small inputs; the entry point."""

from __future__ import annotations

import json

import pytest

import __spark_entry__ as entry
from citeloom import ship
from citeloom.operators import graph as G
from citeloom.operators import review as R
from citeloom.sources import corpus, sinks
from citeloom.streaming import ingest


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns == ["law_id", "citations"] and entry.entry(spark).count() == 15


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_corpus_files(spark, tmp_path):
    for source, name in (("ns", "21 Cdo 5_2010.txt"), ("ns", "a.txt"), ("nalus", "3-84-94.txt"), ("other", "b.txt")):
        (tmp_path / source).mkdir(exist_ok=True)
        (tmp_path / source / name).write_text(f"text of {name}\nčára", encoding="utf-8")
    rows = {(r["source"], r["document_id"]): r["text"] for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {("ns", "21 Cdo 5_2010.txt"), ("ns", "a.txt"), ("nalus", "3-84-94.txt")} and rows["ns", "a.txt"] == "text of a.txt\nčára"
    assert corpus.read_corpus(spark, str(tmp_path), 1).count() == 2


def test_registry_aliases_timelines(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"položky": [{"typ": "právní-akt", "akt-citace": "1/2000 Sb.", "akt-název-vyhlášený": "old"}, {"typ": "právní-akt", "akt-citace": "1/2000 Sb.", "akt-název-vyhlášený": "new"}, {"typ": "jiný", "akt-citace": "2/2000 Sb.", "akt-název-vyhlášený": "x"}]}), encoding="utf-8")
    assert [tuple(r) for r in corpus.read_registry(spark, str(tmp_path / "r.json")).collect()] == [("1/2000 Sb.", "new")]
    (tmp_path / "a.json").write_text(json.dumps({"ZOHS": "143/2001 Sb.", "oz": {"law_ids": ["1/2000 Sb."], "match_mode": "exact"}}), encoding="utf-8")
    assert {(r["alias"], tuple(r["law_ids"]), r["match_mode"]) for r in corpus.read_alias_layer(spark, str(tmp_path / "a.json"), "seed").collect()} == {("ZOHS", ("143/2001 Sb.",), None), ("oz", ("1/2000 Sb.",), "exact")}
    (tmp_path / "t.json").write_text(json.dumps({"1/2000 Sb.": {"timeline": [{"iri": "b", "effective_from": "2010-01-01"}, {"iri": "a", "effective_from": "2000-01-01"}]}}), encoding="utf-8")
    assert [(r["effective_from"], r["effective_to"]) for r in corpus.read_timelines(spark, str(tmp_path / "t.json")).orderBy("effective_from").collect()] == [("2000-01-01", "2010-01-01"), ("2010-01-01", None)]


def test_jsonl_drops_broken_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"source": "ns", "document_id": "a"}\n\nbroken\n{"source": "ns", "document_id": "b", "decision_year": 2000}\n')
    assert {r["document_id"] for r in corpus.read_metadata(spark, str(tmp_path / "m.jsonl")).collect() if r["document_id"]} == {"a", "b"}


def test_decision_pages(spark):
    ship(spark)
    pages = spark.createDataFrame([(1, '<table><td class="DocContent">A<br>b  c</td></table>'), (2, '<input id="docContentHidden" value="x\\par y">'), (3, None), (4, "<p>no</p>")], "page_id long, html string")
    assert dict(tuple(r) for r in corpus.decision_texts(pages).collect()) == {1: "A\nb c", 2: "x\ny", 3: "", 4: ""}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["a"], {"k": 1})], "i int, s string, l array<string>, m map<string,int>")
    assert tuple(sinks.csv_ready(df).first()) == ("1", "", '["a"]', '{"k":1}')
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_summary(df, str(tmp_path / "s"))
    assert json.loads(spark.read.text(str(tmp_path / "s")).first()[0])["l"] == ["a"]


def test_ingest_takes_only_new_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "id int, text string"

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        ingest.ingest(spark, stream, lambda df: df.filter("text <> ''"), str(tmp_path / "out"), ("id",), str(tmp_path / "check"))
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/rows")).select("id", "text").collect())

    (tmp_path / "in/1.json").write_text('{"id": 1, "text": "a"}\n{"id": 2, "text": ""}\n')
    assert run() == [(1, "a")]
    (tmp_path / "in/2.json").write_text('{"id": 1, "text": "a again"}\n{"id": 2, "text": "late"}\n{"id": 3, "text": "c"}\n')
    assert run() == [(1, "a"), (3, "c")] 


def test_pagerank_sinks_and_loops(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 3)], "src long, tgt long")
    ranks = {r["node"]: r["rank"] for r in G.pagerank(edges).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks[3] > ranks[2] > ranks[1]
    assert G.pagerank(edges.limit(0)).count() == 0


def test_components_keep_single_nodes(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8)], "src long, tgt long")
    nodes = spark.createDataFrame([(i,) for i in (3, 4, 5, 7, 8, 9)], "node long")
    assert {r["node"]: r["component"] for r in G.components(edges, nodes).collect()} == {3: 3, 4: 3, 5: 3, 7: 7, 8: 8, 9: 8}


def test_reviewer_errors_become_rows(spark):
    ship(spark)

    def broken(prompt):
        raise ValueError("no")

    queue = spark.createDataFrame([(1, "p")], "entry_id int, prompt string")
    row = R.ask(queue, broken, retries=0).first()
    assert (row["decision"], row["confidence"]) == ("api_error", 0.0) and "no" in row["error"]


def test_no_operator_needs_the_corpus_subpackage():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "citeloom"
    users = [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"citeloom\.llm|from citeloom import llm", p.read_text())]
    assert users == []




def test_tasks_of_a_join_grow_with_its_input(spark, monkeypatch):
    """Rows of a task stay bounded: the number of tasks follows the rows, and results do not depend on it."""
    from citeloom.operators import work

    edges = spark.range(500).selectExpr("id % 37 as src", "id * 7 % 41 as tgt")
    nodes = spark.range(41).selectExpr("id as node", "id % 3 as court")
    assert work.tasks_of(edges) is None
    monkeypatch.setattr(work, "ROWS_A_TASK", 50)
    assert work.tasks_of(edges) == 10 and work.dealt(edges, "src", 10).rdd.getNumPartitions() == 10
    assert sorted(G.matrix(edges, nodes, "court", 10).collect()) == sorted(G.matrix(edges, nodes, "court").collect())
    plain, dealt = ({r["node"]: r["rank"] for r in G.pagerank(edges, rounds=3, tasks=t).collect()} for t in (None, 10))
    assert plain.keys() == dealt.keys() and all(abs(plain[k] - dealt[k]) < 1e-12 for k in plain)
