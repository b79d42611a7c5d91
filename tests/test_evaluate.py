import json

import pytest

from papyrine.operators import evaluate
from papyrine.sources.gold import read_document_files

SCHEMA = "stem string, title string, doi string, year int, journal string, abstract string, authors array<string>, keywords array<string>, sections array<string>, figures int, tables int, equations int"


def report(spark, pred, gold, **k):
    p, g = (spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], SCHEMA) for rows in (pred, gold))
    return {r.field: (round(r.precision, 3), round(r.recall, 3), round(r.f1, 3), r.support) for r in evaluate.report(evaluate.pair(g, p), **k).collect()}


def row(title=None, doi=None, year=None, journal=None, abstract=None, authors=(), keywords=(), sections=(), figures=None, tables=None, equations=None):
    return (title, doi, year, journal, abstract, list(authors), list(keywords), list(sections), figures, tables, equations)


def test_corpus(spark):
    gold = [row("A Title", "10.1/X", 2020, authors=["Lee, Ann", "Day, Bo"]), row("Other", "10.1/y", 0, authors=["Fox, Cy"])]
    pred = [row("a title: with more", "10.1/x", 2020, authors=["Lee, A."]), row("", None, 0)]
    got = report(spark, pred, gold)
    assert got["doi"] == (1.0, 0.5, 0.667, 2) and got["title"] == (1.0, 0.5, 0.667, 2)
    assert got["year"] == (1.0, 1.0, 1.0, 2)
    assert got["authors"] == (0.5, 0.25, 0.333, 2)
    assert got["journal"] == (0.0, 0.0, 0.0, 0)
    assert "keywords" not in got and "figures" not in got


def test_sets_and_counts(spark):
    gold, pred = [row(keywords=["a"], sections=["Intro", "Methods", "End"], figures=4, tables=0)], [row(keywords=["A", "b"], sections=["intro", "METHODS"], figures=3, tables=2)]
    got = report(spark, pred, gold, native=True)
    assert got["keywords"] == (0.5, 1.0, 0.667, 1) and got["sections"] == (1.0, 0.667, 0.8, 1)
    assert got["figures"] == (1.0, 0.75, 0.857, 1) and "tables" not in got


def test_unmatched(spark):
    gold, pred = (spark.createDataFrame([(s,) for s in x], "stem string") for x in (["a", "b"], ["a"]))
    assert [r.stem for r in evaluate.unmatched(gold, pred).collect()] == ["b"]


def test_pairs_by_position(spark):
    make = lambda *xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "pos int, title string")
    assert [(r.g_title, r.p_title) for r in evaluate.pair_by_position(make("a", "b"), make("c", "d")).orderBy("pos").collect()] == [("a", "c"), ("b", "d")]
    with pytest.raises(Exception, match="differ in number"):
        evaluate.pair_by_position(make("a", "b"), make("c")).collect()


def test_predictions_of_documents(spark, tmp_path):
    tree = [{"heading": "A", "subsections": [{"heading": "B", "subsections": []}, {"heading": "", "subsections": [{"heading": "C"}]}]}, {"heading": "D"}]
    doc = {"metadata": {"title": "T", "authors": ["X, Y"], "year": 2001, "keywords": []}, "sections": tree, "figures": [{"id": "Figure 1"}], "tables": [], "equations": None, "raw_text": "t"}
    (tmp_path / "paper.json").write_text(json.dumps(doc))
    r = evaluate.predictions(read_document_files(spark, str(tmp_path / "*.json"))).head()
    assert (r.stem, r.title, r.sections, r.figures, r.tables, r.equations) == ("paper", "T", ["A", "B", "C", "D"], 1, 0, 0)
