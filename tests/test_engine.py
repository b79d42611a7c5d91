import json

from pyspark.sql import functions as F

from papyrine.operators import evaluate, ocr, status
from papyrine.plans.engine import Engine
from papyrine.sources import gold, raw, sinks
from papyrine.streaming.ingest import ingest


def decoder(content: bytes):
    text = content.decode()
    if text.startswith("broken"):
        raise ValueError("broken file")
    rows = [("A long enough title for this very paper", 18.0), ("Ann Lee", 10.0), ("Abstract: short of it", 10.0), ("Introduction", 10.0), (text, 10.0), (text, 10.0)]
    box = lambda i: {"x0": 50.0, "y0": 160.0 + 40 * i, "x1": 250.0, "y1": 180.0 + 40 * i}
    blocks = [{"page_no": 1, "seq": i, "page_w": 600.0, "page_h": 800.0, "type": 0, **box(i), "lines": [{**box(i), "spans": [{"text": t, "size": f, "x0": 50.0, "x1": 250.0, "flags": 0, "font": ""}]}]} for i, (t, f) in enumerate(rows)]
    return ([] if text.startswith("empty") else blocks), "doi.org/10.1000/abc published 2020 " + text


def files(folder):
    for name, text in (("a.pdf", "body text of a"), ("b.pdf", "broken"), ("c.pdf", "empty"), ("d.txt", "no pdf")):
        (folder / name).write_text(text)


def test_batch_skips_and_isolates(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    files(source)
    engine = Engine(spark, 2024, decoder=decoder)
    got = {r.doc_id: (r.status, r.missing, r.error) for r in engine.run(str(source), out).collect()}
    assert got["a"][:2] == ("success", []) and got["b"][0] == "error" and "broken file" in got["b"][2] and got["c"][0] == "error"
    assert set(got) == {"a", "b", "c"}
    again = {r.doc_id: r.status for r in engine.run(str(source), out).collect()}
    assert again["a"] == "skipped" and again["b"] == "error"
    doc = next(d for d in map(json.loads, (r.value for r in spark.read.text(out).collect())) if d["stem"] == "a")
    assert doc["metadata"]["doi"] == "10.1000/abc" and doc["metadata"]["year"] == 2020 and doc["sections"][0]["heading"].startswith("A long")
    assert doc["figures"] == doc["tables"] == doc["equations"] == [] and doc["metadata"]["title_en"] is None
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out", "out-status"]


def test_run_read_report(spark, tmp_path):
    """What a batch writes is what evaluation reads; statuses, seconds and summary come with it."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    files(source)
    (source / "E.PDF").write_text("partial text")
    told = Engine(spark, 2024, decoder=decoder).run(str(source), out, status_path=str(tmp_path / "log"))
    assert [r.doc_id for r in told.collect()] == ["E", "a", "b", "c"] and all(r.seconds > 0 for r in told.collect())
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    total = status.summarize(told).head()
    assert (total.total, total.success, total.errors) == (4, 2, 2) and total.avg_seconds > 0
    docs = gold.read_documents(spark, out)
    got = {r.stem: r for r in docs.collect()}
    assert set(got) == {"E", "a"} and got["a"].metadata.authors == ["Lee, Ann"] and got["a"].metadata.abstract == "short of it"
    assert json.loads(got["a"].sections)[0]["heading"].startswith("A long") and "body text of a" in got["a"].raw_text
    wanted = spark.createDataFrame([("a", "A Long Enough Title for this very paper", "10.1000/ABC", 2020, ["Lee, Ann", "Bo, Day"]), ("z", "missing", "10.1/z", 2001, [])], "stem string, title string, doi string, year int, authors array<string>")
    report = {r.field: (r.precision, r.recall, r.support) for r in evaluate.report(evaluate.pair(wanted, evaluate.predictions(docs)), fields=("title", "doi", "year", "authors")).collect()}
    assert report["title"] == report["doi"] == report["year"] and report["doi"][0] == 1.0 and report["authors"][:2] == (1.0, 0.5)
    # Written again, a document's last version counts.
    Engine(spark, 2010, decoder=decoder).run(str(source), out, overwrite=True)
    again = {r.stem: r.metadata.year for r in gold.read_documents(spark, out).collect()}
    assert again == {"a": None, "E": None} and spark.read.text(out).count() == 4


def test_partly_decoded_and_image_only_files_are_written(spark, tmp_path):
    def half(content: bytes):
        def blocks():
            first, *rest = decoder(b"x")[0]
            yield first
            yield from rest
            if content == b"half":
                raise ValueError("page 2 is broken")

        image = {"page_no": 1, "seq": 0, "page_w": 600.0, "page_h": 800.0, "type": 1, "x0": 1.0, "y0": 1.0, "x1": 9.0, "y1": 9.0, "lines": None}
        return ([image] if content == b"image" else blocks()), "doi.org/10.1000/abc published 2020"

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in ("half", "image", "whole"):
        (source / f"{name}.pdf").write_text(name)
    got = {r.doc_id: (r.status, r.error) for r in Engine(spark, 2024, decoder=half).run(str(source), out).collect()}
    assert got == {"half": ("success", None), "image": ("partial", None), "whole": ("success", None)}
    docs = {r.stem: r for r in gold.read_documents(spark, out).collect()}
    assert set(docs) == set(got) and docs["image"].raw_text == "" and docs["half"].metadata.authors == ["Lee, Ann"]


def test_visuals_and_tables_reach_the_document(spark, tmp_path):
    box = ("100.0D left", "250.0D top", "200.0D right", "300.0D bottom")
    detect = lambda docs: docs.selectExpr("doc_id", "1 page_no", "explode(array(0, 1)) det_seq", *box).withColumn("class", F.when(F.col("det_seq") == 0, "table").otherwise("figure"))
    read = lambda tables: tables.select("doc_id", "file", F.lit('```json{"data": [["a", "b"], ["c", "d"]]}```').alias("reply"))
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.pdf").write_text("text of it")
    Engine(spark, 2024, decoder=decoder, layout_detector=detect, vlm=read).run(str(source), out)
    doc = gold.read_documents(spark, out).head()
    assert doc.tables[0].data == [["a", "b"], ["c", "d"]] and doc.tables[0].bbox.left == 100.0 and doc.tables[0].img_path == "tab_1_p1.png"
    assert doc.figures[0].id == "Figure 1" and doc.figures[0].page == 1 and doc.figures[0].panels[0].img_path == doc.figures[0].img_path


def test_images_are_written(spark, tmp_path):
    detect = lambda docs: docs.selectExpr("doc_id", "1 page_no", "0 det_seq", "'figure' class", "1.0D left", "1.0D top", "2.0D right", "2.0D bottom")
    draw = lambda items: items.selectExpr("doc_id", "file", "cast(concat(doc_id, page_no) as binary) content")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("text of it")
    Engine(spark, 2024, decoder=decoder, layout_detector=detect, renderer=draw).run(str(tmp_path / "in"), str(tmp_path / "out"))
    assert (tmp_path / "out-images" / "a" / "fig_1_p1.png").read_text() == "a1" and len(list((tmp_path / "out-images").rglob("*.*"))) <= 2


def test_command_line(spark, tmp_path, capsys):
    from papyrine.__main__ import main

    (tmp_path / "in").mkdir()
    files(tmp_path / "in")
    asked = ["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--as-of-year", "2024", "--plugin-decoder", "test_engine:decoder", "--offline", "--no-llm"]
    assert main(asked, spark) == 0
    said = capsys.readouterr().out
    assert "a: success" in said and "broken file" in said and "total 3" in said
    assert main([*asked[:1], str(tmp_path / "none"), *asked[2:]], spark) == 1


def test_report_is_written_with_three_decimals(spark, tmp_path):
    report = spark.createDataFrame([("title", 2 / 3, 1.0, 0.8, 3)], "field string, precision double, recall double, f1 double, support int")
    sinks.write_report(report, str(tmp_path / "report"))
    assert [json.loads(x.value) for x in spark.read.text(str(tmp_path / "report")).collect()] == [{"field": "title", "precision": 0.667, "recall": 1.0, "f1": 0.8, "support": 3}]


def test_sections_mark_in_texts(spark):
    """Texts that look like the tree's mark stay as they are."""
    docs = spark.createDataFrame([(1, '"@sections@"}', '[{"heading": "@sections@"}]')], "doc_id int, title string, sections string")
    for pretty in (True, False):
        assert json.loads(sinks.document_json(docs, pretty=pretty).head().json) == {"title": '"@sections@"}', "sections": [{"heading": "@sections@"}]}


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("no pdf")
    assert Engine(spark, 2024, decoder=decoder).run(str(tmp_path / "in"), str(tmp_path / "out")).count() == 0


def test_page_gate(spark):
    pages = spark.createDataFrame([(1, 1, "text"), (1, 2, "  \n"), (1, 3, None)], "doc_id int, page_no int, page_text string")
    assert sorted(r.page_no for r in ocr.pages_needing_ocr(pages).collect()) == [2, 3]


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    files(source)
    query = ingest(Engine(spark, 2024, decoder=decoder), str(source), out, str(tmp_path / "mark"), once=True)
    query.awaitTermination(120)
    assert [r.stem for r in gold.read_documents(spark, out).collect()] == ["a"]


def test_gold_and_json(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps({"x.pdf": {"title": "T", "authors": ["A"], "year": 2020}, "y.v2.pdf": {"title": None}}))
    assert {r.stem: (r.title, r.year) for r in gold.read_gold(spark, str(path)).collect()} == {"x": ("T", 2020), "y.v2": (None, None)}
    docs = spark.createDataFrame([(1, "t", None, '[{"heading": "h"}]')], "doc_id int, title string, journal string, sections string")
    assert json.loads(sinks.document_json(docs).head().json) == {"title": "t", "journal": None, "sections": [{"heading": "h"}]}


def test_raw_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, 600.0, 800.0, 1, 0.0, 0.0, 1.0, 1.0, None)], raw.RAW)
    rows.write.parquet(str(tmp_path / "raw"))
    assert raw.read_raw_blocks(spark, str(tmp_path / "raw")).count() == 1
