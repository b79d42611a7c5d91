import json

from pyspark.sql import functions as F

from papyrine.operators import metadata, status, visuals

BLOCK = "doc_id int, page_no int, pos int, text string, font double, bold boolean, top double, kind string"


def page(spark, *rows):
    return spark.createDataFrame([(1, p, i, t, f, b, y, "text") for i, (p, t, f, b, y) in enumerate(rows)], BLOCK)


def test_title(spark):
    x = page(spark, (1, "Journal of Things", 20.0, False, 40.0), (1, "https://x.org/very/long", 30.0, False, 60.0), (1, "The actual title of the paper", 18.0, True, 160.0), (1, "body", 10.0, False, 300.0))
    assert metadata.titles(x).head().title == "The actual title of the paper"
    assert metadata.titles(page(spark, (1, "Short", 9.0, False, 40.0), (1, "Other", 12.0, False, 50.0))).head().title == "Other"


def test_abstract(spark):
    f = lambda *rows: [r.abstract for r in metadata.abstracts(page(spark, *rows)).collect()]
    assert f((1, "Abstract: We show.", 10.0, False, 100.0)) == ["We show."]
    assert f((1, "ABSTRACT", 10.0, False, 100.0), (1, "Next block", 10.0, False, 120.0)) == ["Next block"]
    assert f((1, "None here", 10.0, False, 100.0)) == []
    assert f((2, "Abstract", 10.0, False, 100.0)) == []


def test_byline(spark):
    f = lambda *rows: [r.authors for r in metadata.bylines(page(spark, *rows)).collect()]
    title = (1, "A long enough title for this very paper", 18.0, True, 100.0)
    assert f(title, (1, "Yunjin Yao a,* , Yating Liu a", 10.0, False, 200.0)) == [["Yao, Yunjin", "Liu, Yating"]]
    assert f(title, (1, "Abstract of it", 10.0, False, 150.0), (1, "Ann Lee", 10.0, False, 200.0)) == []
    short = (1, "A Great Paper", 18.0, True, 60.0)
    assert f(short, (1, "Ann Lee", 10.0, False, 100.0), (1, "some words of body text here", 10.0, False, 200.0)) == []


def test_cascade(spark):
    blocks = page(spark, (1, "A long enough title for this very paper", 18.0, True, 160.0), (1, "Ann Lee", 10.0, False, 200.0))
    texts = spark.createDataFrame([(1, "doi.org/10.1000/x published 2020")], "doc_id int, full_text string")
    r = metadata.metadata(blocks, texts, 2024).head()
    assert (r.title[:6], r.doi, r.year, r.metadata_source, r.metadata_confidence, r.authors, r.abstract) == ("A long", "10.1000/x", 2020, "pdf", 0.4, ["Lee, Ann"], None)
    message = {"title": ["<i>T</i> &amp; U"], "author": [{"given": "G", "family": "F"}, {"name": "Bo Day"}, {"family": "Solo"}], "container-title": ["J"], "published": {"date-parts": [[2011, 2]]}, "subject": ["s"]}
    looked = metadata.parse_crossref(spark.createDataFrame([("10.1000/x", json.dumps(message)), ("10.9/z", "broken")], "doi string, message string"))
    r = metadata.metadata(blocks, texts, 2024, crossref=looked).head()
    assert (r.title, r.authors, r.journal, r.year, r.metadata_source, r.metadata_confidence, r.keywords) == ("T & U", ["F, G", "Day, Bo", "Solo"], "J", 2011, "crossref", 0.9, ["s"])
    assert metadata.metadata(blocks, texts, 2024, crossref=looked, offline=True).head().metadata_source == "pdf"
    llm = lambda rows: rows.select("doc_id", F.lit("New title").alias("title"), F.lit("An abstract").alias("abstract"), F.array(F.lit("Cy Fox")).alias("authors"))
    r = metadata.metadata(blocks, texts, 2024, llm=llm).head()
    assert (r.title[:6], r.abstract, r.authors, r.metadata_source, r.metadata_confidence) == ("A long", "An abstract", ["Lee, Ann"], "hybrid", 0.6)


BOX = "left double, top double, right double, bottom double"


def captions(spark, rows):
    b = spark.createDataFrame([(1, p, i, t, "text", *map(float, box)) for i, (p, t, box) in enumerate(rows)], f"doc_id int, page_no int, pos int, text string, kind string, {BOX}")
    return visuals.captions(b)


def items(spark, rows):
    d = spark.createDataFrame([(1, p, i, c, *map(float, box)) for i, (p, c, box) in enumerate(rows)], f"doc_id int, page_no int, det_seq int, class string, {BOX}")
    return visuals.detections(d)


def test_captions_go_to_the_nearest_left(spark):
    cands = captions(spark, [(1, "Figure 3. Near both", (100, 210, 300, 230)), (1, "Figure 4. Further", (100, 260, 300, 280)), (1, "Table 1. T", (100, 205, 300, 215)), (2, "Figure 9. Else", (0, 0, 1, 1))])
    got = {r.n: (r.id, r.caption) for r in visuals.assign_captions(items(spark, [(1, "figure", (100, 100, 300, 200)), (1, "image", (100, 100, 300, 205)), (1, "figure", (100, 100, 300, 190))]), cands).collect()}
    assert got == {1: ("Figure 3", "Figure 3. Near both"), 2: ("Figure 4", "Figure 4. Further"), 3: ("Figure 3", "")}


def test_caption_out_of_reach_and_tie(spark):
    far = captions(spark, [(1, "Figure 1. Far", (100, 401, 300, 410))])
    assert visuals.assign_captions(items(spark, [(1, "figure", (100, 100, 300, 201))]), far).head().caption == ""
    tie = captions(spark, [(1, "Figure 1. First", (100, 210, 300, 220)), (1, "Figure 2. Second", (100, 210, 300, 220))])
    assert visuals.assign_captions(items(spark, [(1, "figure", (100, 100, 300, 200))]), tie).head().id == "Figure 1"


def test_detection_ids(spark):
    got = [(r.id, r.file) for r in items(spark, [(1, "figure", (0, 0, 1, 1)), (1, "table", (0, 0, 1, 1)), (2, "image", (0, 0, 1, 1)), (2, "text", (0, 0, 1, 1))]).orderBy("det_seq").collect()]
    assert got == [("Figure 1", "fig_1_p1.png"), ("Table 1", "tab_1_p1.png"), ("Figure 2", "fig_2_p2.png")]


def test_equation_context(spark):
    blocks = spark.createDataFrame([(1, 1, 1, "far above", "text", 10.0, 20.0), (1, 1, 2, "above", "text", 80.0, 105.0), (1, 1, 3, "above too", "text", 70.0, 105.0), (1, 1, 4, "below", "text", 125.0, 140.0)], "doc_id int, page_no int, pos int, text string, kind string, top double, bottom double")
    eqs = spark.createDataFrame([(1, 1, 1, 100.0, 130.0), (1, 2, 2, 0.0, 1.0)], "doc_id int, page_no int, eq_no int, top double, bottom double")
    got = {r.eq_no: r.context for r in visuals.equation_context(eqs, blocks).collect()}
    assert got == {1: "above\n[FORMULA PLACEHOLDER]\nbelow", 2: None}


def test_summary(spark):
    rows = spark.createDataFrame([("a", "success", 2.0), ("b", "partial", 4.0), ("c", "error", 0.0), ("d", "skipped", 9.0)], "name string, status string, seconds double")
    r = status.summarize(rows, 15.0).head()
    assert (r.total, r.success, r.partial, r.errors, r.skipped, r.total_seconds, r.avg_seconds) == (4, 1, 1, 1, 1, 15.0, 2.0)
    assert status.summarize(rows.limit(0), 0.0).head().avg_seconds == 0.0


def test_empty_latex(spark):
    crops = spark.createDataFrame([(1, "x=1 \\\\tag{2}"), (2, " "), (3, None)], "eq_no int, raw_latex string")
    assert [(r.eq_no, r.id) for r in visuals.equations(crops).collect()] == [(1, "(2)")]
    assert sorted((r.eq_no, r.latex == "") for r in visuals.equations(crops, ocr_available=False).collect()) == [(1, False), (2, True), (3, True)]


def test_ocr_blocks_count_on(spark):
    from papyrine.operators import ocr

    have = spark.createDataFrame([(1, 1, "a"), (1, 4, "b"), (2, 1, "c")], "doc_id int, pos int, text string")
    read = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (3, 1, "z")], "doc_id int, pos int, text string")
    assert sorted(tuple(r) for r in ocr.add_ocr(have, read).collect()) == [(1, 1, "a"), (1, 4, "b"), (1, 5, "x"), (1, 6, "y"), (2, 1, "c"), (3, 1, "z")]
