from papyrine.operators import layout, ocr

SERIF = "Serif"


def span(text, x0=50.0, x1=100.0, size=10.0, flags=0, font=SERIF):
    return {"text": text, "size": size, "x0": float(x0), "x1": float(x1), "flags": flags, "font": font}


def line(*spans, y=100.0):
    return {"x0": spans[0]["x0"], "y0": y, "x1": spans[-1]["x1"], "y1": y + 10, "spans": list(spans)}


def block(seq, box, *lines, kind=0, page=1, doc=1):
    return (doc, page, seq, 600.0, 800.0, kind, *map(float, box), list(lines) or None)


def texts(spark, *blocks):
    raw = spark.createDataFrame(list(blocks), layout.RAW)
    return [(r.text, r.font, r.bold, r.page_no, r.kind) for r in layout.page_blocks(raw).orderBy("doc_id", "pos").collect()]


def one(seq, box, text, **k):
    return block(seq, box, line(span(text)), **k)


def test_empty(spark):
    assert texts(spark) == []


def test_bands_and_short(spark):
    got = texts(spark, one(0, (50, 20, 200, 45), "Header of it"), one(1, (50, 100, 200, 150), "Valid Block Content"), one(2, (50, 760, 200, 790), "Footer of it"), one(3, (50, 300, 200, 320), "10"))
    assert [g[0] for g in got] == ["Valid Block Content"]


def test_image(spark):
    assert texts(spark, block(0, (100, 10, 300, 400), kind=1)) == [(None, None, False, 1, "image")]


def test_gap(spark):
    got = texts(spark, block(0, (50, 100, 500, 120), line(span("LeftColumn", 50, 100), span("RightColumn", 300, 400))))
    assert got[0][0] == "LeftColumn RightColumn"


def test_font_and_weight_split(spark):
    got = texts(spark, block(0, (50, 100, 300, 160), line(span("Title text", size=14.0)), line(span("Body text", size=10.0)), line(span("Bold text", size=10.0, flags=16)), line(span("Also bold", font="X-Bold"))))
    assert [(g[0], g[1], g[2]) for g in got] == [("Title text", 14.0, False), ("Body text", 10.0, False), ("Bold text Also bold", 10.0, True)]


def test_anchor_of_run(spark):
    got = texts(spark, block(0, (50, 100, 300, 160), *[line(span(f"line {f}", size=f)) for f in (10.0, 10.8, 11.6, 11.7)]))
    assert [g[0] for g in got] == ["line 10.0 line 10.8", "line 11.6 line 11.7"]


def test_two_columns_and_title(spark):
    left, right = (50, 250), (320, 550)
    rows = [one(0, (50, 60, 560, 90), "Wide title")] + [one(i + 1, (x[0], y, x[1], y + 20), t) for i, (x, y, t) in enumerate([(left, 100, "Left A"), (right, 100, "Right A"), (left, 200, "Left B"), (right, 200, "Right B")])]
    assert [g[0] for g in texts(spark, *rows)] == ["Wide title", "Left A", "Left B", "Right A", "Right B"]


def test_slack_absorbs_a_near_column(spark):
    rows = [one(0, (50, 100, 250, 120), "First one"), one(1, (255, 90, 400, 110), "Second one")]
    assert [g[0] for g in texts(spark, *rows)] == ["Second one", "First one"]


def test_pages(spark):
    got = texts(spark, one(0, (50, 100, 200, 120), "Page one"), one(0, (50, 100, 200, 120), "Page two", page=2))
    assert [(g[0], g[3]) for g in got] == [("Page one", 1), ("Page two", 2)]


def test_ocr(spark):
    schema = "doc_id long, page_no int, block int, par int, line int, left int, top int, width int, height int, conf string, text string"
    rows = [(1, 1, 1, 1, 1, 200, 100, 50, 20, "90", "world"), (1, 1, 1, 1, 1, 100, 101, 80, 20, "95", "hello"), (1, 1, 1, 1, 2, 100, 200, 50, 20, "-1", "noise"), (1, 1, 1, 1, 3, 100, 300, 50, 0, "80", "flat"), (1, 1, 1, 1, 4, 1, 1, 1, 1, "x", "bad"), (1, 1, 1, 1, 5, 1, 1, 1, 1, "50", "q")]
    got = {r.line: r for r in ocr.ocr_lines(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 3}
    assert got[1].text == "hello world" and got[1].font == 7.2 and got[1].left == 36.0
    assert got[3].font is None
