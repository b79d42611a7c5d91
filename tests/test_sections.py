from papyrine.operators import sections


def blocks(spark, rows, doc=1):
    made = [(doc, i + 1, t, f, b, k) for i, (t, f, b, k) in enumerate((*r, "text")[:4] if len(r) == 3 else r for r in rows)]
    return spark.createDataFrame(made, "doc_id int, pos int, text string, font double, bold boolean, kind string")


def tree(spark, rows):
    return [(r.heading, r.level, r.parent_rn, r.number, r.content) for r in sections.section_table(blocks(spark, rows)).orderBy("rn").collect()]


BODY = ("Some body text that goes on.", 10.0, False)


def test_base_font(spark):
    f = lambda rows: sections.base_font(blocks(spark, rows)).head()
    assert f([("a", 10.5, False), ("b", 10.5, False), ("c", 12.0, False)]).base_font == 10.5
    assert f([("a", 12.0, False), ("b", 9.0, False), ("c", 9.0, False), ("d", 12.0, False)]).base_font == 12.0
    assert f([("a", None, False)]).base_font == 12.0
    assert f([("a", 11.0, False, "text"), (None, 30.0, False, "image"), (None, 30.0, False, "image")]).base_font == 11.0


def test_heading_rules(spark):
    rows = [("Big title", 20.0, False), ("Second big", 20.0, True), ("Introduction", 10.0, False), ("2.1 Results of it", 10.0, False), ("Figure 1 shows", 10.0, True), ("12.5 mM", 10.0, True), ("1. lower case", 10.0, False), ("Bold heading here", 10.0, True), ("Abc", 10.0, True), ("References", 10.0, False), ("3. Not any more", 10.0, False), ("Appendix to it", 10.0, True), BODY, BODY]
    got = {r.text: (r.is_heading, r.level0, r.number) for r in sections.headings(blocks(spark, rows)).collect()}
    assert got["Big title"] == (True, 1, None)
    assert not got["Second big"][0]
    assert got["Introduction"][:2] == (True, 2)
    assert got["2.1 Results of it"] == (True, 3, "2.1")
    for t in ("Figure 1 shows", "12.5 mM", "1. lower case", "Abc", "3. Not any more"):
        assert not got[t][0], t
    assert got["Bold heading here"][0] and got["Appendix to it"][0]


def test_tree(spark):
    got = tree(spark, [("lost text before", 10.0, False), ("1. Introduction", 10.0, True), BODY, ("1.1. Details of", 10.0, True), BODY, BODY, ("2. Methods of", 10.0, True)])
    assert [g[:2] for g in got] == [("1. Introduction", 2), ("1.1. Details of", 3), ("2. Methods of", 2)]
    assert got[0][2] is None and got[1][2] is not None and got[2][2] is None
    assert got[1][4] == BODY[0] + "\n\n" + BODY[0] and got[2][4] == ""


def test_level_follows_font(spark):
    got = tree(spark, [("Introduction", 14.0, True), ("Smaller bold one", 12.0, True), ("Smallest bold one", 10.0, True), ("Same bold one", 10.2, True), ("Larger bold one", 12.0, True), BODY, BODY, BODY, BODY, BODY])
    assert [g[1] for g in got] == [2, 3, 4, 4, 3]


def test_glued_and_skipped(spark):
    got = tree(spark, [("Abstract\n\nText of the abstract.", 10.0, True), ("Keywords: a, b", 10.0, True), BODY])
    assert got[0][0] == "Abstract" and got[0][4] == "Text of the abstract.\n\n" + BODY[0]


def table(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id int, rn int, parent_rn int, level int, number string, heading string, content string")


def pruned(spark, rows):
    left, thanks = sections.acknowledgments(table(spark, rows))
    return sorted(r.rn for r in left.collect()), thanks.head().acknowledgments


def test_acknowledgments(spark):
    a = (1, None, 2, None, "Results", "x")
    assert pruned(spark, [a, (2, None, 2, None, "Funding", " money ")]) == ([1], "money")
    assert pruned(spark, [a, (2, 1, 3, None, "Acknowledgements", "thanks"), (3, 2, 4, None, "Deeper", "y"), (4, None, 2, None, "End", "")]) == ([1, 4], "thanks")
    assert pruned(spark, [a]) == ([1], None)


def test_empty_acknowledgments(spark):
    """An empty nested one is dropped, its siblings are passed over, the search goes on behind the parent."""
    rows = [(1, None, 2, None, "A", "x"), (2, 1, 3, None, "Funding", ""), (3, 1, 3, None, "Funding", "not seen"), (4, None, 2, None, "Funding", "seen"), (5, None, 2, None, "Funding", "later")]
    assert pruned(spark, rows) == ([1, 3, 5], "seen")
    assert pruned(spark, [(1, None, 2, None, "Funding", ""), (2, None, 2, None, "Funding", "later")]) == ([2], None)


def test_nested_json(spark):
    import json

    rows = [(1, None, 2, "1", "A", "x"), (2, 1, 3, None, "B", "y"), (3, None, 2, None, "C", "")]
    got = json.loads(sections.nested_json(table(spark, rows)).head().sections)
    assert [s["heading"] for s in got] == ["A", "C"] and got[0]["subsections"][0]["heading"] == "B"
