import pytest
from pyspark.sql import functions as F

from papyrine.functions import text as T


def values(spark, inputs, expr):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", expr("x").alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_clean_text(spark):
    got = values(spark, ["a b", "hyphen-\nated", "one\ntwo", "para\n\npara", "  x \t y ", "", None], T.clean_text)
    assert got == ["a b", "hyphenated", "one two", "para\n\npara", "x y", "", None]


@pytest.mark.parametrize(
    "text, doi",
    [
        ("https://doi.org/10.1000/own and 10.2000/cited 10.2000/cited", "10.1000/own"),
        ("10.1000/a, 10.2000/b, 10.2000/b", "10.2000/b"),
        ("10.1039/b000000x then 10.1039/c5dt01234a.", "10.1039/c5dt01234a"),
        ("DOI: 10.1000/ABC.", "10.1000/abc"),
        ("10.1000/a 10.3000/b", "10.1000/a"),
        ("doi:        10.1000/far 10.2000/x 10.2000/x", "10.2000/x"),
        ("nothing", None),
    ],
)
def test_find_doi(spark, text, doi):
    assert values(spark, [text], T.find_doi) == [doi]


def test_guess_year(spark):
    got = values(spark, ["Received 2023; accepted 2024", "see 1999 and 2010", "3099 and 1500", "Received 2001 " + "x" * 60 + " 2015", "©2020", None], lambda c: T.guess_year(c, 2024))
    assert got == [2024, 2010, None, 2001, 2020, None]


def test_normalize_author(spark):
    got = values(spark, ["Serhad Tilki1,2", "Madonna", "Yao, Yunjin", "Yunjin Yao a,*", "Ann Mary Lee†", ""], T.normalize_author)
    assert got == ["Tilki, Serhad", "Madonna", "Yao, Yunjin", "Yao, Yunjin", "Lee, Ann Mary", ""]


def test_byline(spark):
    got = values(spark, ["Yunjin Yao a,* , Yating Liu a , Zhenshan Ma b", "A B and a B and Ann Lee; Ann Lee", None], T.parse_byline)
    assert got[0] == ["Yao, Yunjin", "Liu, Yating", "Ma, Zhenshan"]
    assert got[1] == ["Lee, Ann"]
    assert got[2] == []


def test_person(spark):
    got = values(spark, ["Lee, Ann", "van der Berg, Jan", "the end", "see www.x.org", "A B C D E F", "de la"], T.is_person)
    assert got == [True, True, False, False, False, False]


def test_markup(spark):
    got = values(spark, ["ir(<scp>iii</scp>) dye", "Growth &amp; Design", None, "", "<p> </p>", "&amp;lt;"], T.clean_markup)
    assert got == ["ir(iii) dye", "Growth & Design", None, "", None, "&lt;"]
    got = values(spark, ["a &eacute; b &#233; c &#xE9; d &alpha;&le;&beta; &amp;eacute;", "AT&T &notanentity; &", "x &hellip; &amp; y"], T.clean_markup)
    assert got == ["a é b é c é d α≤β &eacute;", "AT&T \u00acanentity; &", "x … & y"]


def test_markup_with_ended_entities(spark):
    given = ["a&amp;&amp<b>{x}", "&amp &copy &eacute; &lt;", "&notanentity; &#233; &#xE9; &#233 &amp;lt;", None, ""]
    got = values(spark, given, lambda x: T.clean_markup(x, ended=True))
    assert got == ["a&&amp{x}", "&amp &copy é <", "&notanentity; é é &#233 &lt;", None, ""]


def test_latex(spark):
    inputs = [r"E=mc^2 \quad \tag{1}", r"a ~~(5)", r"b\,(12)", "plain"]
    assert values(spark, inputs, T.clean_latex) == [r"E=mc^2 \tag{1}", "a (5)", "b (12)", "plain"]
    assert values(spark, ["x (5)", r"y \tag{12}", "z"], T.latex_id) == ["(5)", "(12)", None]


def test_captions(spark):
    inputs = ["Figure 1. A", "Fig. S2a shows", "Scheme 3", "Table 4", "Рис. 1", "Таблица 2", "схема 7", "see Figure 1"]
    assert values(spark, inputs, T.caption_id) == ["Figure 1", "Figure S2A", "Scheme 3", "Table 4", "Figure 1", "Table 2", "Scheme 7", None]


def test_repair_table(spark):
    inputs = ['```json\n{"data": [["a", 1], ["b", 2]]}\n```', '{"data": ["x", 7]}', '{"data": 5}', "{}", "no", '{"data": []}', '{"data": [["a"], "b"]}']
    assert values(spark, inputs, T.repair_table) == [[["a", "1"], ["b", "2"]], [["x"], ["7"]], [["5"]], [], [], [], [["a"], ["b"]]]


def test_normalize(spark):
    inputs = ["Élan  Vital!", "ﬁne ²", "Привет", None, "A-B"]
    assert values(spark, inputs, T.normalize) == ["elan vital", "fine 2", "", "", "a b"]
    assert values(spark, ["Élan  Vital!", "naïve Ø"], lambda c: T.normalize(c, native=True)) == ["elan vital", "naive"]
    assert values(spark, ["Tilki, Serhad", "Ann Lee", ""], T.surname) == ["tilki", "ann", ""]


def test_matches(spark):
    rows = spark.createDataFrame([("a b", "a b c", True, False), ("", "x", False, False), ("same", "same", True, True)], "p string, g string, fuzzy boolean, exact boolean")
    for r in rows.select("*", T.scalar_match(F.col("p"), F.col("g"), True).alias("f"), T.scalar_match(F.col("p"), F.col("g"), False).alias("e")).collect():
        assert (r.f, r.e) == (r.fuzzy, r.exact)
    rows = spark.createDataFrame([("the quick brown fox", "the quick brown fix", True), ("abc", "xyz", False), ("", "", False)], "p string, g string, y boolean")
    assert all(r.m == r.y for r in rows.select("*", T.ratio_match(F.col("p"), F.col("g")).alias("m")).collect())


def test_ratio_of_long_texts(spark):
    """Texts of over 200 characters, where frequent characters no longer start a match."""
    import random
    from difflib import SequenceMatcher

    r, pairs = random.Random(4), []
    for k in range(60):
        words = ["".join(r.choice("etaoin") if k % 3 == 0 else chr(0x4E00 + r.randint(0, 4000)) for _ in range(r.randint(4, 7))) for _ in range(r.randint(45, 90))]
        other = [w if r.random() > 0.02 * r.randint(0, 9) else w[::-1] for w in words]
        pairs.append((" ".join(words), " ".join(other)))
    wanted = [SequenceMatcher(None, p, g).ratio() >= 0.85 for p, g in pairs]
    assert 5 < sum(wanted) < 55 and all(len(p) > 200 for p, _ in pairs)
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i int, p string, g string").select("i", T.ratio_match(F.col("p"), F.col("g")).alias("m"))
    assert [r.m for r in rows.orderBy("i").collect()] == [p == g or w for (p, g), w in zip(pairs, wanted)]
