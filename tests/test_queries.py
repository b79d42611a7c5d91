"""Every query with SQL gives the SQL's rows on the smallest test tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
catalogue = pytest.importorskip("papyrine.plans.catalogue")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canonical(table):
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else repr(v)
    names = sorted(table.column_names)
    return names, sorted(zip(*([show(v) for v in table[n].to_pylist()] for n in names)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    if name in catalogue.ORACLES:
        assert canonical(got) == canonical(db.sql(catalogue.ORACLES[name]).to_arrow_table())


def against_sql(spark, folder, name, **tables):
    """The query over some made tables, held against its SQL."""
    with duckdb.connect() as c:
        for table, (rows, schema) in tables.items():
            path = f"{folder}/{table}.parquet"
            spark.createDataFrame(rows, schema).write.parquet(path)
            c.sql(f"create view {table} as select * from '{path}/*.parquet'")
        assert canonical(catalogue.QUERIES[name](spark, str(folder)).toArrow()) == canonical(c.sql(catalogue.ORACLES[name]).to_arrow_table())


def test_cascade_of_dois_that_hold_a_year(spark, tmp_path):
    """10.2021/j.1021 and 10.3021/j.2021: the year is that of the text beside them."""
    rows = [(i, f"One title of a page {i}\nNames and words that follow it.") for i in [*range(910, 1040, 3), *range(1018, 1030), *range(1998, 2030)]]
    against_sql(spark, tmp_path, "q_cascade", documents=(sorted(set(rows)), "doc_id long, text string"))


def test_markup_of_names_without_a_semicolon(spark, tmp_path):
    pages = [(1, "<p>der&amp;&amp;&amp<style>{margin:0}</style></p>"), (2, "a &lt;b&gt; &amp c &copy d &middot; &quot;e&quot; AT&T"), (3, None), (4, "<p> </p>")]
    against_sql(spark, tmp_path, "q_markup", pages=(pages, "page_id long, html string"))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
