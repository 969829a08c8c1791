import duckdb
import pytest

from breakwater.llm import line_dedup


def sql(tmp_path, df):
    df.select("doc_id", "source", "text").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/d/*.parquet')")
    return sorted(con.sql(line_dedup.SQL).fetchall(), key=str)


@pytest.mark.parametrize("broadcast", [100_000, -1])
def test_equal_to_sql(documents, messy, tmp_path, broadcast):
    for k, df in enumerate((documents, messy)):
        out = line_dedup.drop_boilerplate(df, broadcast_lines=broadcast)
        assert set(df.columns) <= set(out.columns)
        rows = sorted((tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)
        path = tmp_path / str(k)
        path.mkdir()
        assert rows == sql(path, df)


def test_boilerplate_goes_and_copies_stay(spark):
    pages = [(i, f"Welcome to the site\nArticle number {i} tells its own story, at some length.\n\nFooter\r", "a") for i in range(20)]
    pages += [(100 + i, "A copied page.\nIt has two lines.", "a") for i in range(40)]
    pages += [(300, "Welcome to the site\nAnother host.", "b")]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "doc_id long, text string, source string")).collect()}
    assert out[3].text == "Article number 3 tells its own story, at some length.\n" and out[3].n_dropped == 2
    assert out[100].n_dropped == 0 and out[300].n_dropped == 0


def test_a_footer_longer_than_the_page_goes(spark):
    footer = "This footer says at length who we are, what we do, and how to reach us on any day of the week."
    pages = [(i, f"Own line {i}.\n{footer}", "a") for i in range(50)]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(pages, "doc_id long, text string, source string")).collect()
    assert all(r.text == f"Own line {r.doc_id}." and r.n_dropped == 1 for r in out) and len(out) == 50


def test_no_rows(no_rows):
    assert line_dedup.drop_boilerplate(no_rows).collect() == []
