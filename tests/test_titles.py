"""Page titles with odd spacing against the query's SQL."""

import duckdb

import __spark_entry__ as entry

TITLES = [
    "A  tablet ( b ) [ c ]", "one \n•two\r\n\r\n\r\n three", "10mgtablets and xcream , y", "\u00a0 a\u00a0b \u3000", "\t a \t; b !", "end \n", "\n begin", "", " ", "a â€¢ b :)",
]


def test_titles_agree_with_the_sql_on_odd_spacing(spark, tmp_path):
    rows = [(i, "u", f"<title>{t}</title><p>x</p>") for i, t in enumerate(TITLES)] + [(90, "u", None), (91, "u", "<title>"), (92, "u", "<p></p>"), (93, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["narrative_normalize"]).fetchall())
    assert sorted(map(tuple, entry.queries()["narrative_normalize"](spark, str(tmp_path)).collect())) == want
