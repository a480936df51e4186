"""Queries on tables with odd rows, against their SQL: cut-off references, accents at bounds, equal prices."""

import duckdb
import pytest
from extractspark import queries
from extractspark.sources import html

KNOWN, SQL = queries.queries(), queries.oracle_sql()
HEADS = ["A heading without anything odd", "Cut &amp;&amp; off&amp", "Cut &copy off &am", "Twice &amp;amp; and &amp;copy; and &amp;copy", "&copy; closed &middot; and &quot;quoted&quot; &notit;"]
BODY = '<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li><li><a href="/c">three</a></li></ul></nav><article><p>a #È and #tag, xé@mail.example.com &amp #cut&amp; a.b@mail.exampleDoción é5%</p></article>'


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    page = "<!DOCTYPE html><html><head><title>{0}</title></head><body>" + BODY + "<h1>{0}</h1></body></html>"
    pages = [(i, f"https://www.example.com/p/{i}", page.replace("{0}", h)) for i, h in enumerate(HEADS)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    parts = [(i, f"name {i}", "Brand#1", "T", 1 + i % 3, 100.0 + (i // 3 % 4 if i % 3 == 0 else i)) for i in range(60)]  # equal prices on the first page only
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", [
    "h1_by_alias", "h1_fuzzy", "items_exact", "page_title", "smart_extract", "title_of_bytes", "adaptive_best", "h1_exact", "h1_similar", "model_roundtrip",
])
def test_odd_rows(spark, odd, name):
    con = duckdb.connect()
    for t in ("pages", "part"):
        con.execute(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
    got = KNOWN[name](spark, odd)
    found = con.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    assert found and sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, found))


def test_references_that_end_in_a_semicolon():
    page = "<p title='&amp;copy; &copy &#65; &#66'>&amp;lt; &lt &#x43; &#x44 &no-such;<script>a && b &amp</script><!-- &amp --></p>"
    p = html.parse(page, html.CLOSED).elements[0]
    assert p.attrs == {"title": "&copy; &copy A &#66"} and p.text() == "&lt; &lt C &#x44 &no-such;"
    assert [(c.kind, str(c)) for c in (p.elements[0].children[0], p.children[-1])] == [("script", "a && b &amp"), ("comment", " &amp ")]
    assert html.parse("<p> &amp &am</p>", html.CLOSED).text() == " &amp &am"
    assert html.parse("<p>R&amp D&#66</p>").text() == "R& DB"
