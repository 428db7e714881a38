"""Titles with references other than the one that their SQL undoes."""

from weftlake.operators import html
from weftlake.plans import queries

PAGE = '<html lang="en"><head><title> a &quot;b&quot; &amp; &lt;c&#39;d &amp;quot; &am</title></head><body><h1>a &quot;b&quot; &#39;</h1><p title="&quot;"><svg><title>&gt;</title></svg>&gt;</p></body></html>'


def test_titles_are_read_with_the_references_named():
    title = lambda **kw: html.first(html.parse(PAGE, **kw), "title").text()
    assert title() == title(strict=True) == "a \"b\" & <c'd &quot; &am"
    assert title(strict=True, titles=("amp",)) == "a &quot;b&quot; & &lt;c&#39;d &quot; &am"
    assert title(strict=True, titles=("amp", "quot")) == 'a "b" & &lt;c&#39;d &quot; &am'
    assert title(strict=True, titles=()) == "a &quot;b&quot; &amp; &lt;c&#39;d &amp;quot; &am"
    root = html.parse(PAGE, strict=True, titles=("amp",))
    assert html.first(root, "h1").text() == "a \"b\" '" and html.first(root, "p").attrs["title"] == '"' and html.first(root, "p").text() == "&gt;>"


def test_queries_read_titles_as_their_sql_does(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.example.com/", PAGE)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    get = lambda name: queries.QUERIES[name](spark, str(tmp_path)).first()
    names = ("page_title_lang", "page_records", "cascade_second_run", "cascade_tiers")
    assert {get(n)["title"] for n in names} == {"a &quot;b&quot; & &lt;c&#39;d &quot; &am"}
    assert get("headings")["text"] == get("page_records")["heading"] == "a \"b\" '"
