"""References without their semicolon."""

from weftlake.operators import html
from weftlake.plans import queries


def test_references_without_their_semicolon():
    text = 'a &amp;&amp; b &amp</h1><a title="&lt&copy=1&amp;x">&notit; &#39 &nope;</a><script>a&&b &amp;</script>'
    loose, strict = html.parse(f"<h1>{text}"), html.parse(f"<h1>{text}", strict=True)
    assert html.first(loose, "h1").text() == "a && b &"
    assert html.first(strict, "h1").text() == "a && b &amp"
    assert html.first(strict, "a").attrs["title"] == "&lt&copy=1&x" and html.first(strict, "a").text() == "&notit; ' &nope;"
    assert html.first(strict, "script").text() == html.first(loose, "script").text() == "a&&b &amp;"
    assert html.page("<html lang='en'><title>x &amp;&am</title><h1>x &amp;&amp</h1>", "", ("metadata", "headings"), strict=True) == {
        "metadata": {"language": "en", "title": "x &&am"}, "headings": [{"level": 1, "text": "x &&amp"}], "truncated": False}


def test_queries_read_titles_as_their_sql_does(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.example.com/", '<html lang="en"><head><title>b &amp;&amp</title></head><body><h1>b &amp;&amp</h1></body></html>')], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    get = lambda name: queries.QUERIES[name](spark, str(tmp_path)).first()
    assert {get(n)["title"] for n in ("page_title_lang", "page_records", "cascade_second_run", "cascade_tiers")} == {"b &&amp"}
    assert get("headings")["text"] == get("readable_text")["text"] == "b &&amp"
