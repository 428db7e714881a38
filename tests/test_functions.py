"""Expressions against values worked out from their rules, and against the standard library."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from weftlake.functions import blocks, dates, detect, numbers, schema, scope, structured, text, urls


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", make(F.col("v")).alias("x")).orderBy("k").select("x").collect()]


CANONICAL = {
    "HTTP://User@WWW.Example.COM.:80/a/../B%2fc/index.HTML?utm_source=x&b=2&a=1#top": "http://User@www.example.com/a/../B/c/",
    "https://e.org": "https://e.org/",
    "https://e.org:8443/x?q=a+b&empty=": "https://e.org:8443/x?empty=&q=a+b",
    "https://e.org/a\\b c": "https://e.org/a/b%20c",
    "https://e.org/?trkCampaign=1&hsCtaTracking=2&GCLID=3": "https://e.org/?hsCtaTracking=2&trkCampaign=1",
    "https://e.org/%7Euser/é": "https://e.org/~user/%C3%A9",
    "https://e.org/Default.aspx": "https://e.org/",
    "  ": "",
}


def test_canonical(spark):
    got = values(spark, list(CANONICAL), urls.canonical)
    assert got[0] == "http://User@www.example.com/a/../B/c/?a=1&b=2"
    assert got[1:] == list(CANONICAL.values())[1:]
    assert values(spark, got, urls.canonical) == got


def test_hosts(spark):
    rows = ["https://www.A.com:80/x.tar.GZ?y", "http://u:p@b.org/", "http://[::1]:8/x/", "c.net/x"]
    assert values(spark, rows, urls.host) == ["www.a.com", "b.org", "::1", ""]
    assert values(spark, rows, urls.registrable_host)[0] == "a.com"
    assert values(spark, rows, urls.extension) == ["gz", "", "", ""]
    private = {"10.1.2.3": True, "172.16.0.1": True, "172.32.0.1": False, "8.8.8.8": False, "localhost": True, "a.localhost": True, "metadata.goog": True, "::1": True, "fe80::1": True, "2606:4700::1": False, "example.com": False, "169.254.169.254": True, "": True}
    assert values(spark, list(private), urls.is_private) == list(private.values())


@pytest.mark.parametrize("base", ["http://e.org/a/b/c.html?q=1", "https://e.org", "http://e.org/x/"])
def test_resolve(spark, base):
    hrefs = ["d.html", "/d", "../d", "../../../d", "./d/./e", "?z=2", "//o.net/p", "mailto:x@y.z", "d/../e/..", "x?y=/../z", "http://q.org/../r"]
    got = values(spark, hrefs, lambda h: urls.resolve(F.lit(base), h))
    for h, g in zip(hrefs[:-1], got):
        assert g == urljoin(base, h), h


def test_detection(spark):
    raws = {b"%PDF-1.7": "pdf", b"\x89PNG\r\n\x1a\n..": "png", b"....ftypheic": "heic", b"....ftypzzzz": "mp4", b"RIFF....WEBP": "webp", b"PK\x03\x04": "zip", b"x" * 257 + b"ustar": "tar", b"GIF89a": "gif"}
    assert values(spark, [bytearray(x) for x in raws], lambda c: detect.by_magic(c)["subtype"], "binary") == list(raws.values())
    texts = {"  <!DOCTYPE html><p>": "html", "<?xml version='1.0'?><rss>": "rss", "<urlset>": "sitemap", '{"a": 1}': "json", '{"a": 1}\n{"b": 2}\n': "json", "From: a@b.c\n": "eml", "a,b\n1,2\n": "csv", "a\tb\n1\t2": "tsv", "#EXTM3U\n#EXT-X-ENDLIST": "hls", "plain words": "text", "": "unknown"}
    assert values(spark, list(texts), lambda c: detect.detect(text=c)["subtype"]) == list(texts.values())
    both = lambda t, declared: values(spark, [t], lambda c: detect.detect(text=c, content_type=F.lit(declared))["subtype"])[0]
    assert both("<rss></rss>", "application/xml") == "rss" and both('{"a":1}', "text/html") == "json" and both("a,b\n1,2", "application/pdf; x") == "pdf"
    assert values(spark, ["https://e.org/a.PDF?x", "https://e.org/b"], lambda c: detect.detect(url=c)["by"]) == ["url", "default"]
    assert values(spark, ["https://m.youtube.com/w", "https://evil-youtube.com/", "http://e.org/l.M3U8"], detect.pre_route) == ["ytdlp", "http", "livestream"]


def test_blocks(spark):
    ask = lambda status, body: values(spark, [body], lambda c: blocks.detect_block(F.lit(status), c)["name"])[0]
    assert ask(200, "<title>Just a moment...</title>") == "cloudflare interstitial"
    assert ask(200, "about captcha: g-recaptcha") is None and ask(403, "g-recaptcha") == "recaptcha challenge"
    assert values(spark, ["<div id=\"root\"></div>", "<p>" + "word " * 60, "<script>" + "x" * 3000 + "</script>"], blocks.is_empty_shell) == [True, False, True]


def test_scope(spark):
    s = scope.Scope(hosts=("e.org",), max_depth=2, collect=("pdf",), exclude=("/private/",))
    cases = {
        "mailto:x": "not an http(s) URL", "http://o.net/": "off-site (o.net)", "http://e.org/a.css": "page furniture (.css)", "http://e.org/private/x": "matched an exclude pattern",
        "http://e.org/2024/05/": "crawl trap: calendar-style URL", "http://e.org/a/b/a/b/a/b": "crawl trap: repeated path segments", "http://e.org/x?SID=1": "crawl trap: session or view parameter (SID)",
        "http://e.org/" + "a/" * 13: "crawl trap: path is implausibly deep", "http://e.org/f.pdf": "target file (.pdf)", "http://e.org/f.zip": "not a target and not a page (.zip)", "http://www.e.org/p": "page",
    }
    assert values(spark, list(cases), lambda c: scope.classify(c, F.lit(0), s)["reason"]) == list(cases.values())
    assert values(spark, ["http://e.org/p", "http://e.org/f.pdf"], lambda c: scope.classify(c, F.lit(2), s)["verdict"]) == ["skip", "collect"]


def test_numbers(spark):
    cases = {"1,234": "1234", "1,23": "1.23", "1.234,56": "1234.56", "1,234.56": "1234.56", "1.234": "1.234", "1.234.567": "1234567", "12 34": "1234", "abc": None, "-5": "-5", "$1.50": "1.50", "2.5k": "2500", "3 lakh": "300000", "1'000": "1000"}
    assert values(spark, list(cases), numbers.amount) == list(cases.values())
    money = {"C$ 5": "CAD", "$5": "USD", "5 kr": "SEK", "NPR 10": "NPR", "THE 5 EUR": None, "5": None}
    assert values(spark, list(money), numbers.currency) == [v if k != "THE 5 EUR" else None for k, v in money.items()]
    assert values(spark, ["-3.9", "2,5"], numbers.parse_int) == [-3, 2]


def test_dates(spark):
    now = F.lit("2026-03-31 12:00:00").cast("timestamp")
    cases = {
        "2026-03-03": "2026-03-03", "2026-03-03T10:00:00Z": "2026-03-03", "2026-03-03T23:30:00-05:00": "2026-03-04", "3 March 2026": "2026-03-03", "Mar 3, 2026": "2026-03-03", "20260303": "2026-03-03",
        "Tue, 03 Mar 2026 10:00:00 +0000": "2026-03-03", "03-04-2026": "2026-03-04", "31.12.2025": "2025-12-31", "2 days ago": "2026-03-29", "1 week ago": "2026-03-24", "March 2026": "2026-03-01", "soon": None, "": None, "2026-02-30": None,
    }
    assert values(spark, list(cases), lambda c: dates.date_field(c, now)["date"]) == list(cases.values())
    assert values(spark, ["03-04-2026", "13-04-2026", "03/03/2026"], dates.is_ambiguous) == [True, False, False]
    assert values(spark, ["03-04-2026"], lambda c: dates.date_field(c, now, dayfirst=True)["iso"]) == ["2026-04-03T00:00:00+00:00"]


def test_text(spark):
    assert values(spark, ["ﬁ  x​y\n\n\n\nz "], text.clean_text) == ["fi xy\n\nz"]
    assert values(spark, ["a b c d", "a b", "", "É_1 x"], lambda c: text.shingles(text.words(c))) == [["a b c", "b c d"], ["a b"], [], ["é_1 x"]]
    assert values(spark, ["One. " + "two " * 100, "short"], lambda c: text.preview(c, 40, nfkc=False)) == ["One. two two two two two two two two…", "short"]
    assert values(spark, [0x0001_0002_0003_0004], text.bands, "long") == [[4, 65536 + 3, 131072 + 2, 196608 + 1]]


def test_schema_and_structured(spark):
    assert schema.compile_hint({"a": "string", "tags": "list of strings", "n": "integer", "p": "number", "ok": "boolean"}).simpleString() == "struct<a:string,tags:array<string>,n:bigint,p:string,ok:boolean>"
    page = """<meta property="og:title" content="A &amp; B"><meta content="late" name="og:title"><script type="application/ld+json">{"@graph":[{"@type":"Thing","name":"t"},{"@type":"Product","name":"Pan","offers":{"price":"9.50"},"keywords":"x, y",},]}</script>"""
    df = spark.createDataFrame([(1, page)], "id int, html string").select("id", structured.harvest(F.col("html")).alias("h")).persist()
    assert df.first().h.meta == {"og:title": "A & B"}
    flat = df.select(structured.flat_values(F.col("h")).alias("f")).persist()
    got = flat.select(structured.find_value("title", "string", F.col("f")).alias("title"), structured.find_value("price", "number", F.col("f")).alias("price"), structured.find_value("tags", "list", F.col("f")).alias("tags"), structured.find_value("venue", "string", F.col("f")).alias("venue")).first()
    assert (got.title, got.price, got.tags, got.venue) == ("Pan", "9.50", ["x", "y"], None)


def flat_of(page, parsed=None):
    e = structured.embedded(page, "https://x.example/p/")
    return structured.flat_map(e["jsonld"], e["items"], [e["next_data"], e["state"]], e["meta"], parsed)


def test_each_source_answers_alone():
    assert flat_of('<script type="application/ld+json"><!-- {"@type":"Book","name":"B","n":[1,2,],} --></script>') == {"@type": "Book", "name": "B", "n": "[1, 2]"}
    micro = '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">M</b><p itemprop="offers" itemscope><i itemprop="price">7</i></p></div>'
    assert flat_of(micro)["offers.price"] == "7" and flat_of(micro)["name"] == "M" and flat_of(micro)["@type"] == "Product"
    assert flat_of('<div vocab="https://schema.org/" typeof="Article"><h1 property="headline">R</h1></div>')["headline"] == "R"
    assert flat_of('<script id="__NEXT_DATA__">{"props":{"pageProps":{"a":{"name":"N","deep":{"er":{"still":{"more":1}}}}}}}</script>') == {"a": "N", "name": "N", "a.name": "N", "a.deep.er.still.more": "1", "more": "1"}
    assert flat_of("<script>var x=1; window.__NUXT__ = {\"t\": \"}; </b>\"};\nmore()</script>") == {"t": "}; </b>"}
    assert flat_of('<META NAME="OG:site_name" CONTENT="A &eacute; &amp; &#66;">') == {"og:site_name": "A é & B", "site_name": "A é & B"}
    rows = '{"items":[{"t":"a","p":1},{"t":"b","q":""}],"table":{"headers":["c"],"records":[{"c":2},{"c":3}]},"tables":[{"headers":["k","v"],"rows":[["Colour","Blue"]]},{"headers":["x","y","z"],"rows":[["1","2","3"],["4","","6"]]}],"data":[{"d":{"e":true}}]}'
    assert flat_of("", rows) == {"t": "a", "t__column": '["a", "b"]', "p": "1", "p__column": "[1]", "c": "2", "c__column": "[2, 3]", "Colour": "Blue", "x": "1", "x__column": '["1", "4"]', "y": "2", "y__column": '["2"]', "z": "3", "z__column": '["3", "6"]', "d.e": "true", "e": "true"}


def test_sources_by_trust_and_what_is_not_read():
    page = '<meta property="og:title" content="meta"><script>window.__APOLLO_STATE__={"title":"state","og:title":"odd"}</script><div itemscope><b itemprop="title">item</b></div><script type="application/ld+json">{"title":"linked"}</script>'
    assert flat_of(page) == {"title": "linked", "og:title": "odd"}
    assert flat_of(page.replace("linked", "").replace('"title":""', '"x":1'))["title"] == "item"
    nested = '<script type="application/ld+json">{"a":{"price":5},"price":9,"list":[{"b":1},{"b":2},{"c":3},{"d":4},{"e":5},{"f":6}],"@context":"no"}</script>'
    assert flat_of(nested)["price"] == "5" and flat_of(nested)["list.f"] == "6" and "@context" not in flat_of(nested)
    big = structured.embedded('<script type="application/ld+json">{"a":"' + "x" * 100 + '"}</script><script type="application/ld+json">{</script>', most=50)
    assert (big["jsonld"], big["oversized"]) == ([], 1)
    assert structured.embedded(None)["meta"] == {} and flat_of('<script type="application/ld+json">' + "[" * 5000 + "</script>") == {}


def test_addresses_inside_others_and_deep_dots(spark):
    inside = ["::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:7f00:1", "::FFFF:808:808", "0:0:0:0:0:ffff:192.168.1.1", "::1", "2001:4860::1", "10.0.0.1", "", None, "localhost"]
    assert values(spark, inside, urls.is_private) == [True, False, True, False, True, True, False, True, True, True, True]
    deep = "/".join(["x"] * 40) + "/" + "../" * 38 + "y"
    assert values(spark, [deep, "../../../z", "a/./b/..", "/..", "a/.", "/p/../q?x=/../y"], lambda c: urls.resolve(F.lit("https://h.example/d/e"), c)) == ["https://h.example/d/x/x/y", "https://h.example/z", "https://h.example/d/a/", "https://h.example/", "https://h.example/d/a/", "https://h.example/q?x=/../y"]
