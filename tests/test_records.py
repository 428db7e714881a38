"""Payloads, policy, pages, folds and runs: the cases that tables of good values do not have."""

import pytest
from pyspark.sql import functions as F

from weftlake.functions import payload, policy
from weftlake.operators import crawl, dedupe, html, ordered, runs, tables
from weftlake.sources import handlers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytearray) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


CHATTY = [
    ("{\"a\": 1}", '{"a": 1}'),
    ("```json\n{\"a\": 1}\n```", '{"a": 1}'),
    ("```\n[1]\n``` ", "[1]"),
    ("Sure! {\"a\": \"}\\\"\"} done {", '{"a": "}\\""}'),
    ("list: [1, {\"b\": [2]}] x", '[1, {"b": [2]}]'),
    ("cut {\"a\": [1", '{"a": [1'),
    ("no json", "no json"),
    (None, None),
    ("", ""),
]


def test_json_from_text(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CHATTY)], "k int, t string")
    got = {r.k: r.v for r in df.select("k", payload.json_from_text(F.col("t")).alias("v")).collect()}
    assert got == {k: w for k, (_, w) in enumerate(CHATTY)}


def test_coerce_and_validate(spark):
    hint = {"name": "string", "size": "integer", "tags": "list of strings", "sold": "boolean"}
    said = ['{"result": {"NAME": "x", "size": "1,200 m", "tags": "a, ,b", "sold": "YES", "more": 1}}', '{"name": ["p", "q"], "size": "", "tags": [], "sold": "perhaps"}', '{"name": null}', "[]", "broken", None]
    df = payload.coerce(spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string"), "s", hint, "c").orderBy("k")
    got = [(r.c.name, r.c["size"], r.c.tags, r.c.sold, r.c.extras) for r in df.collect()]
    assert got[0] == ("x", 1200, ["a", "b"], True, {"more": "1"})
    assert got[1] == ("p, q", None, [], None, {}) and got[2] == (None, None, [], None, {})
    assert all(g[:2] == (None, None) for g in got[3:])
    problems = [r.v for r in spark.createDataFrame([(s,) for s in said], "s string").select(payload.validate(F.col("s"), hint).alias("v")).collect()]
    assert problems[0][0] == "name: required field is absent" and problems[3] == problems[4] == problems[5] == ["expected a JSON object"]


def test_unescape_and_fragments(spark):
    df = spark.createDataFrame([(" &lt;b&gt; &eacute;&#8212;&#x41; &amp;amp; ", "<p>a <b>b</b></p>&amp;c"), (None, None)], "e string, f string")
    rows = df.select(payload.unescape("e").alias("e"), payload.fragment_text("f").alias("f")).collect()
    assert (rows[0].e, rows[0].f) == ("<b> é—A &amp;", "a b &c") and (rows[1].e, rows[1].f) == (None, "")


def test_decoding_and_images(spark):
    raw = ["héllo wörld".encode(), "héllo wörld".encode("cp1252"), "héllo wörld".encode("utf-16-le"), "﻿héllo".encode(), b"", b"  ", None, ("é" * 200).encode() + b"\xff"]
    got = [r.v for r in spark.createDataFrame([(None if x is None else bytearray(x),) for x in raw], "x binary").select(policy.decode_bytes("x").alias("v")).collect()]
    assert got[:4] == ["héllo wörld", "héllo wörld", "héllo wörld", "héllo"] and got[4:7] == [None, None, None] and got[7].startswith("é" * 200)
    images = [b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x05\0\0\0\x07", b"\xff\xd8\xff\xe0\0\x04ab\xff\xc2\0\x11\x08\0\x02\0\x03", b"\xff\xd8\xff", b"BM" + b"\0" * 16 + (9).to_bytes(4, "little") + (-4).to_bytes(4, "little", signed=True), b"junk", None]
    rows = spark.createDataFrame([(None if x is None else bytearray(x),) for x in images], "x binary").select(policy.image_size("x").alias("v")).collect()
    assert [tuple(r.v) for r in rows] == [(5, 7, "PNG"), (3, 2, "JPEG"), (None, None, None), (9, 4, "BMP"), (None, None, None), (None, None, None)]


def test_policy_order(spark):
    cases = [("ftp://h/x", "SchemeNotAllowed"), (None, "SchemeNotAllowed"), ("http://localhost/", "HostNotAllowed"), ("https://www.bad.com/", "HostNotAllowed"), ("https://else.com/", "HostNotAllowed"), ("https://good.com/", None)]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(cases)], "k int, u string")
    got = [r.d.error_type for r in df.select("k", policy.check(F.col("u"), deny=("bad.com",), allow=("good.com", "bad.com")).alias("d")).orderBy("k").collect()]
    assert got == [e for _, e in cases]


def test_pages_with_errors_and_caps(spark):
    many = "".join(f'<a href="/{k}">x</a>' for k in range(1200))
    bad = '<link rel="canonical" href="http://[x"><a href="http://[y">z</a><a href="/ok">k</a>'
    df = spark.createDataFrame([(1, many, "http://a/"), (2, bad, "http://a/"), (3, None, None), (4, "", "http://a/"), (5, "<p>" * 20_000 + "deep", "http://a/")], "page_id long, html string, url string")
    rows = {r.page_id: r.page for r in html.with_page(df).collect()}
    assert len(rows[1].links) == 1200 and not rows[1].truncated
    assert [x.url for x in rows[2].links] == ["http://a/ok"] and "canonical" not in rows[2].metadata and rows[2].error is None
    assert rows[3].links == [] and rows[4].text_content == "" and rows[5].error is None
    capped = {r.page_id: r.page for r in html.with_page(df, parts=("links",), keep=("page_id",), most=html.RECORD_CAPS).collect()}
    assert len(capped[1].links) == 500 and capped[1].truncated and not capped[2].truncated


def test_equal_nodes_are_not_mixed_up():
    page = html.page("<body><nav>same</nav><div><p>keep</p><nav>same</nav><nav>same</nav></div><p>end</p></body>", "http://a/", parts=("text_content",))
    assert page["text_content"] == "keep\nend"


def test_rules_and_microdata():
    rules = html.parse_rules('{"out": {"a": "h1", "b": {"selector": "p", "multiple": 1, "regex": "(x+)"}, "c": ":first", "d": "[[", "e": null}}', ["a", "b", "c", "d", "e"])
    assert set(rules) == {"a", "b"} and rules["b"]["multiple"] is True
    alive, share = html.verified_rules("<h1></h1><p>axx</p><p>y</p>", rules)
    assert set(alive) == {"b"} and share == 0.5 and html.parse_rules("nonsense", ["a"]) == {} == html.parse_rules(None, ["a"])
    assert html.microdata(None) == [] == html.microdata("<p>plain</p>")
    (item,) = html.microdata('<div itemscope itemtype="https://schema.org/A"><a itemprop="url" href="/x">t</a><time itemprop="when" datetime="2024">now</time></div>', "http://h/")
    assert item == {"@type": "A", "properties": {"url": ["http://h/x"], "when": ["2024"]}}
    outline = html.skeleton('<body><script>x</script><div class="css-99aaff card"><p id="t">hello</p><img src="/i" alt="a"></div></body>')
    assert outline.splitlines() == ['p#t -> "hello"', 'img -> @src="/i" @alt="a"']


def test_folds_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (None, 3, 3.0), (5, 4, 1.0)], "h long, seq long, s double")
    got = [(r.host, r.allowed) for r in ordered.token_bucket(df, "h", "seq", F.col("s"), rate=0.0, burst=1.0).orderBy("seq").collect()]
    assert got == [(None, True), (None, False), (None, False), (5, True)]
    assert ordered.token_bucket(df.limit(0), "h", "seq", F.col("s"), rate=0.0, burst=1.0).count() == 0


def test_retry_after_that_cannot_be_read(spark):
    df = spark.createDataFrame([("soon",), ("-3",), ("1e9",), (None,)], "v string")
    got = [r.w for r in df.select(ordered.retry_after(F.col("v"), F.lit("2024-01-01").cast("timestamp")).alias("w")).collect()]
    assert got == [None, 0.0, 3600.0, None]


def test_near_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for x in list(prints):
        for bits in (1, 2, 3, 4):
            y = x
            for k in rng.sample(range(64), bits):
                y ^= 1 << k
            prints.append(y)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(k, x >> 32, x & 0xFFFFFFFF) for k, x in enumerate(prints)], "rep long, hi long, lo long")
    got = {(r.a, r.b, r.distance) for r in dedupe.near_pairs(df).collect()}
    want = {(i, j, d) for i, x in enumerate(prints) for j, y in enumerate(prints) if i < j and (d := (x ^ y).bit_count()) <= 3}
    assert got == want and len(want) > 150
    with pytest.raises(ValueError):
        dedupe.near_pairs(df, 4)


def test_merge_survives_a_run_that_ended_midway(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, n long")
    tables.merge_into(spark, path, rows((1, 1), (2, 1)), ["k"], ["n"])
    (tmp_path / "t").rename(tmp_path / "t.old")  # ended after the old table was moved aside
    tables.merge_into(spark, path, rows((2, 5), (3, 1)), ["k"], ["n"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1), (2, 5), (3, 1)] and not (tmp_path / "t.old").exists()


def test_runs(spark):
    items = spark.createDataFrame([("j", "a", True, "m", None, ["w", "w"], {"x": 1.5}), ("j", "b", False, "m", "boom", ["v"], {"x": 2.0, "y": 1.0}), (None, None, False, None, None, None, None)], "job string, kind string, ok boolean, method string, error string, warnings array<string>, timings map<string,double>")
    r = {x.job: x for x in runs.report(items, "job", F.col("ok"), "kind", "method", "error", "warnings", "timings").collect()}
    assert (r["j"].submitted, r["j"].by_kind, r["j"].by_method, r["j"].errors, r["j"].warnings, r["j"].timings_ms) == (2, {"a": 1, "b": 1}, {"m": 1}, {"boom": 1}, ["v", "w"], {"x": 3.5, "y": 1.0})
    assert r[None].submitted == 1
    f = spark.range(1).select(runs.failure(F.lit("FETCH"), F.lit("RateLimited"), F.lit("slow")).alias("f"), runs.failure(F.lit("FETCH"), F.lit("x"), F.lit(None).cast("string")).alias("g")).first()
    assert f.f.transient and f.g is None
    with pytest.raises(ValueError):
        runs.provenance({"unknown": F.lit(1)})


def test_readers_say_what_they_leave_out(spark):
    df = spark.createDataFrame([(1, "a,b\n" + "\n".join(f"{k},x" for k in range(30)))], "k int, t string")
    assert handlers.delimited(df, "k", "t").count() == 30
    rows = handlers.delimited(df, "k", "t", most=10).collect()
    assert len(rows) == 11 and rows[-1].error == "cut after 10 rows" and rows[-1].place == -1


def test_plan_in_words():
    from weftlake.functions.scope import Scope

    assert crawl.describe(Scope(start_url="https://a/", hosts=("a",), max_depth=1, max_pages=9, collect=("pdf",))) == "crawl https://a/ on a, to depth 1, at most 9 pages; collect files: .pdf"
