"""Operators against plain Python on small rows."""

import bz2
import gzip
import io
import random
import tarfile
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from weftlake.functions import structured
from weftlake.operators import cascade, crawl, dedupe, frontier, html, ordered, reports, tables, validate
from weftlake.sources import handlers
from weftlake.store import stored

PAGE = """<!DOCTYPE html><html lang="en"><head><title> A &amp; B </title><meta name="description" content=" d "><link rel="canonical" href="/c"></head>
<body><nav><a href="/n">N</a></nav><a href="#x">no</a><a href="mailto:x">no</a><article><h2>Two</h2><h1>One</h1><p>text <b>bold<br>more<p>next<a href="../up" rel="NoFollow">Up</a><a href="../up">again</a>
<table><tr><th>k<th>v<tr><td>1<td>2<td>3</table>""" + "<p>long words here" * 20 + "</article><footer>foot</footer></body>"


def test_page():
    p = html.page(PAGE, "http://e.org/a/b/")
    assert p["metadata"] == {"title": "A & B", "description": "d", "canonical": "http://e.org/c", "language": "en"}
    assert [x["url"] for x in p["links"]] == ["http://e.org/n", "http://e.org/a/up"] and p["links"][1]["rel"] == "nofollow"
    assert p["headings"] == [{"level": 1, "text": "One"}, {"level": 2, "text": "Two"}]
    assert p["tables"] == [{"headers": ["k", "v", "col_2"], "rows": [["1", "2", "3"]]}]
    assert "foot" not in p["text_content"] and p["text_content"].startswith("Two\nOne\ntext\nbold\nmore")
    assert html.page(None, None)["links"] == [] and html.page("<p>x<p", "")["text_content"].startswith("x")


def test_selectors():
    root = html.parse('<div id=a class="x y"><p>1</p><span><p data-k="v-1">2</p></span></div><p>3')
    texts = lambda s: [n.text() for n in html.select(root, s)]
    assert texts("#a > p") == ["1"] and texts(".y p") == ["1", "2"] and texts("p") == ["1", "2", "3"] and texts('[data-k^="v"], span > p') == ["2"]
    assert html.apply_rule(root, {"selector": "p", "multiple": True}) == ["1", "2", "3"]
    assert html.apply_rule(root, {"selector": "p", "attribute": "data-k", "pattern": r"-(\d)"}) == "1"
    with pytest.raises(ValueError):
        html.compile_selector("p:nth-child(2)")


def test_validation(spark):
    rows = [(1, "N/A", "http://x.org", ["string", "fine"]), (2, "A good title", "x.org", []), (3, None, None, None), (4, "As an AI, no", "//x", ["ok"])]
    df = spark.createDataFrame(rows, "id int, title string, url string, tags array<string>")
    got = {r.id: r for r in validate.validate(df, ["title", "url", "tags"], required=["title"]).collect()}
    assert got[1].errors == ["title:placeholder", "tags:schema_echo"] and not got[1].valid
    assert got[2].errors == [] and got[2].warnings == ["url:url_shape"] and got[2].valid
    assert got[3].errors == ["title:required", "nothing was extracted"] and got[4].errors == ["title:refusal"]
    rates = {r.id: r.rate for r in df.select("id", validate.fill_rate(["title", "url"]).alias("rate")).collect()}
    assert rates[3] == 0 and rates[1] == 1


def test_leaders_are_greedy(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {}
    for i in range(150):
        x = rng.choice(base)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        prints[i] = x
    df = spark.createDataFrame([(i, x >> 32, x & 0xFFFFFFFF) for i, x in prints.items()], "doc_id long, hi long, lo long")
    classes = stored(dedupe.fingerprint_classes(df))
    pairs = dedupe.near_pairs(classes)
    reps = sorted({x: i for i, x in reversed(prints.items())}.values())
    want = {(a, b) for a in reps for b in reps if a < b and (prints[a] ^ prints[b]).bit_count() <= 3}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    lead = {}
    for b in reps:
        near = sorted(((prints[a] ^ prints[b]).bit_count(), a) for a in reps if a < b and lead[a] == a and (prints[a] ^ prints[b]).bit_count() <= 3)
        lead[b] = near[0][1] if near else b
    assert {r.rep: r.leader for r in dedupe.leaders(classes, pairs, stored).collect()} == lead
    for size in (0, 3):  # large components by rounds
        monkeypatch.setattr(dedupe, "RESOLVED", size)
        assert {r.rep: r.leader for r in dedupe.leaders(classes, pairs, stored).collect()} == lead
    with pytest.raises(ValueError):
        dedupe.near_pairs(classes, 4)


def test_leaders_of_a_long_chain_take_few_rounds(spark):
    classes = spark.range(300).select(F.col("id").alias("rep"))
    pairs = spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).alias("distance"))
    kept = []

    def store(df):
        kept.append(df)
        return stored(df)

    got = {r.rep: r.leader for r in dedupe.leaders(classes, pairs, store).collect()}
    assert got == {i: i - i % 2 for i in range(300)} and len(kept) < 25


def test_sitemap_indexes(spark):
    bodies = [("top", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap><sitemap><loc>top</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc>p1</loc></url><url><loc>p2</loc></url></urlset>"), ("b", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>")]
    start, stored_ = spark.createDataFrame([("top",), ("top",)], "url string"), spark.createDataFrame(bodies, "url string, body string")
    found = lambda **kw: sorted(((r.loc, r.sitemap, r.level) for r in crawl.sitemap_pages(start, stored_, **kw).collect()), key=str)
    assert found() == sorted([("p1", "a", 1), ("p2", "a", 1), (None, "gone", 2)], key=str)
    assert found(levels=0) == sorted([(None, "a", 1), (None, "b", 1)], key=str)
    assert crawl.sitemap_pages(start.limit(0), stored_).collect() == []


def test_ordered_folds(spark):
    rng = random.Random(5)
    rows = [(k, s, float(s * 40), rng.random() < 0.5) for k in range(4) for s in range(120)]
    df = spark.createDataFrame(rows, "k long, s long, t double, bad boolean").repartition(5)
    got = {(r.host, r.seq): r.state for r in ordered.breaker_states(df, "k", "s", F.col("t"), F.col("bad"), threshold=3).collect()}
    for k in range(4):
        mode, fails, wins, opened = "closed", 0, 0, 0.0
        for _, s, t, bad in [r for r in rows if r[0] == k]:
            if mode == "open" and t - opened >= 300:
                mode, wins = "half_open", 0
            if mode == "half_open":
                wins = 0 if bad else wins + 1
                if bad:
                    mode, opened = "open", t
                elif wins == 2:
                    mode, fails = "closed", 0
            elif mode == "closed":
                fails = fails + 1 if bad else 0
                if fails == 3:
                    mode, opened, fails = "open", t, 0
            assert got[k, s] == mode
    left = {(r.host, r.seq): (r.allowed, r.tokens) for r in ordered.token_bucket(df, "k", "s", F.col("t"), 1 / 100, 2.0).collect()}
    assert [left[0, s][0] for s in range(6)] == [True, True, False, True, False, True]
    ema = {r.k: r.ema for r in ordered.moving_average(df.withColumn("v", F.col("s").cast("double")), "k", ["s"], "v").collect()}
    x = 0.0
    for s in range(1, 120):
        x = 0.25 * s + 0.75 * x
    assert abs(ema[2] - x) < 1e-9


def test_drift_batch_and_stream(spark, tmp_path):
    from weftlake.streaming import live

    rows = [("a", s, s < 30 or s % 3 == 0) for s in range(60)] + [("b", s, True) for s in range(25)]
    df = spark.createDataFrame(rows, "key string, seq long, filled boolean")
    batch = ordered.drift_alerts(df, "key", ["seq"], {"f": F.col("filled")}).collect()
    assert {r.key for r in batch} == {"a"} and min(r.seen for r in batch) == 56
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df.filter("seq < 40").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.filter("seq >= 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.drift_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("drift").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.seen) for r in spark.table("drift").filter("alert").collect()}
    assert got == {(r.key, r.seen) for r in batch}


def test_segments(spark, tmp_path):
    from weftlake.streaming import live

    (tmp_path / "in").mkdir()
    for k, n in enumerate((5000, 10, 6000)):
        (tmp_path / "in" / f"seg_{k}.wav").write_bytes(b"x" * n)
    seen = []
    q = live.each_batch(live.segments(spark, f"{tmp_path}/in", "*.wav"), lambda df, _: seen.extend((r.place, r.offset) for r in df.collect()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sorted(seen) == [(0, 0), (2, 240)]


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "d"), ("d", "e"), ("b", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    assert {(r.url, r.depth) for r in frontier.reach(seeds, links, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.url for r in frontier.reach(seeds, links, 5, max_pages=2).collect()} == {"a", "b"}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert {(r.src, r.target, r.hops) for r in frontier.redirect_targets(chain, 4).collect()} == {("a", "c", 2), ("b", "c", 1), ("x", "y", 1)}


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 5, "old"), (1, None, 7, "new"), (2, "x", 1, "only")], "a int, b string, at int, v string")
    assert {(r.a, r.b, r.v, r.first_seen) for r in tables.upsert(rows, ["a", "b"], ["at"], "at").collect()} == {(1, None, "new", 5), (2, "x", "only", 1)}
    path = f"{tmp_path}/t"
    tables.merge_into(spark, path, rows.filter("at < 7"), ["a", "b"], ["at"])
    tables.merge_into(spark, path, rows.filter("at = 7"), ["a", "b"], ["at"])
    assert {r.v for r in spark.read.parquet(path).collect()} == {"new", "only"}
    assert tables.missing(rows.select("a"), rows.filter("a = 1").select("a"), "a").collect()[0].a == 2
    report = reports.run_report(rows.withColumn("ok", F.col("at") > 1), "a", F.col("ok"), "b", "v").collect()
    assert {(r.a, r.submitted, r.succeeded, r.failed) for r in report} == {(1, 2, 2, 0), (2, 1, 0, 1)}


def test_cascade(spark):
    hint = {"title": "string", "tags": "list of strings"}
    items = spark.createDataFrame([(1, "k1", {}, {}, "t"), (2, "k2", {"headline": "H", "keywords": "a, b"}, {}, "t"), (3, "k3", {}, {"title": "only"}, "t"), (4, "k4", {}, {}, "ask me")], "id long, cache_key string, flat map<string,string>, metadata map<string,string>, text string")
    cache = spark.createDataFrame([("k1", "C", ["z"])], "cache_key string, title string, tags array<string>")
    specs = lambda left: left.filter("id = 3").select("id", F.lit("S").alias("title"), F.array(F.lit("s")).alias("tags"))
    got = {r.id: r for r in cascade.run(items, hint, cache=cache, specs=specs, backend=lambda text, h: {"title": text.upper(), "tags": []}).collect()}
    assert [(got[k].method, got[k].tier, got[k].title) for k in (1, 2, 3, 4)] == [("cache", 0, "C"), ("structured", 1, "H"), ("selector", 2, "S"), ("llm", 3, "ASK ME")]
    assert got[2].tags == ["a", "b"] and got[4].confidence == 0.5
    answers = cascade.run(items, hint, cache=cache, specs=specs, backend=lambda text, h: {"title": text.upper(), "tags": []})
    kept = cache.unionByName(cascade.to_store(answers, items, hint))
    assert {r.cache_key for r in kept.collect()} == {"k1", "k2", "k3", "k4"}
    again = cascade.run(items, hint, cache=kept).collect()
    assert {r.method for r in again if r.id < 4} == {"cache"} and all(r.warning is None for r in again)
    long = items.withColumn("text", F.repeat(F.lit("x"), 13_000)).filter("id = 4")
    told = cascade.run(long, hint, backend=lambda text, h: {"title": str(len(text)), "tags": []}).first()
    assert told.title == "12000" and told.warning == "text of 13000 characters was cut to 12000"
    none = {r.id: r.method for r in cascade.run(items, hint, tiers=(1,)).collect()}
    assert none == {1: None, 2: "structured", 3: None, 4: None}
    assert structured.SYNONYMS["price"][0] == "price" and len(structured.SYNONYMS) == 44


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k.replace("__", "/"), v)
    return out.getvalue()


def test_readers(spark):
    t = lambda rows, kind="string": spark.createDataFrame(list(enumerate(rows)), f"k int, v {kind}")
    got = handlers.delimited(t(["a,b\n1,2\n3,4,5\n", "1,2\n3,4\n", None, "x"]), "k", "v").collect()
    assert [(r.k, r.record) for r in got] == [(0, {"a": "1", "b": "2"}), (0, {"a": "3", "b": "4", "col_2": "5"}), (1, {"col_0": "1", "col_1": "2"}), (1, {"col_0": "3", "col_1": "4"})]
    got = handlers.json_records(t(['[{"a":1},2]', '{"a":1}\nbad\n{"b":2}', "no", '{"x":[1]}']), "k", "v").select("k", F.to_json("value").alias("j")).collect()
    assert [tuple(r) for r in got] == [(0, '{"a":1}'), (0, "2"), (1, '{"a":1}'), (1, '{"b":2}'), (3, '{"x":[1]}')]
    got = handlers.yaml_values(t(["a: [1, x]", "!!python/object:os.system x"]), "k", "v").collect()
    assert got[0].json == '{"a": [1, "x"]}' and got[1].error
    got = handlers.xml_values(t(['<r a="1"><x>1</x><x>2</x>t</r>', "<!DOCTYPE r []><r/>", "<r"]), "k", "v").collect()
    assert got[0].json == '{"r": {"@a": "1", "x": ["1", "2"]}}' and got[1].error and got[2].error
    rss = "<rss><channel><item><title>T</title><link>http://x</link><pubDate>d</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="http://y"/><author><name>N</name></author></entry></feed>'
    got = handlers.feed_entries(t([rss, atom]), "k", "v").collect()
    assert [(r.title, r.url, r.author, r.published) for r in got] == [("T", "http://x", None, "d"), ("E", "http://y", "N", None)]
    got = handlers.sitemap_urls(t(["<urlset><url><loc> http://a </loc><priority>0.5</priority></url><url><loc>http://b</loc></url></urlset>"]), "k", "v").collect()
    assert [(r.place, r.loc, r.priority) for r in got] == [(0, "http://a", "0.5"), (1, "http://b", None)]


def test_mail_and_archives(spark):
    m = EmailMessage()
    m["From"], m["Subject"] = "a@b.c", "S"
    m.set_content("plain body")
    m.add_attachment(b"data", maintype="application", subtype="x", filename="f.bin")
    df = spark.createDataFrame([(1, bytearray(m.as_bytes()))], "k int, v binary")
    got = handlers.mail_parts(df, "k", "v").collect()
    assert got[0].headers["subject"] == "S" and got[0].body.strip() == "plain body" and bytes(got[1].data) == b"data"
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as f:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 2
        f.addfile(info, io.BytesIO(b"hi"))
    blobs = [zipped(a="1", d__b="22"), zipped(**{"..__evil": "x", "ok": "y"}), tar.getvalue(), gzip.compress(b"one"), bz2.compress(b"two"), gzip.compress(b"\0" * 10_000_000), b"junk"]
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(blobs)], "k int, v binary")
    got = [(r.k, r.name, bytes(r.data) if r.data is not None else None) for r in handlers.archive_members(rows, "k", "v").filter("dropped is null").collect()]
    assert [(r.k, r.name) for r in handlers.archive_members(rows, "k", "v").filter("dropped = 'unsafe name'").collect()][:1] == [(1, "../evil")]
    assert got[:6] == [(0, "a", b"1"), (0, "d/b", b"22"), (1, "ok", b"y"), (2, "d/x.txt", b"hi"), (3, "content", b"one"), (4, "content", b"two")]
    assert got[6][1] is None and got[7][1] is None


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok\n\nUser-agent: mybot\nDisallow: /only$\nCrawl-delay: 2\nSitemap: http://x/s.xml"
    robots = spark.createDataFrame([("o1", 200, body), ("o2", 403, None), ("o3", 404, None), ("o4", 503, None)], "origin string, status int, body string")
    urls = spark.createDataFrame([(f"{o}{p}", o, p) for o, p in [("o1", "/private/x"), ("o1", "/private/ok/y"), ("o1", "/a"), ("o1", "/only"), ("o2", "/"), ("o3", "/"), ("o4", "/"), ("o5", "/")]], "url string, origin string, path string")
    got = {r.url: r.allowed for r in handlers.robots_verdict(urls, robots, "other").collect()}
    assert got == {"o1/private/x": False, "o1/private/ok/y": True, "o1/a": True, "o1/only": True, "o2/": False, "o3/": True, "o4/": True, "o5/": True}
    mine = {r.url: r.allowed for r in handlers.robots_verdict(urls, robots, "MyBot/1.0").collect()}
    assert mine["o1/private/x"] and not mine["o1/only"]
    assert robots.select(handlers.robots_sitemaps(F.col("body")).alias("s")).first().s == ["http://x/s.xml"]
