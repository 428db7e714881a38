"""Table functions over blobs, recorded captures, novelty filters and dates in sentences."""

import contextlib
import datetime as dt
import io

import numpy as np
from pyspark.sql import functions as F

from weftlake.functions import freedates
from weftlake.operators import frontier
from weftlake.sources import captures, handlers, lateral


def test_table_function(spark):
    lateral.register(spark)
    blobs = [(1, "id;name;ok\n1;a;yes\nx;b;no"), (2, None), (3, ""), (4, '{"id": 5, "tags": ["p", 2]}'), (5, "{broken")]
    spark.createDataFrame(blobs, "k int, t string").createOrReplaceTempView("blobs")
    got = spark.sql("""SELECT k, r.* FROM blobs, LATERAL read_blob(t, 'csv', '{"id": "integer", "name": "string", "ok": "boolean"}') r WHERE k < 4 ORDER BY k, place""")
    assert got.schema.simpleString() == "struct<k:int,place:int,id:bigint,name:string,ok:boolean,error:string>"
    assert [tuple(r) for r in got.collect()] == [(1, 0, 1, "a", True, None), (1, 1, None, "b", False, None)]
    found = spark.sql("""SELECT k, r.* FROM blobs, LATERAL read_blob(t, 'json', '{"id": "integer", "tags": "list of strings"}') r WHERE k > 3 ORDER BY k""").collect()
    assert tuple(found[0])[:4] == (4, 0, 5, ["p", "2"]) and found[1].place == -1 and found[1].error
    mail = b"From: a@b.example\nSubject: Hi\n\nbody"
    mails = spark.createDataFrame([(1, bytearray(mail))], "k int, raw binary")
    parts = spark.sql("""SELECT r.* FROM {mails}, LATERAL read_blob(raw, 'mail', :hint) r""", args={"hint": '{"part": "string", "body": "string"}'}, mails=mails).collect()
    assert any("body" in (r.body or "") for r in parts)


def test_xml_keeps_everything():
    import json

    wide = json.loads(next(handlers.read_xml("<r>" + "".join(f"<c>{i}</c>" for i in range(5000)) + "</r>"))[0])
    assert wide["r"]["c"] == [str(i) for i in range(5000)]
    deep = json.loads(next(handlers.read_xml("<a>" * 60 + "x" + "</a>" * 60))[0])
    for _ in range(60):
        deep = deep["a"]
    assert deep == "x"


def test_captures(spark, tmp_path):
    captures.register(spark)
    rows = lambda n: spark.createDataFrame([(f"h{i % 4}.example" if i % 9 else None, f"u{n}-{i}", 200, "b" * i) for i in range(40)], "host string, url string, status int, body string")
    for n in range(3):
        captures.record(rows(n), f"{tmp_path}/c", n)
    every = spark.read.format("captures").load(f"{tmp_path}/c")
    assert every.count() == 120 and every.filter("host = ''").count() == 15
    some = every.filter("host = 'h1.example' and seq > 0")
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        some.explain("formatted")
    assert {(r.seq, r.host) for r in some.collect()} == {(1, "h1.example"), (2, "h1.example")} and some.rdd.getNumPartitions() == 2
    assert "Filter" not in plan.getvalue().split("Physical")[-1].replace("PushedFilters", "") or "isnotnull" in plan.getvalue()
    assert every.filter("status = 200 and host in ('h2.example', 'h3.example')").rdd.getNumPartitions() == 6
    assert every.filter("url = 'u1-5'").count() == 1
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.format("captures").load(f"{tmp_path}/c")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/k").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 120
    assert spark.read.format("captures").load(f"{tmp_path}/none").count() == 0


def test_novelty(spark):
    seen = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"))
    found = spark.range(4000, 9000).select(F.concat(F.lit("u"), F.col("id") % 8000).alias("url"))
    filters = frontier.seen_filters(seen.limit(0), 8).unionByName(frontier.seen_filters(seen, 8))
    got = frontier.novel(found, seen, filters, 8)
    assert sorted(r.url for r in got.collect()) == sorted(r.url for r in found.distinct().join(seen, "url", "left_anti").collect())
    assert frontier.novel(found, seen.limit(0), filters.limit(0), 8).count() == 5000


def test_false_positives_are_few():
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 62), 1 << 62, (20_000, 2))
    size = 8 * (10_000 * frontier.BITS // 8 + 1)
    bits = np.zeros(size, bool)
    bits[frontier._places(h[:10_000, 0], h[:10_000, 1], size).ravel()] = True
    assert bits[frontier._places(h[:10_000, 0], h[:10_000, 1], size)].all()
    assert bits[frontier._places(h[10_000:, 0].copy(), h[10_000:, 1].copy(), size)].all(1).mean() < 0.01


def test_dates_in_sentences(spark):
    day = lambda y, m, d, *t: dt.datetime(y, m, d, *t)
    cases = {
        "On the 3rd of March, 2021 it rained": day(2021, 3, 3), "posted March 3, 2021 at 4:05 pm": day(2021, 3, 3, 16, 5), "le 14 juillet 1998 à 10:00": day(1998, 7, 14, 10),
        "at 2020-05-06T10:11:12+02:00 sharp": day(2020, 5, 6, 8, 11, 12), "25/12/99": day(1999, 12, 25), "in Sept 2019": day(2019, 9, 1), "no 5 of 12 apples": None, "": None, None: None,
        "Wed, 02 Oct 2002 15:00:00 GMT": day(2002, 10, 2, 15), "ref 20210304": day(2021, 3, 4), "30 February 2020 or 1 May 2020": day(2020, 5, 1), "el 5 de diciembre de 2010": day(2010, 12, 5), "9" * 5000: None,
    }
    for text, want in cases.items():
        assert freedates.read(text) == want, text
    assert freedates.read("5/6/2021", dayfirst=True) == day(2021, 6, 5) and freedates.read("5/6/2021") == day(2021, 5, 6)
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(freedates.find_date()("t")).collect()] == list(cases.values())


def test_robots_rules_with_many_stars(spark):
    cases = [("/a*b$", "/axxb", True), ("/a*b$", "/axxbc", False), ("/*a*a*a*a*a*a*a*a*a*a*a*b", "/" + "a" * 5000, False), ("/*?p=", "/x?p=1", True), ("*", "/", True), ("/a$", "/a", True), ("/a$", "/ab", False), ("/ab*b$", "/ab", False), ("/a.b", "/axb", False), ("/$x", "/$x/y", True), ("", "/", True)]
    df = spark.createDataFrame(cases, "v string, p string, w boolean")
    assert [r.g for r in df.select(handlers.fits_rule(F.col("v"), F.col("p")).alias("g")).collect()] == [w for _, _, w in cases]
