"""Registered queries over time and state: as-of joins, learned charsets, containers, indexes, ledgers and streams."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import charset, detect, freedates, urls
from ..operators import dedupe, dupindex, frontier, ordered, reports, specs, temporal
from ..sources import captures, lateral
from ..store import shared_dir, stored
from ..streaming import ledger
from .queries import SIMHASH_SQL, SQL, read, register

# --- time --------------------------------------------------------------------


@register("""SELECT a.event_id, coalesce(CASE WHEN epoch_us(a.ts) - epoch_us(v.ts) < 3600000000 THEN v.event_id END, -1) AS version, coalesce(CASE WHEN epoch_us(a.ts) - epoch_us(v.ts) < 3600000000 THEN v.value > 50 END, true) AS allowed
FROM (SELECT * FROM events WHERE event_type IN ('view', 'click')) a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') v ON a.user_id = v.user_id AND a.ts >= v.ts""")
def robots_as_of(spark, sf):
    """Requests judged by the rules last fetched for their origin, valid for one hour; without rules all is allowed."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("origin"), "ts", "event_id", "event_type", (F.col("value") > 50).alias("allowed"))
    fetched = e.filter("event_type = 'signup'").select("origin", "ts", "event_id", "allowed")
    asked = e.filter("event_type in ('view', 'click')").select("origin", "ts", "event_id")
    found = temporal.as_of_join(asked, fetched, "origin", "ts", "ts", valid=3600.0)
    return found.select("event_id", F.coalesce("version.event_id", F.lit(-1)).alias("version"), F.coalesce("version.allowed", F.lit(True)).alias("allowed"))


@register("""SELECT a.event_id, coalesce(v.event_id, -1) AS version, coalesce((epoch_us(a.ts) - epoch_us(v.ts)) / 1000000.0::DOUBLE, -1) AS age
FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') v ON a.user_id = v.user_id AND a.ts >= v.ts""")
def last_before_error(spark, sf):
    """The last answer before each failure, however old, and its age: stretches of a day, most taken over from earlier ones."""
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    found = temporal.as_of_join(e.filter("event_type = 'error'"), e.filter("event_type <> 'error'"), "user_id", "ts", "ts", stretch=86_400.0)
    return found.select("event_id", F.coalesce("version.event_id", F.lit(-1)).alias("version"), F.coalesce(temporal.age_seconds(F.col("ts"), F.col("version.ts")), F.lit(-1.0)).alias("age"))


@register("""SELECT s.event_id, min(e.ts) AS ended, count(e.ts) AS ends FROM (SELECT * FROM events WHERE event_type = 'click') s
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') e ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 2 HOUR GROUP BY 1""")
def paired_events(spark, sf):
    """Starts with their first end within two hours; a start without one is a timeout."""
    e = read(spark, sf, "events")
    starts, ends = e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("until"))
    return temporal.first_end(temporal.with_timeouts(starts, ends, "user_id", "ts", "until", 7200), "event_id", "until")


# --- bytes -------------------------------------------------------------------


@register("SELECT doc_id, sha256(text) AS sha FROM documents")
def charset_guesses(spark, sf):
    """Texts written in eight code pages and read back by likelihoods learned from all texts."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "text")
    model = charset.learn(d)
    page = F.element_at(F.array(*[F.lit(p) for p in charset.PAGES]), (F.pmod(F.xxhash64("doc_id"), F.lit(len(charset.PAGES))) + 1).cast("int"))
    raw = stored(d.select("doc_id", charset.encoded("text", page).alias("raw")))
    back = raw.select("doc_id", charset.decoded(F.col("raw"), model, whole=True).alias("r"))
    return back.select("doc_id", F.sha2(F.encode("r.text", "UTF-8"), 256).alias("sha"))


_OFFICE = {"en": ("word/document.xml", "[Content_Types].xml"), "fr": ("xl/worksheets/s1.xml", "docProps/app.xml"), "de": ("ppt/presentation.xml", "ppt/slides/1.xml"), "es": ("mimetype", "content.xml")}


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as containers: members in an order that the text's length decides, e-books for the texts of one language that begin with a vowel."""
    for batch in batches:
        made = []
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            names = list(_OFFICE.get(lang, ("a.txt", "b.txt")))
            if len(text) % 2:
                names.reverse()
            to = io.BytesIO()
            with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
                for name in names:
                    z.writestr(name, ("application/epub+zip" if text[:1].lower() in "aeiou" else "application/vnd.oasis.opendocument.spreadsheet") if name == "mimetype" else text)
            made.append(to.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "raw"])


@register("""SELECT doc_id, CASE lang WHEN 'en' THEN 'docx' WHEN 'fr' THEN 'xlsx' WHEN 'de' THEN 'pptx' WHEN 'es' THEN CASE WHEN regexp_matches(text, '^[aeiouAEIOU]') OR text = '' THEN 'epub' ELSE 'ods' END ELSE 'zip' END AS subtype FROM documents""")
def zip_kinds(spark, sf):
    """What containers hold, from the list of their members at the end of their bytes."""
    d = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    boxes = d.mapInArrow(_boxed, "doc_id long, raw binary")
    return boxes.select("doc_id", detect.detect(raw=F.col("raw"), members=True).alias("d")).select("doc_id", F.col("d.subtype").alias("subtype"))


# --- figures that batches carry on -------------------------------------------

@register("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, n, round(sum(value * CASE WHEN j = n - 1 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END * pow(0.99::DOUBLE, j)), 6) AS ema FROM r GROUP BY 1, 2""")
def averages_in_batches(spark, sf):
    """Moving averages with a long memory, folded from ten batches of three days."""
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    e = stored(e.withColumn("batch", F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / F.lit(3 * 86400))))
    done = e.limit(0).select("user_id", F.lit(0).cast("long").alias("n"), F.col("value").alias("ema"))
    for b in range(10):
        done = stored(ordered.folded_average(done, e.filter(F.col("batch") == b), "user_id", ["ts", "event_id"], "value", 0.01))
    return done.select("user_id", "n", F.round("ema", 6).alias("ema"))


@register("""WITH RECURSIVE u AS (
  SELECT user_id, CAST(floor((epoch(ts) - 1704067200) / 518400) AS INTEGER) AS b, ts, event_id, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS fill FROM events
), w AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts DESC, event_id DESC) - 1 AS j, count(*) OVER (PARTITION BY user_id, b) AS m FROM u),
g AS (SELECT user_id, b, any_value(m) AS m, sum(CASE WHEN j = m - 1 THEN 0.0::DOUBLE ELSE 0.25 * pow(0.75::DOUBLE, j) * fill END) AS e, sum(CASE WHEN j = m - 1 THEN fill ELSE 0 END) AS x, count(*) FILTER (true) AS c FROM w GROUP BY 1, 2),
r AS (
  SELECT DISTINCT user_id, -1 AS b, 0 AS version, false AS force, 0::BIGINT AS n, 0.0::DOUBLE AS ema, 0::BIGINT AS retirements FROM u
  UNION ALL
  SELECT user_id, b, version, CASE WHEN used AND n >= 5 AND ema < 0.75 THEN false ELSE force END, n, ema, retirements + CASE WHEN used AND force AND n >= 5 AND ema < 0.75 THEN 1 ELSE 0 END FROM (
    SELECT r.user_id, r.b + 1 AS b, r.version + CASE WHEN g.m IS NOT NULL AND NOT r.force THEN 1 ELSE 0 END AS version, g.m IS NOT NULL OR r.force AS force, g.m IS NOT NULL AS used, r.retirements,
      CASE WHEN g.m IS NULL THEN r.n WHEN r.force THEN r.n + g.m ELSE g.m END AS n,
      CASE WHEN g.m IS NULL THEN r.ema WHEN r.force THEN r.ema * pow(0.75::DOUBLE, g.m) + g.e + 0.25 * pow(0.75::DOUBLE, g.m - 1) * g.x ELSE g.e + pow(0.75::DOUBLE, g.m - 1) * g.x END AS ema
    FROM r LEFT JOIN g ON g.user_id = r.user_id AND g.b = r.b + 1 WHERE r.b < 4))
SELECT CAST(user_id AS VARCHAR) AS key, CAST(version AS INTEGER) AS versions, retirements, CAST(CASE WHEN force THEN version ELSE 0 END AS INTEGER) AS in_force, CASE WHEN force THEN n ELSE 0 END AS uses, CASE WHEN force THEN round(ema, 9) ELSE -1 END AS fill FROM r WHERE b = 4""")
def spec_listing(spark, sf):
    """Specs through five batches of six days: learned where none is in force, their uses averaged, retired where they serve badly."""
    start = 1704067200
    u = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("fill"))
    u = stored(u.withColumn("batch", F.floor((F.unix_seconds("at") - start) / F.lit(6 * 86400))))
    table = specs.empty(spark)
    for b in range(5):
        batch, end = u.filter(F.col("batch") == b), F.timestamp_seconds(F.lit(start + (b + 1) * 6 * 86400))
        new = batch.groupBy("key").agg(F.min("at").alias("learned")).select("key", F.concat(F.lit("{batch "), F.lit(str(b)), F.lit("}")).alias("rules"), "learned")
        table = stored(specs.learn(table, new))
        table = stored(specs.retire(specs.used(table, batch), end, least=0.75, idle_days=10_000))
    out = specs.listing(table)
    return out.select("key", "versions", "retirements", F.coalesce("in_force", F.lit(0)).alias("in_force"), F.coalesce("n", F.lit(0)).alias("uses"), F.coalesce(F.round("ema", 9), F.lit(-1.0)).alias("fill"))


@register(f"""WITH {SIMHASH_SQL}, near AS (SELECT b.doc_id, min(struct_pack(d := bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)), id := a.doc_id)) AS m FROM f a JOIN f b ON a.doc_id < b.doc_id
AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3 WHERE a.hi <> 0 OR a.lo <> 0 GROUP BY 1) SELECT doc_id, coalesce(m.id, -1) AS duplicate_of, CAST(coalesce(m.d, -1) AS INTEGER) AS distance FROM f LEFT JOIN near USING (doc_id)""")
def incremental_duplicates(spark, sf):
    """Each document's nearest earlier one, from an index that three batches probe and extend, the second one twice."""
    prints = stored(dedupe.simhash_md5(read(spark, sf, "documents")))
    cuts = prints.agg(F.percentile_approx("doc_id", F.array(F.lit(1 / 3), F.lit(2 / 3)), 10_000).alias("c")).first()["c"] or [0, 0]
    part = F.when(F.col("doc_id") <= cuts[0], 0).when(F.col("doc_id") <= cuts[1], 1).otherwise(2)
    path, found = f"{shared_dir(spark)}/index/{uuid.uuid4().hex}", {}
    for batch in (0, 1, 1, 2):
        found[batch] = stored(dupindex.check_and_add(prints.filter(part == batch), path, batch))
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.select("doc_id", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"), F.coalesce("distance", F.lit(-1)).alias("distance"))


@register("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def ledger_upserts(spark, sf):
    """The latest row of each key from four batches that arrive out of order, one of them twice."""
    e = stored(read(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")))
    path = f"{shared_dir(spark)}/upserts/{uuid.uuid4().hex}"
    for number, part in enumerate((2, 0, 3, 1)):
        rows = e.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part)
        for _ in range(1 + (number == 2)):
            ledger.upsert_batch(rows, number, path, ["user_id"], ["at", "event_id"], 16)
    return ledger.table(spark, path).select("user_id", "event_id", "event_type", "value")


_RATE, _BURST, _GAP = 0.001, 3.0, 30.0


@register(f"""WITH RECURSIVE q AS (SELECT user_id AS host, event_id AS seq, epoch_us(ts) / 1000000.0::DOUBLE AS s, value * 60 AS len, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT host, 0::BIGINT AS n, 0::BIGINT AS seq, -1e18::DOUBLE AS f1, -1e18::DOUBLE AS f2, {_BURST}::DOUBLE AS tokens, NULL::DOUBLE AS filled, -1e18::DOUBLE AS last, 0.0::DOUBLE AS start, 0.0::DOUBLE AS waited FROM q WHERE n = 1
  UNION ALL
  SELECT host, n, seq, least(f2, s2 + len), greatest(f2, s2 + len), t1 - 1, filled1, ended, s2, s2 - s FROM (
    SELECT *, greatest(s1, ended + {_GAP}) AS s2 FROM (
      SELECT *, greatest(CASE WHEN f1 <= s1 THEN f1 ELSE -1e18 END, CASE WHEN f2 <= s1 THEN f2 ELSE -1e18 END, CASE WHEN last <= s1 THEN last ELSE -1e18 END) AS ended FROM (
        SELECT *, CASE WHEN tok < 1 THEN fil + (1 - tok) / {_RATE} ELSE s0 END AS s1, greatest(tok, 1) AS t1, CASE WHEN tok < 1 THEN fil + (1 - tok) / {_RATE} ELSE fil END AS filled1 FROM (
          SELECT *, least({_BURST}, tokens + CASE WHEN filled IS NULL THEN 0 ELSE greatest(0, s0 - filled) * {_RATE} END) AS tok, greatest(coalesce(filled, s0), s0) AS fil FROM (
            SELECT q.host, q.n, q.seq, q.s, q.len, r.f1, r.f2, r.tokens, r.filled, r.last, greatest(q.s, r.f1) AS s0 FROM r JOIN q ON q.host = r.host AND q.n = r.n + 1))))))
SELECT host, seq, round(start, 3) AS start, round(waited, 3) AS waited FROM r WHERE n > 0""")
def host_slots(spark, sf):
    """When each request of a host starts that has two slots, a token bucket and a gap to keep."""
    e = read(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    out = ordered.limited(e, "user_id", "event_id", seconds, F.col("value") * 60, _RATE, _BURST, 2, _GAP)
    return out.select("host", "seq", F.round("start", 3).alias("start"), F.round("waited", 3).alias("waited"))


@register("""WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
r(url, depth) AS (SELECT 'p1', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 2)
SELECT DISTINCT dst AS url FROM e WHERE dst NOT IN (SELECT url FROM r)""")
def frontier_novelty(spark, sf):
    """Links that three rounds of a crawl have not seen, by a filter for each round and a join for what the filters hold."""
    l = read(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s")).distinct()
    links = stored(l.select(F.col("p").alias("src"), F.col("s").alias("dst")).unionByName(l.select(F.col("s").alias("src"), F.col("p").alias("dst"))))
    seen = stored(frontier.reach(links.filter("src = 'p1'").select(F.col("src").alias("url")), links, 2))
    rounds = [seen.filter(F.col("depth") == d) for d in range(3)]
    filters = frontier.seen_filters(rounds[0])
    for r in rounds[1:]:
        filters = filters.unionByName(frontier.seen_filters(r))
    return frontier.novel(links.select(F.col("dst").alias("url")), seen, stored(filters))


# --- blobs and captures ------------------------------------------------------


@register("SELECT o_custkey, o_orderkey AS orderkey, o_orderstatus AS status, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place FROM orders")
def lateral_blobs(spark, sf):
    """Orders of a customer as one text, read by a table function whose columns and types the hint names."""
    lateral.register(spark)
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    rows = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))).alias("rows"))
    blobs = rows.select("o_custkey", F.concat(F.lit("orderkey,status,priority\n"), F.array_join(F.transform("rows", lambda r: r["l"]), "\n")).alias("text"))
    hint = '{"orderkey": "integer", "status": "string"}'
    return spark.sql("SELECT b.o_custkey, r.orderkey, r.status, r.place FROM {blobs} b, LATERAL read_blob(b.text, 'csv', :hint) r", args={"hint": hint}, blobs=blobs)


@register("""SELECT page_id, host, length(html) AS chars FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages) WHERE regexp_matches(host, '\\.org$') AND host < 'n'""")
def recorded_captures(spark, sf):
    """Stored captures of hosts in a range, read back by a source that opens the folders of those hosts alone."""
    captures.register(spark)
    folder = f"{shared_dir(spark)}/captures/{uuid.uuid4().hex}"
    pages = read(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), F.concat(F.col("page_id").cast("string"), F.lit(" "), "url").alias("url"), F.lit(200).alias("status"), F.col("html").alias("body"))
    captures.record(pages, folder, 0)
    found = spark.read.format("captures").load(folder).filter((F.col("host") < "n") & F.col("host").endswith(".org"))
    return found.select(F.regexp_extract("url", r"^(\d+) ", 1).cast("long").alias("page_id"), "host", F.length("body").cast("long").alias("chars"))


# --- dates in sentences ------------------------------------------------------

_MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}


@register("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS found FROM orders")
def sentence_dates(spark, sf):
    """Dates of orders inside sentences of four languages and shapes, read by a grammar of tokens."""
    d = F.col("o_orderdate")
    months = {n: F.element_at(F.array(*[F.lit(m) for m in names.split()]), F.month(d)) for n, names in _MONTHS.items()}
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    shapes = [
        F.concat(F.lit("Order no. 7 was placed on "), F.date_format(d, "EEEE"), F.lit(", the "), day, F.lit("th of "), months["en"], F.lit(", "), year, F.lit(" by 3 clerks")),
        F.concat(F.lit("Bestellung vom "), day, F.lit(". "), months["de"], F.lit(" "), year, F.lit(" um 12:30 Uhr")),
        F.concat(F.lit("commande passée le "), day, F.lit(" "), months["fr"], F.lit(" "), year, F.lit(", 2 articles")),
        F.concat(F.lit("pedido del "), day, F.lit(" de "), months["es"], F.lit(" de "), year),
        F.concat(F.lit("shipped "), F.date_format(d, "yyyy-MM-dd"), F.lit("T08:15:00Z with 12 boxes")),
    ]
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    said = F.element_at(F.array(*shapes), priority)
    return read(spark, sf, "orders").select("o_orderkey", freedates.find_date()(said).cast("date").alias("found"))


# --- figures of the parts ----------------------------------------------------


@register(f"""WITH w AS ({SQL['host_slots']}), d AS ({SQL['incremental_duplicates']}), p AS (SELECT user_id AS host, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error' AND coalesce(before, '') <> 'error') AS trips FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1)
SELECT 'limiter' AS part, 'requests' AS figure, count(*)::DOUBLE AS value FROM w UNION ALL SELECT 'limiter', 'delayed', (count(*) FILTER (waited > 0))::DOUBLE FROM w UNION ALL SELECT 'limiter', 'waited', round(sum(waited), 0) FROM w UNION ALL SELECT 'limiter', 'longest', round(max(waited), 3) FROM w
UNION ALL SELECT 'duplicates', 'documents', count(*)::DOUBLE FROM d UNION ALL SELECT 'duplicates', 'exact', (count(*) FILTER (distance = 0))::DOUBLE FROM d UNION ALL SELECT 'duplicates', 'near', (count(*) FILTER (distance > 0))::DOUBLE FROM d UNION ALL SELECT 'duplicates', 'new', round((count(*) FILTER (distance < 0))::DOUBLE / count(*), 3) FROM d
UNION ALL SELECT 'breaker', 'hosts', count(*)::DOUBLE FROM p UNION ALL SELECT 'breaker', 'opened', (count(*) FILTER (errors > 0))::DOUBLE FROM p UNION ALL SELECT 'breaker', 'trips', sum(trips)::DOUBLE FROM p UNION ALL SELECT 'breaker', 'not_closed', sum(errors)::DOUBLE FROM p""")
def engine_statistics(spark, sf):
    """Figures of the limiter, of a breaker that one failure opens and the next answer closes, and of the duplicate check."""
    e = read(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    slots = stored(host_slots(spark, sf))
    ranked = stored(ordered.breaker_states(e, "user_id", "event_id", seconds, F.col("event_type") == "error", threshold=1, recover=0.0, successes=1).join(e.select(F.col("event_id").alias("seq"), "ts"), "seq"))
    checked = stored(dupindex.check_and_add(stored(dedupe.simhash_md5(read(spark, sf, "documents"))), f"{shared_dir(spark)}/index/{uuid.uuid4().hex}", 0))
    parts = {"limiter": reports.limiter_stats(slots).withColumn("waited", F.round("waited", 0)), "duplicates": reports.duplicate_stats(checked), "breaker": reports.breaker_stats(ranked, "host", "ts")}
    rows = None
    for name, figures in parts.items():
        long = figures.select(F.lit(name).alias("part"), F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in figures.columns])).alias("f")).select("part", "f.*")
        rows = long if rows is None else rows.unionByName(long)
    return rows

