"""Registered queries over crawls: seeds, steps, budgets, states, stores, and the forms that addresses take."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scope, urls
from ..functions import text as T
from ..operators import crawl, frontier, html, runs, tables
from ..store import shared_dir, stored
from .queries import SQL, read, register

_HOST = r"lower(regexp_extract(url, '://([^/:?#]*)', 1))"
_ORIGIN = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_CANONICAL = r"""regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&'), ''), '')"""


def _starts(spark, sf) -> DataFrame:
    return read(spark, sf, "pages").filter("page_id % 10 = 0").select("url")


@register(f"""WITH s AS (SELECT url FROM pages WHERE page_id % 10 = 0), o AS (SELECT DISTINCT {_ORIGIN} AS origin FROM s)
SELECT url, min(k) = 1 AS from_robots FROM (SELECT {_CANONICAL} AS url, 0 AS k FROM s UNION ALL SELECT origin || '/sitemap.xml', 1 FROM o UNION ALL SELECT origin || '/news.xml', 1 FROM o) GROUP BY 1""")
def seed_set(spark, sf):
    """Start addresses and the sitemaps their robots files name."""
    robots = read(spark, sf, "pages").select(urls.origin(F.col("url")).alias("origin")).distinct()
    robots = robots.withColumn("body", F.format_string("User-agent: *\nSitemap: %s/sitemap.xml\nSitemap: %s/news.xml\nSitemap: %s/news.xml#x\n", "origin", "origin", "origin"))
    return crawl.seeds(_starts(spark, sf), robots)


@register(f"""SELECT page_id, {_CANONICAL} AS url FROM pages WHERE NOT regexp_matches({_CANONICAL}, '(?i)/\\d{{4}}/\\d{{1,2}}(/\\d{{1,2}})?/?$|[?&](year|month|day|week)=\\d+|[?&]sort=') AND regexp_matches({_CANONICAL}, '/(en|fr)/')
AND (regexp_matches({_CANONICAL}, '(?i)\\.(html?|php|aspx?|jsp)([?]|$)') OR NOT regexp_matches({_CANONICAL}, '://[^/]*(/[^?]*)*/[^/?]*\\.[^/?]*([?]|$)')) AND NOT contains({_CANONICAL}, '/fr/8')""")
def sitemap_scope(spark, sf):
    """Entries of sitemaps that a crawl may take."""
    rule = scope.Scope(max_depth=2, collect=("html",), include=(r"/(?:en|fr)/",), exclude=(r"/fr/8",))
    entries = crawl.in_scope(read(spark, sf, "pages").select("page_id", "url"), rule)
    return entries.filter(F.col("url").rlike("/(?:en|fr)/"))


@register(rf"""SELECT url AS loc, {_ORIGIN} || '/' || (page_id % 3) || '.xml' AS sitemap, CAST(2 AS INTEGER) AS level FROM pages""")
def sitemap_trees(spark, sf):
    """Pages found from one index of indexes: an index for each origin, three sitemaps in each; indexes name each other and themselves, too."""
    p = read(spark, sf, "pages").select("page_id", "url", urls.origin(F.col("url")).alias("origin")).withColumn("map", F.concat("origin", F.lit("/"), (F.col("page_id") % 3).cast("string"), F.lit(".xml")))
    entry = lambda tag, c: F.concat(F.lit(f"<{tag}><loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{tag}>"))
    text = lambda rows, root: F.concat(F.lit(f"<{root}>"), F.array_join(F.array_sort(F.collect_list(rows)), ""), F.lit(f"</{root}>"))
    maps = p.groupBy(F.col("map").alias("url")).agg(text(entry("url", F.col("url")), "urlset").alias("body"))
    origins = p.select("origin", "map").distinct().withColumn("index", F.concat("origin", F.lit("/index.xml")))
    indexes = origins.groupBy(F.col("index").alias("url")).agg(F.concat(text(entry("sitemap", F.col("map")), "sitemapindex"), F.lit("<sitemap><loc>https://top.example/index.xml</loc></sitemap>")).alias("body"))
    top = origins.select("index").distinct().agg(text(entry("sitemap", F.col("index")), "sitemapindex").alias("body")).select(F.lit("https://top.example/index.xml").alias("url"), "body")
    bodies = stored(maps.unionByName(indexes).unionByName(top))
    return crawl.sitemap_pages(bodies.filter("url = 'https://top.example/index.xml'").select("url"), bodies)


_STEP_SQL = rf"""l AS (SELECT DISTINCT page_id, {_ORIGIN} || href AS url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages)),
c AS (SELECT page_id, url, page_id % 4 AS depth, page_id % 5 = 0 AS nofollow FROM l),
s AS (SELECT page_id, url, CASE WHEN depth >= 3 THEN 'depth' WHEN nofollow THEN 'nofollow' WHEN regexp_matches(url, '\.[^./]+$') AND NOT regexp_matches(url, '(?i)\.(html?|php|aspx?|jsp)$') THEN 'other' ELSE 'page' END AS reason FROM c)"""


def _step(spark, sf) -> DataFrame:
    p = html.with_page(read(spark, sf, "pages"), parts=("links",), keep=("page_id",))
    links = p.select("page_id", F.explode("page.links").alias("l")).select("page_id", "l.url", "l.rel")
    return crawl.step(links, scope.Scope(max_depth=3), F.col("page_id") % 4, meta_robots=F.when(F.col("page_id") % 5 == 0, "index, NoFollow"))


@register(f"WITH {_STEP_SQL} SELECT page_id, count(*) FILTER (reason = 'page') AS follow, count(*) FILTER (reason <> 'page') AS skipped FROM s GROUP BY 1")
def crawl_harvest(spark, sf):
    """What the links of each fetched page come to."""
    h = crawl.harvest(stored(_step(spark, sf)))
    return h.select("page_id", "follow", F.coalesce(F.aggregate(F.map_values("skipped"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("skipped"))


@register(f"WITH {_STEP_SQL} SELECT found_on, count(*) AS tasks FROM (SELECT url, min(page_id) AS found_on FROM s WHERE reason = 'page' GROUP BY 1) GROUP BY 1")
def crawl_fan_out(spark, sf):
    """Tasks that a crawl step starts, each address once over all pages, counted by the page that is credited."""
    return crawl.fan_out(stored(_step(spark, sf)), most=None).groupBy("found_on").agg(F.count(F.lit(1)).alias("tasks"))


@register("""SELECT user_id AS job, count(*) AS claimed, count(*) FILTER (event_id % 3 <> 0 OR user_id % 2 = 0) AS fetched, count(*) FILTER ((event_id % 3 <> 0 OR user_id % 2 = 0) AND event_type = 'error') AS failed, count(*) FILTER (NOT (event_id % 3 <> 0 OR user_id % 2 = 0)) AS "left",
CASE WHEN user_id % 7 = 0 THEN 'stopped' WHEN count(*) FILTER (NOT (event_id % 3 <> 0 OR user_id % 2 = 0)) = 0 THEN 'finished' WHEN count(*) >= 70 THEN 'at its budget' ELSE 'running' END AS state FROM events GROUP BY 1""")
def crawl_states(spark, sf):
    """Progress and state of each crawl."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("url"), "event_type")
    done = e.filter("url % 3 <> 0 or job % 2 = 0").withColumn("ok", F.col("event_type") != "error")
    stopped = e.select("job").distinct().filter("job % 7 = 0")
    return crawl.status(e, done, scope.Scope(max_pages=70), stopped=stopped)


@register("SELECT url, depth FROM (SELECT 'p' || l_partkey AS url, min(CAST(l_linenumber AS INTEGER)) AS depth FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1) ORDER BY depth, url LIMIT 100")
def frontier_claims(spark, sf):
    """New addresses, each at its smallest depth, as many as the budget has room for."""
    l = read(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("url"), F.col("l_linenumber").alias("depth"))
    seen = l.filter(F.expr("cast(substring(url, 2) as int) % 3 = 0")).select("url").distinct()
    return frontier.claim(l, seen, 100)


@register("""WITH RECURSIVE s AS (SELECT CAST(p_partkey AS BIGINT) AS src, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey - 1 AS BIGINT) END AS dst FROM part), r AS (SELECT src, dst AS target, 1 AS hops FROM s WHERE dst IS NOT NULL UNION ALL SELECT r.src, s.dst, r.hops + 1 FROM r JOIN s ON r.target = s.src WHERE s.dst IS NOT NULL AND r.hops < 10)
SELECT src, arg_max(target, hops) AS target, CAST(max(hops) AS INTEGER) AS hops FROM r GROUP BY 1""")
def redirect_chains(spark, sf):
    """Where chains of redirects end."""
    r = read(spark, sf, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("long").alias("src"), (F.col("p_partkey") - 1).cast("long").alias("dst"))
    return frontier.redirect_targets(r, 5)


@register(rf"SELECT page_id, regexp_matches(url, '^https?://[^/?#]') AS http, regexp_replace({_HOST}, '^www\.', '') = 'cheap-pills.example.com' AS same FROM pages")
def same_sites(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", urls.is_http(u).alias("http"), urls.same_site(u, F.lit("https://cheap-pills.example.com/x")).alias("same"))


@register("SELECT page_id, page_id % 2 = 0 AND contains(url, '/en/') AND NOT contains(url, '/en/7') AS extract FROM pages")
def post_fetch_decisions(spark, sf):
    """Whether a fetched resource is extracted, by patterns and by its kind."""
    rule = scope.Scope(collect=("pdf", "docx"), include=("/en/",), exclude=("/en/7",))
    kind = F.when(F.col("page_id") % 2 == 0, "document").otherwise("image")
    return read(spark, sf, "pages").select("page_id", scope.should_extract(kind, F.col("url"), rule).alias("extract"))


@register("WITH v AS (SELECT user_id, event_type AS reason, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, reason, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, reason) AS k FROM v) WHERE k <= 3")
def skip_reasons_by_job(spark, sf):
    return frontier.top_reasons(read(spark, sf, "events").select("user_id", F.col("event_type").alias("reason")), "user_id", 3)


@register("SELECT sha256(text) AS content_hash, any_value(text) IS NOT NULL AS kept FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0) GROUP BY text")
def raw_store_new(spark, sf):
    """Contents to append to a store of bytes by hash: one of each that it lacks."""
    d = read(spark, sf, "documents").withColumn("content_hash", T.content_hash(F.encode("text", "UTF-8")))
    return tables.missing(d.select("content_hash", "text"), d.filter("doc_id % 4 = 0").select("content_hash").distinct(), "content_hash").select("content_hash", F.col("text").isNotNull().alias("kept"))


@register("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 40")
def fallback_tail(spark, sf):
    """Records appended as JSON lines, one folder for each type, and the newest readable ones read back."""
    e, path = read(spark, sf, "events"), f"{shared_dir(spark)}/lines/{uuid.uuid4().hex}"
    lines = e.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_type") == "view", "note").otherwise("record").alias("record_type"))
    runs.append_lines(lines.filter("record_type = 'record'"), path, "record_type")
    runs.append_lines(lines.filter("record_type = 'note'").select("record_type", F.lit("no record").alias("note")), path, "record_type")
    return runs.tail(spark, path, "event_id long, user_id long, event_type string, at long", ["at", "event_id"], 40, "event_id").select("event_id", "user_id", "event_type")


# --- SQL of page queries: what the parser finds, by patterns that these pages allow ---

_NOISE = "script|style|nav|footer|header|form|aside|noscript"
_MAIN = rf"regexp_replace(regexp_replace(html, '(?s)<({_NOISE})\b.*?(</({_NOISE})>|$)', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_PLAIN = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"
_PIECES = r"array_to_string(list_filter(list_transform(regexp_split_to_array({}, '<[^>]*>'), lambda x: " + _PLAIN.format(r"regexp_replace(x, '^\s+|\s+$', '', 'g')") + r"), lambda x: x <> ''), chr(10))"
_TEXT_SQL = rf"""m AS (SELECT page_id, url, html, {_MAIN} AS main FROM pages),
a AS (SELECT page_id, url, html, main, {_PIECES.format("regexp_extract(main, '(?s)<article[^>]*>(.*?)(</article>|$)', 1)")} AS article, {_PIECES.format("regexp_extract(main, '(?s)<body[^>]*>(.*)$', 1)")} AS body FROM m),
t AS (SELECT page_id, url, html, main, CASE WHEN length(article) > 200 THEN article ELSE body END AS text FROM a),
c AS (SELECT *, trim(regexp_replace(replace(text, chr(10), ' '), '[\s]+', ' ', 'g')) AS flat, substr(trim(regexp_replace(replace(text, chr(10), ' '), '[\s]+', ' ', 'g')), 1, 280) AS head FROM t),
r AS (SELECT *, CASE WHEN flat = '' THEN NULL WHEN length(flat) <= 280 THEN flat ELSE CASE WHEN length(regexp_extract(head, '(?s)^(.*[.!?]) ', 1)) > 141 THEN regexp_extract(head, '(?s)^(.*[.!?]) ', 1) WHEN contains(head, ' ') THEN regexp_extract(head, '(?s)^(.*) ', 1) ELSE head END || '…' END AS preview FROM c)"""
_HEADING = _PLAIN.format("trim(regexp_replace({}, '<[^>]*>', '', 'g'))")
SQL["headings"] = rf"""SELECT page_id, CAST(regexp_extract(h, '^<h([1-3])', 1) AS INTEGER) AS level, {_HEADING.format('h')} AS text FROM (SELECT page_id, unnest(regexp_extract_all({_MAIN}, '(?s)<h[1-3][^>]*>.*?</h[1-3]>')) AS h FROM pages)"""
SQL["readable_text"] = f"WITH {_TEXT_SQL} SELECT page_id, text, preview FROM r"
SQL["page_records"] = rf"""WITH {_TEXT_SQL}, l AS (SELECT page_id, CAST(count(DISTINCT href) AS INTEGER) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages) GROUP BY 1),
f AS (SELECT *, nullif(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&amp;', '&'), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS language, nullif({_HEADING.format("regexp_extract(main, '(?s)<h1[^>]*>.*?</h1>', 0)")}, '') AS heading FROM r)
SELECT f.page_id, {_CANONICAL} AS canonical_url, regexp_replace({_HOST}, '^www\.', '') AS domain, 'html' AS kind, NULL::VARCHAR AS block, title, language, heading, coalesce(links, 0) AS links, CAST(0 AS INTEGER) AS tables, preview, sha256(html) AS content_hash, 'structured' AS method, CAST(1 AS INTEGER) AS tier,
round(((title IS NOT NULL)::INTEGER + (language IS NOT NULL)::INTEGER + (heading IS NOT NULL)::INTEGER) / 3.0::DOUBLE, 3) AS confidence FROM f LEFT JOIN l ON f.page_id = l.page_id"""
