"""Registered queries of single rules over values made from the tables, with SQL that computes the rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blocks, detect, numbers, policy, scope, urls
from ..operators import html, ordered, runs, validate
from ..functions import text as T
from ..store import stored
from .queries import read, register

_HOST = r"lower(regexp_extract(url, '://([^/:?#]*)', 1))"
_CANONICAL = r"""regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&'), ''), '')"""
_MIXED = 2654435761  # spreads keys over 32 bits


def _spread(key: str):
    return F.pmod(F.col(key) * F.lit(_MIXED), F.lit(1 << 32))


# --- addresses ---------------------------------------------------------------

_RANGES = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3))


def _number(quad: str) -> int:
    a, b, c, d = map(int, quad.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


_INSIDE = " OR ".join(f"n BETWEEN {_number(a)} AND {_number(a) + (1 << (32 - bits)) - 1}" for a, bits in _RANGES)


@register(f"""SELECT event_id, ({_INSIDE}) AS private, ({_INSIDE}) AS mapped FROM (SELECT event_id, CASE WHEN value > 50 THEN x ELSE base + x % 1024 END AS n FROM
(SELECT event_id, value, (event_id * {_MIXED}) % 4294967296 AS x, list_extract([{', '.join(str(_number(a) - 512 if _number(a) else 0) for a, _ in _RANGES)}], CAST(user_id % {len(_RANGES)} + 1 AS INTEGER)) AS base FROM events))""")
def private_addresses(spark, sf):
    """Addresses over all of the number space and around the edges of reserved ranges, dotted and inside an IPv6 address."""
    edges = F.element_at(F.array(*[F.lit(_number(a) - 512 if _number(a) else 0) for a, _ in _RANGES]), (F.col("user_id") % len(_RANGES) + 1).cast("int"))
    x = _spread("event_id")
    n = F.when(F.col("value") > 50, x).otherwise(edges + x % 1024)
    byte = lambda k: F.shiftright(F.col("n"), k).bitwiseAND(255).cast("string")
    e = stored(read(spark, sf, "events").select("event_id", n.alias("n")).select("event_id", F.concat_ws(".", *[byte(k) for k in (24, 16, 8, 0)]).alias("quad"), F.lower(F.concat(F.lit("::ffff:"), F.hex(F.shiftright("n", 16)), F.lit(":"), F.hex(F.col("n").bitwiseAND(65535)))).alias("mapped")))
    return e.select("event_id", urls.is_private(F.col("quad")).alias("private"), urls.is_private(F.col("mapped")).alias("mapped"))


@register(f"""SELECT page_id, k, CASE WHEN k < len(parts) THEN origin || '/' || array_to_string(parts[1:len(parts) - k] || [word, 'z.html'], '/') ELSE origin || '/' || word || '/z.html' END || '?q=' || page_id AS url FROM
(SELECT page_id, page_id % 5 AS k, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS word,
list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1), '/'), lambda x: x <> '') AS parts FROM pages)""")
def resolved_links(spark, sf):
    """Links of pages that climb some folders and go down again, resolved against the pages' addresses."""
    word = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    href = F.concat(F.lit("./"), F.repeat(F.lit("../"), (F.col("page_id") % 5).cast("int")), word, F.lit("/x/../z.html?q="), F.col("page_id").cast("string"))
    return read(spark, sf, "pages").select("page_id", (F.col("page_id") % 5).alias("k"), urls.resolve(F.col("url"), href).alias("url"))


@register(f"SELECT page_id, {_CANONICAL} AS url FROM pages")
def canonical_forms(spark, sf):
    """Addresses of pages with their letters, ports, parameters and fragments written otherwise; all have the canonical form of the plain one."""
    scheme, host, rest = (F.regexp_extract("url", r"^([a-z]+)://([^/?#]*)([^#]*)", k) for k in (1, 2, 3))
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    port = F.when(scheme == "https", ":443").otherwise(":80")
    more = F.concat(F.lit("utm_medium=x&"), F.when(query == "", "").otherwise(F.concat(query, F.lit("&"))), F.lit("fbclid="), F.col("page_id").cast("string"))
    lettered = F.regexp_replace(path, "e", "%65")
    written = F.concat(F.upper(scheme), F.lit("://"), F.initcap(host), F.when(F.col("page_id") % 2 == 0, port).otherwise("."), F.when(F.col("page_id") % 3 == 0, lettered).otherwise(path), F.lit("?"), more, F.lit("#part"))
    return read(spark, sf, "pages").select("page_id", urls.canonical(written).alias("url"))


@register(rf"""SELECT page_id, coalesce(CASE WHEN len(seg) > 12 THEN 'path is implausibly deep'
WHEN (len(seg) >= 3 AND seg[-1] = seg[-2] AND seg[-2] = seg[-3]) OR (len(seg) >= 6 AND seg[-2:] = seg[-4:-3] AND seg[-4:-3] = seg[-6:-5]) OR (len(seg) >= 9 AND seg[-3:] = seg[-6:-4] AND seg[-6:-4] = seg[-9:-7]) THEN 'repeated path segments'
WHEN params > 6 THEN 'too many query parameters' WHEN chars > 2000 THEN 'URL is implausibly long' END, '') AS trap FROM
(SELECT page_id, list_filter(string_split(host || '/' || repeat(w || '/', CAST(page_id % 16 AS INTEGER)) || repeat(v || '/' || w || '/', CAST(length(html) % 5 AS INTEGER)) || v, '/'), lambda x: x <> '')[2:] AS seg, length(html) % 10 AS params,
length('https://' || host || '/') + (page_id % 16) * (length(w) + 1) + (length(html) % 5) * (length(v) + length(w) + 2) + length(v) + 1 + coalesce(list_sum(list_transform(range(length(html) % 10), lambda i: 3 + length(CAST(i AS VARCHAR)))), 0) + greatest(length(html) % 10 - 1, 0) + CASE WHEN page_id % 7 = 0 THEN 2000 ELSE 0 END AS chars
FROM (SELECT page_id, html, {_HOST} AS host, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS w, regexp_extract(url, '://([a-zA-Z]+)', 1) AS v FROM pages))""")
def trap_shapes(spark, sf):
    """Addresses made of words of pages: deep ones, repeated segments, many parameters, long ones."""
    w, v, n = F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.regexp_extract("url", "://([a-zA-Z]+)", 1), F.length("html")
    path = F.concat(F.repeat(F.concat(w, F.lit("/")), (F.col("page_id") % 16).cast("int")), F.repeat(F.concat(v, F.lit("/"), w, F.lit("/")), (n % 5).cast("int")), v)
    names = F.filter(F.sequence(F.lit(0), (n % 10).cast("int")), lambda i: i < n % 10)
    query = F.array_join(F.transform(names, lambda i: F.concat(F.lit("k"), i.cast("string"), F.lit("=1"))), "&")
    u = F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/"), path, F.lit("?"), query, F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("#"), F.repeat(F.lit("z"), 1999))).otherwise(""))
    return read(spark, sf, "pages").select("page_id", F.coalesce(scope.trap(u), F.lit("")).alias("trap"))


_MEDIA_SQL = "|".join(d.replace(".", r"\.") for d in detect.MEDIA_DOMAINS)
_ENDS = list(detect.EXTENSIONS)


@register(rf"""SELECT event_id, CASE WHEN ext IN ('m3u8', 'mpd') THEN 'livestream' WHEN regexp_matches(host, '(^|\.)({_MEDIA_SQL})$') THEN 'ytdlp' ELSE 'http' END AS route,
CASE WHEN ext IN ('m3u8', 'mpd') OR regexp_matches(host, '(^|\.)({_MEDIA_SQL})$') OR value > 90 THEN 'media' ELSE 'web' END AS split,
CASE {' '.join(f"WHEN ext = '{x}' THEN '{k}'" for x, (k, _) in detect.EXTENSIONS.items())} ELSE 'unknown' END AS kind FROM
(SELECT event_id, value, list_extract([{', '.join(f"'{d}'" for d in detect.MEDIA_DOMAINS)}], CAST(user_id % {len(detect.MEDIA_DOMAINS)} + 1 AS INTEGER)) AS d, CASE WHEN value < 20 THEN list_extract([{', '.join(f"'{x}'" for x in _ENDS)}], CAST(event_id % {len(_ENDS)} + 1 AS INTEGER)) ELSE 'x' || (event_id % 7) END AS ext,
CASE event_type WHEN 'view' THEN 'm.' WHEN 'click' THEN 'not' WHEN 'error' THEN 'www.' ELSE '' END || list_extract([{', '.join(f"'{d}'" for d in detect.MEDIA_DOMAINS)}], CAST(user_id % {len(detect.MEDIA_DOMAINS)} + 1 AS INTEGER)) || CASE WHEN event_type = 'signup' THEN '.example' ELSE '' END AS host FROM events)""")
def url_routes(spark, sf):
    """How an address is acquired, what its extension hints at, and the older two-way split: hosts like those of platforms, every known extension and others."""
    k = F.col("event_type")
    host = F.concat(F.when(k == "view", "m.").when(k == "click", "not").when(k == "error", "www.").otherwise(""), F.element_at(F.array(*[F.lit(d) for d in detect.MEDIA_DOMAINS]), (F.col("user_id") % len(detect.MEDIA_DOMAINS) + 1).cast("int")), F.when(k == "signup", ".example").otherwise(""))
    end = F.when(F.col("value") < 20, F.element_at(F.array(*[F.lit(x) for x in _ENDS]), (F.col("event_id") % len(_ENDS) + 1).cast("int"))).otherwise(F.concat(F.lit("x"), (F.col("event_id") % 7).cast("string")))
    e = stored(read(spark, sf, "events").select("event_id", F.concat(F.lit("https://"), host, F.lit("/a/b."), F.when(F.col("event_id") % 2 == 0, F.upper(end)).otherwise(end), F.lit("?v=1")).alias("u"), F.when(F.col("value") > 90, F.lit("Video/mp4")).alias("head")))
    return e.select("event_id", detect.pre_route(F.col("u")).alias("route"), detect.detect(url=F.col("u"))["kind"].alias("kind"), policy.web_or_media(F.col("u"), F.col("head")).alias("split"))


# --- responses ---------------------------------------------------------------


@register(f"""SELECT event_id, CASE WHEN s = 304 THEN 'unchanged' WHEN s >= 500 OR s IN ({', '.join(map(str, sorted(blocks.RETRYABLE)))}) THEN 'retry' WHEN s >= 400 THEN 'fail' ELSE 'ok' END AS class,
coalesce(CASE WHEN (s >= 500 OR s IN ({', '.join(map(str, sorted(blocks.RETRYABLE)))})) AND a < 3 THEN pow(2.0::DOUBLE, a - 1) END, -1) AS wait FROM (SELECT event_id, CAST(200 + floor(value * 37) % 400 AS INTEGER) AS s, 1 + user_id % 4 AS a FROM events)""")
def status_classes(spark, sf):
    """What each status from 200 to 599 means, and how long to wait before the next of three tries."""
    status, attempt = (F.lit(200) + F.floor(F.col("value") * 37) % 400).cast("int"), 1 + F.col("user_id") % 4
    e = stored(read(spark, sf, "events").select("event_id", status.alias("s"), attempt.alias("a")))
    c = blocks.status_class(F.col("s"))
    return e.select("event_id", c.alias("class"), F.coalesce(F.when(c == "retry", policy.retry_wait(F.col("a"))), F.lit(-1.0)).alias("wait"))


@register(rf"""WITH v AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_replace(html, '(?s)<body.*$', '') || '<body><div id="root">' END AS shell, html, length(html) AS n, page_id % 4 AS k FROM pages),
b AS (SELECT page_id, n, k, CASE WHEN k < 2 THEN html ELSE shell END AS body FROM v),
w AS (SELECT *, octet_length(encode(trim(regexp_replace(regexp_replace(body, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS visible FROM b)
SELECT page_id, CASE WHEN s IN ({', '.join(map(str, policy.BROWSER_STATUS))}) THEN true WHEN s <> 200 THEN false WHEN body = '' THEN true WHEN n % 5 = 0 THEN false
ELSE visible < {blocks.SHELL_BYTES} AND (contains(lower(body), 'id="root"') OR octet_length(encode(body)) > 2048) END AS render FROM (SELECT *, CASE WHEN n % 7 < 4 THEN 200 ELSE 398 + n % 7 END AS s FROM w)""")
def render_decisions(spark, sf):
    """Whether a browser is worth it for pages as they are, cut down to the shell of an application, or empty, under several statuses and types."""
    n, shell = F.length("html"), F.concat(F.regexp_replace("html", "(?s)<body.*$", ""), F.lit('<body><div id="root">'))
    body = F.when(F.col("page_id") % 4 < 2, F.col("html")).when(F.col("page_id") % 3 == 0, "").otherwise(shell)
    p = stored(read(spark, sf, "pages").select("page_id", F.when(n % 7 < 4, 200).otherwise(398 + n % 7).alias("s"), body.alias("body"), F.when(n % 5 == 0, "application/json").otherwise("text/html; charset=utf-8").alias("kind")))
    return p.select("page_id", policy.needs_render(F.col("s"), F.col("body"), F.col("kind")).alias("render"))


_LEFT, _LIMIT, _RESET = "floor(value)", "(10 + user_id)", "(event_id % 900 + 1)"


@register(f"""SELECT event_id, coalesce(gap, -1) AS gap, greatest(1.0::DOUBLE, coalesce(gap, 0)) AS kept, CASE WHEN event_id % 3 = 0 THEN -1.0::DOUBLE ELSE least(floor(value * 100), 3600) END AS wait FROM
(SELECT event_id, value, CASE WHEN {_LEFT} <= {_LIMIT} * 0.1::DOUBLE THEN least({_RESET} / greatest({_LEFT}, 1), 60.0::DOUBLE) END AS gap FROM events)""")
def server_feedback(spark, sf):
    """Waits and gaps that responses ask for: quotas, limits and resets of all sizes, in both spellings and both ways to tell a time."""
    e = read(spark, sf, "events")
    left, limit, reset = F.floor("value"), 10 + F.col("user_id"), F.col("event_id") % 900 + 1
    shown = F.when(F.col("event_id") % 2 == 0, reset).otherwise(reset + 1_700_000_000)
    name = lambda x: F.concat(F.when(F.col("user_id") % 2 == 0, "x-").otherwise(""), F.lit(f"ratelimit-{x}"))
    headers = F.create_map(name("remaining"), left.cast("string"), name("limit"), limit.cast("string"), name("reset"), shown.cast("string"))
    after = F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.floor(F.col("value") * 100).cast("string"))
    e = stored(e.select("event_id", headers.alias("h"), after.alias("after")))
    gap = policy.rate_gap(F.col("h"), F.lit(1_700_000_000.0))
    return e.select("event_id", F.coalesce(gap, F.lit(-1.0)).alias("gap"), policy.slowest(gap, F.lit(1.0)).alias("kept"), F.coalesce(ordered.retry_after(F.col("after"), F.lit("2024-01-01").cast("timestamp")), F.lit(-1.0)).alias("wait"))


_MIMES = [p for p, _, _ in detect.CONTENT_TYPES] + ["application/octet-stream", "x/y", "text/htm"]
_MIME_LIST = ", ".join(f"'{p}'" for p in _MIMES)


@register(f"""SELECT event_id, kind, CASE WHEN kind = 'unknown' THEN 'low-confidence type detection: unknown' ELSE '' END AS warning, CASE WHEN kind = 'unknown' THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM
(SELECT event_id, CASE {' '.join(f"WHEN starts_with(mime, '{p}') THEN '{k}'" for p, k, _ in detect.CONTENT_TYPES)} ELSE 'unknown' END AS kind FROM
(SELECT event_id, CASE WHEN user_id % 6 = 0 THEN event_type ELSE '' END || list_extract([{_MIME_LIST}], CAST(event_id % {len(_MIMES)} + 1 AS INTEGER)) || event_type AS mime FROM events))""")
def declared_types(spark, sf):
    """Kinds by declared type alone, every known beginning with what may follow or precede it, routed with a warning where the evidence is thin."""
    mime = F.element_at(F.array(*[F.lit(p) for p in _MIMES]), (F.col("event_id") % len(_MIMES) + 1).cast("int"))
    mime = F.concat(F.when(F.col("user_id") % 6 == 0, F.col("event_type")).otherwise(""), F.when(F.col("value") > 50, F.upper(mime)).otherwise(mime), F.col("event_type"), F.when(F.col("value") > 20, "; charset=utf-8").otherwise(" "))
    e = stored(read(spark, sf, "events").select("event_id", mime.alias("mime")))
    return e.select("event_id", policy.route(detect.detect(content_type=F.col("mime"))).alias("r")).select("event_id", "r.kind", F.coalesce("r.warning", F.lit("")).alias("warning"), "r.confidence")


_SIGNED = sorted((s for s in detect.SIGNATURES if s[0] == 0), key=lambda s: -len(s[1]))
_SIGNED_LIST = ", ".join(f"'{sig.hex().upper()}'" for _, sig, _, _ in _SIGNED)


@register(f"""SELECT event_id, CASE {' '.join(f"WHEN starts_with(raw, '{sig.hex().upper()}') THEN '{k} {t}'" for _, sig, k, t in _SIGNED)} ELSE 'unknown unknown' END AS kind FROM
(SELECT event_id, CASE WHEN value > 90 THEN '00' ELSE '' END || list_extract([{_SIGNED_LIST}], CAST(event_id % {len(_SIGNED)} + 1 AS INTEGER)) || hex(encode(props)) AS raw FROM events)""")
def magic_bytes(spark, sf):
    """Kinds of blobs that begin with each of the known signatures, or hold one a byte later."""
    raw = F.concat(F.when(F.col("value") > 90, "00").otherwise(""), F.element_at(F.array(*[F.lit(sig.hex().upper()) for _, sig, _, _ in _SIGNED]), (F.col("event_id") % len(_SIGNED) + 1).cast("int")), F.hex(F.encode("props", "UTF-8")))
    e = stored(read(spark, sf, "events").select("event_id", F.unhex(raw).alias("raw")))
    return e.select("event_id", detect.detect(raw=F.col("raw")).alias("d")).select("event_id", F.concat_ws(" ", "d.kind", "d.subtype").alias("kind"))


# --- fields and rules --------------------------------------------------------


@register("""SELECT page_id, n BETWEEN 1 AND 300 AND NOT regexp_matches(s, '(?i):(?:contains|eq|first|last|gt|lt|has|visible|hidden|parent|header|input|nth-)|\\.(?:css|sc|jsx|emotion)-[\\w-]{5,}|\\.[A-Za-z_-]*[0-9a-f]{6,}') AS sane FROM
(SELECT page_id, s, length(trim(s)) AS n FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'div.' || w WHEN 1 THEN '.' || w || '-' || substr(md5(w), 1, CAST(length(html) % 9 AS INTEGER)) WHEN 2 THEN 'li:' || w WHEN 3 THEN repeat('p > ', CAST(length(html) % 120 AS INTEGER)) || w WHEN 4 THEN '.css-' || w ELSE 'a[' || w || ']:nth-' || w END AS s
FROM (SELECT page_id, html, lower(regexp_extract(html, '<title>[^A-Za-z<]*([A-Za-z]*)', 1)) AS w FROM pages)))""")
def selector_sanity(spark, sf):
    """Selectors made of words of pages' titles and hashes of them: short and long, stable and generated."""
    w, n = F.lower(F.regexp_extract("html", "<title>[^A-Za-z<]*([A-Za-z]*)", 1)), F.length("html")
    p = stored(read(spark, sf, "pages").select("page_id", w.alias("w"), n.alias("n")))
    w, k = F.col("w"), F.col("page_id") % 6
    s = F.when(k == 0, F.concat(F.lit("div."), w)).when(k == 1, F.concat(F.lit("."), w, F.lit("-"), F.substring(F.md5(F.encode("w", "UTF-8")), F.lit(1), (F.col("n") % 9).cast("int")))).when(k == 2, F.concat(F.lit("li:"), w)).when(k == 3, F.concat(F.repeat(F.lit("p > "), (F.col("n") % 120).cast("int")), w)).when(k == 4, F.concat(F.lit(".css-"), w)).otherwise(F.concat(F.lit("a["), w, F.lit("]:nth-"), w))
    return p.select("page_id", html.selector_is_sane(s).alias("sane"))


@register("""SELECT l_orderkey, l_linenumber, regexp_matches(c, '^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)? *$') AS number FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN l_returnflag WHEN l_linenumber % 4 = 1 THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR)
WHEN l_linenumber % 4 = 2 THEN ' -' || CAST(l_orderkey AS VARCHAR) || 'e' || (l_linenumber % 3) ELSE CAST(l_orderkey AS VARCHAR) || CASE WHEN l_orderkey % 2 = 0 THEN ' pcs' ELSE '.' || l_partkey END END AS c FROM lineitem)""")
def numeric_cells(spark, sf):
    """Cells of order lines as tables show them: amounts with thousands, powers of ten, units, words."""
    k, key = F.col("l_linenumber") % 4, F.col("l_orderkey").cast("string")
    cell = F.when(k == 0, F.col("l_returnflag")).when(k == 1, F.format_number(F.col("l_extendedprice").cast("long"), 0)).when(k == 2, F.concat(F.lit(" -"), key, F.lit("e"), (F.col("l_linenumber") % 3).cast("string"))).otherwise(F.concat(key, F.when(F.col("l_orderkey") % 2 == 0, " pcs").otherwise(F.concat(F.lit("."), F.col("l_partkey").cast("string")))))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(numbers.is_numeric_cell(cell), F.lit(False)).alias("number"))


@register("""SELECT user_id, uses, stale FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') AS uses, count(*) FILTER (event_type <> 'error') >= 5 AND avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.4 OR date_diff('day', max(ts)::DATE, DATE '2024-02-28') > 30 OR bool_or(event_type = 'error' AND value > 99) AS stale FROM events GROUP BY 1)""")
def stale_specs(spark, sf):
    """Which keys of the events would be given up: retired, badly served or long not used."""
    e = read(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("uses"), F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)).alias("fill"), F.max("ts").alias("last"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 99)).alias("retired"))
    idle = F.datediff(F.lit("2024-02-28").cast("date"), F.col("last").cast("date"))
    return e.select("user_id", "uses", ordered.is_stale(F.col("uses"), F.col("fill"), idle, F.col("retired")).alias("stale"))


@register(rf"""SELECT page_id, NOT regexp_matches(u, '^(https?://|data:|//)') AS bad_url, NOT regexp_matches(m, '^[^@\s]+@[^@\s]+\.[A-Za-z]{{2,}}$') AS bad_email FROM
(SELECT page_id, CASE WHEN length(html) % 3 = 0 THEN regexp_replace(url, '^[a-z]+:', '') WHEN length(html) % 3 = 1 THEN regexp_replace(url, '^[a-z]+://', '') ELSE url END AS u, CASE WHEN length(html) % 2 = 0 THEN w || '@' ELSE w || CASE WHEN page_id % 4 = 0 THEN '@x@' ELSE '' END END || CASE WHEN page_id % 5 = 0 THEN w ELSE {_HOST} END AS m
FROM (SELECT *, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS w FROM pages))""")
def shape_rules(spark, sf):
    """Addresses of pages with and without their schemes, mails made of their hosts and words."""
    w, n = F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.length("html")
    u = F.when(n % 3 == 0, F.regexp_replace("url", "^[a-z]+:", "")).when(n % 3 == 1, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(F.col("url"))
    m = F.concat(F.when(n % 2 == 0, F.concat(w, F.lit("@"))).otherwise(F.concat(w, F.when(F.col("page_id") % 4 == 0, "@x@").otherwise(""))), F.when(F.col("page_id") % 5 == 0, w).otherwise(urls.host(F.col("url"))))
    v = validate.validate(stored(read(spark, sf, "pages").select("page_id", u.alias("url"), m.alias("email"))), ["url", "email"])
    return v.select("page_id", F.array_contains("warnings", "url:url_shape").alias("bad_url"), F.array_contains("warnings", "email:email_shape").alias("bad_email"))


@register("SELECT o_orderkey, o_orderdate > CAST(d + INTERVAL 12 MONTH AS DATE) AS future FROM orders, (SELECT TIMESTAMP '1996-06-01' AS d)")
def future_dates(spark, sf):
    """Dates of orders, written in words, more than a year after a day among them."""
    o = stored(read(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "d MMMM yyyy").alias("date")))
    v = validate.validate(o, ["date"], as_of=F.lit("1996-06-01 00:00:00").cast("timestamp"))
    return v.select("o_orderkey", F.array_contains("warnings", "date:future_date").alias("future"))


@register(rf"""SELECT page_id, url, sha256(html) AS content_hash, CASE WHEN contains(html, '<p>') THEN 'html' ELSE 'bare' END AS kind, round(length(html) / 100000.0::DOUBLE, 3) AS confidence, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS children FROM pages""")
def item_summaries(spark, sf):
    """What may leave the engine of an item, its links as children, and the provenance that travels with it."""
    p = read(spark, sf, "pages").select("page_id", "url", T.content_hash(F.encode("html", "UTF-8")).alias("content_hash"), F.when(F.col("html").contains("<p>"), "html").otherwise("bare").alias("kind"), (F.length("html") / 100_000).alias("confidence"), F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1).alias("members"))
    s = runs.summary(stored(p).withColumn("provenance", runs.provenance({"source_url": F.col("url"), "content_hash": F.col("content_hash"), "kind": F.col("kind")})), ["page_id", "provenance", "confidence"], "members")
    return s.select("page_id", F.col("provenance.source_url").alias("url"), "provenance.content_hash", "provenance.kind", "confidence", "children")
