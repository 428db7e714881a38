"""URL expressions: everything a plan needs of a URL stays a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind

# Query parameters that name a campaign or a session, compared with the lower-cased name.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format",
    "utm_marketing_tactic", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "fbclid", "msclkid", "twclid", "igshid", "ttclid", "yclid", "rb_clickid",
    "s_kwcid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hsCtaTracking", "vero_conv", "vero_id", "oly_anon_id", "oly_enc_id", "ref_src", "ref_url",
    "spm", "scm", "share_id", "mkt_tok", "trk", "trkCampaign", "sc_campaign", "sc_channel", "pk_campaign", "pk_kwd", "piwik_campaign",
    "matomo_campaign", "__s", "wickedid", "epik", "cmpid", "campaign_id",
]
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
METADATA_HOSTS = ["metadata.google.internal", "metadata.goog", "instance-data"]
#: Characters that a path keeps unescaped besides letters, digits and ``_.-*``.
PATH_KEEPS = "/:@!$&'()+,;=~"

_PARTS = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def host(url: Column) -> Column:
    """Lower-cased host without user and port; IPv6 literals without brackets."""
    netloc = F.regexp_replace(part(url, 2), r"^.*@", "")
    return F.lower(F.when(netloc.startswith("["), F.regexp_extract(netloc, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(netloc, r"^([^:]*)", 1)))


def registrable_host(url: Column) -> Column:
    """The host without a leading ``www.`` (no public-suffix list)."""
    return F.regexp_replace(host(url), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(part(url, 2)))


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def same_site(a: Column, b: Column) -> Column:
    return registrable_host(a) == registrable_host(b)


def filename(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)


def extension(url: Column) -> Column:
    """Lower-cased, of the last path segment; '' without a dot."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path(url), "/"), -1), r"\.([^.]*)$", 1))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def canonical_path(raw: Column) -> Column:
    """Escapes made uniform (so an escaped slash becomes a slash), index pages dropped."""
    c = F.replace(_decoded(F.replace(F.when(raw == "", F.lit("/")).otherwise(raw), F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for k in PATH_KEEPS:
        c = F.replace(c, F.lit(f"%{ord(k):02X}"), F.lit(k))
    c = F.regexp_replace(c, r"(?i)/(?:index|default)\.(?:html?|php|aspx?|jsp)$", "/")
    return bind(c, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def canonical_query(raw: Column, strip_tracking: bool = True, sort: bool = True) -> Column:
    """Pairs decoded, tracking dropped, sorted and encoded again."""
    pieces = F.filter(F.split(raw, "&"), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(_decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))
    if strip_tracking:
        pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING_PARAMS))
    if sort:
        pairs = F.array_sort(pairs)
    plus = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(plus(p["k"]), F.lit("="), plus(p["v"]))), "&")


def canonical(url: Column, strip_tracking: bool = True, strip_fragment: bool = True, sort_query: bool = True) -> Column:
    """A stable, comparable form: only changes that cannot name another resource."""
    s, netloc = scheme(url), part(url, 2)
    user = F.regexp_extract(netloc, r"^(.*@)", 1)
    hostport = F.regexp_replace(netloc, r"^.*@", "")
    name = F.regexp_replace(F.lower(F.when(hostport.startswith("["), F.regexp_extract(hostport, r"^(\[[^\]]*\])", 1)).otherwise(F.regexp_extract(hostport, r"^([^:]*)", 1))), r"\.+$", "")
    port = F.regexp_extract(hostport, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    default = F.lit("")
    for k, v in DEFAULT_PORTS.items():
        default = F.when(s == k, F.lit(v)).otherwise(default)
    shown = F.when((port == "") | (port == default), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    shown_query = bind(canonical_query(query(url), strip_tracking, sort_query), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    frag = F.lit("") if strip_fragment else part(url, 5)
    tail = F.concat(shown_query, F.when(frag == "", F.lit("")).otherwise(F.concat(F.lit("#"), frag)))
    whole = F.concat(F.when(s == "", F.lit("")).otherwise(F.concat(s, F.lit(":"))), F.when(netloc == "", F.lit("")).otherwise(F.concat(F.lit("//"), user, name, shown)), canonical_path(path(url)), tail)
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", F.lit("")).otherwise(whole)


def _mapped(name: Column) -> Column:
    """The dotted form of an IPv4 address that an IPv6 one holds (::ffff:a.b.c.d or two groups); other names as they are."""
    tail = F.regexp_extract(name, r"^(?:::|(?:0{1,4}:){5})ffff:([0-9a-f.:]+)$", 1)
    group = lambda k: F.conv(F.regexp_extract(tail, r"^([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).cast("int")
    byte = lambda k: [F.shiftright(group(k), 8).cast("string"), group(k).bitwiseAND(255).cast("string")]
    return F.when(tail.contains("."), tail).when(tail.rlike("^[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), F.concat_ws(".", *byte(1), *byte(2))).otherwise(name)


def is_private(name: Column) -> Column:
    """Loopback, private, link-local, reserved or metadata hosts (literal addresses; names are not resolved)."""
    return bind(_mapped(F.lower(name)), _private)


def _private(name: Column) -> Column:
    low = name
    quad = F.transform(F.split(name, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    four = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b, c = (F.try_element_at(quad, F.lit(k)) for k in (1, 2, 3))
    v4 = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    v6 = name.contains(":") & (low.isin("::", "::1") | low.rlike("^(?:f[cd]|fe[89ab]|ff|2001:db8:)"))
    return F.coalesce(name, F.lit("")).isin("", "localhost") | low.isin(METADATA_HOSTS) | low.endswith(".localhost") | (low == "localhost") | F.coalesce(four & v4, F.lit(False)) | v6


def _folded(full: Column) -> Column:
    """A path without its dot segments, however many there are."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    parts = F.split(full, "/")
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    return F.concat(F.array_join(kept, "/"), F.when(full.rlike(r"/\.\.?$"), "/").otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link on a page; dot segments are folded one by one."""
    h = F.trim(href)
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), r"[^/]*$", "")
    root = F.concat(scheme(base), F.lit("://"), part(base, 2))
    target = F.regexp_extract(h, r"^([^?#]*)", 1)
    rest = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    full = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    full = bind(full, lambda f: F.when(f.contains("/."), _folded(f)).otherwise(f))
    return (
        F.when(h == "", base)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), h))
        .when(h.startswith("?"), F.concat(root, path(base), h))
        .otherwise(F.concat(root, full, rest))
    )
