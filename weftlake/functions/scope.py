"""What a crawl does with a link, as one expression: follow, collect or skip, and why."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Page furniture; extensions by kind; parameters that make new URLs of one page.
JUNK = ["css", "js", "mjs", "map", "ico", "woff", "woff2", "ttf", "eot", "otf", "svg", "webmanifest", "xsl", "rss"]
KINDS = {
    "document": ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "epub", "rtf"],
    "tabular": ["csv", "tsv"],
    "data": ["json", "xml", "yaml"],
    "archive": ["zip", "tar", "gz", "7z", "bz2"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "tiff"],
    "audio": ["mp3", "wav", "m4a"],
    "video": ["mp4", "mov", "webm"],
    "email": ["eml"],
    "html": ["html", "htm", "php", "asp", "aspx", "jsp"],
}
TRAP_PARAMS = [
    "sessionid", "sid", "phpsessid", "jsessionid", "sort", "order", "orderby", "view", "display", "print", "share", "replytocom", "page_id_filter",
]
CALENDAR = r"(?i)/\d{4}/\d{1,2}(?:/\d{1,2})?/?$|[?&](?:year|month|day|week)=\d+"


@dataclass(frozen=True)
class Scope:
    """The rules of one crawl.  Without collected extensions every page in scope is collected."""

    start_url: str = ""
    hosts: tuple[str, ...] = ()
    max_depth: int = 2
    max_pages: int = 500
    collect: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    follow_html: bool = True
    respect_nofollow: bool = True
    detect_traps: bool = True

    def kinds(self) -> set[str]:
        """Kinds to extract; empty: all."""
        return {k for k, x in KINDS.items() if set(x) & set(self.collect)}


def _any(url: Column, patterns: Sequence[str]) -> Column:
    return url.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def trap(url: Column) -> Column:
    """The shape of a URL that a crawl must not follow, or null."""
    segments = F.filter(F.split(urls.path(url), "/"), lambda s: s != "")
    n = F.size(segments)
    part = lambda k, size: F.slice(segments, F.greatest(F.lit(1), n - k * size + 1), F.lit(size))
    repeated = F.lit(False)
    for size in (1, 2, 3):
        repeated = repeated | ((n >= 3 * size) & (part(1, size) == part(2, size)) & (part(2, size) == part(3, size)))
    names = F.transform(F.filter(F.split(urls.query(url), "&"), lambda p: p != ""), lambda p: F.regexp_extract(p, r"^([^=]*)", 1))
    bad = F.get(F.filter(names, lambda k: F.lower(k).isin(TRAP_PARAMS)), F.lit(0))
    return (
        F.when(n > 12, F.lit("path is implausibly deep"))
        .when(repeated, F.lit("repeated path segments"))
        .when(url.rlike(CALENDAR), F.lit("calendar-style URL"))
        .when(F.size(names) > 6, F.lit("too many query parameters"))
        .when(bad.isNotNull(), F.concat(F.lit("session or view parameter ("), bad, F.lit(")")))
        .when(F.length(url) > 2000, F.lit("URL is implausibly long"))
    )


def classify(url: Column, depth: Column, scope: Scope, nofollow: Column | None = None, hosts: Column | None = None) -> Column:
    """STRUCT<verdict,reason>; ``hosts``: an ARRAY of allowed hosts by row, instead of the scope's."""
    verdict = lambda v, r: F.struct(F.lit(v).alias("verdict"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    host, ext = urls.registrable_host(url), urls.extension(url)
    inside = _any(url, scope.include) if scope.include else F.lit(True)
    out = F.when(F.coalesce(~F.lower(url).rlike("^https?://"), F.lit(True)), verdict("skip", "not an http(s) URL"))
    if hosts is not None or scope.hosts:
        allowed = F.array_contains(hosts, host) if hosts is not None else host.isin(*scope.hosts)
        out = out.when(~allowed, verdict("skip", F.concat(F.lit("off-site ("), host, F.lit(")"))))
    out = out.when(ext.isin(JUNK), verdict("skip", F.concat(F.lit("page furniture (."), ext, F.lit(")"))))
    if scope.exclude:
        out = out.when(_any(url, scope.exclude), verdict("skip", "matched an exclude pattern"))
    if scope.detect_traps:
        out = out.when(trap(url).isNotNull(), verdict("skip", F.concat(F.lit("crawl trap: "), trap(url))))
    if scope.collect:
        target = ext.isin(*scope.collect)
        out = out.when(target & ~inside, verdict("skip", "did not match an include pattern"))
        out = out.when(target, verdict("collect", F.concat(F.lit("target file (."), ext, F.lit(")"))))
    out = out.when(depth >= scope.max_depth, verdict("skip", f"at the depth limit ({scope.max_depth})"))
    if nofollow is not None and scope.respect_nofollow:
        out = out.when(nofollow, verdict("skip", "rel=nofollow"))
    if not scope.follow_html:
        return out.otherwise(verdict("skip", "not following pages"))
    out = out.when((ext != "") & ~ext.isin(KINDS["html"]), verdict("skip", F.concat(F.lit("not a target and not a page (."), ext, F.lit(")"))))
    return out.when(~inside, verdict("follow", "page (outside include, followed for links)")).otherwise(verdict("follow", "page"))


def should_extract(kind: Column, url: Column, scope: Scope) -> Column:
    """Whether a fetched resource is extracted, once its kind is known."""
    out = F.lit(True)
    if scope.exclude:
        out = out & ~_any(url, scope.exclude)
    if scope.include:
        out = out & _any(url, scope.include)
    return out & kind.isin(*scope.kinds()) if scope.kinds() else out
