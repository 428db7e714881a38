"""Crawls as table steps: seeds, what a fetched page gives, plans and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope as scopes
from ..functions import urls
from ..sources import handlers
from ..store import stored

# Fixed value: links that a step of a bounded crawl follows, for ``most``.
MAX_FOLLOW = 200


def seeds(starts: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """url, from_robots of crawls ``starts(url)``: start addresses and sitemaps that their sites' robots files name, canonical and once each.

    ``robots(origin, body)``.
    """
    own = starts.select(urls.canonical(F.col("url")).alias("url"), F.lit(0).alias("_k"))
    if robots is not None:
        named = starts.select(urls.origin(F.col("url")).alias("origin")).distinct().join(robots, "origin").select(F.explode(handlers.robots_sitemaps(F.col("body"))).alias("s"))
        own = own.unionByName(named.select(urls.canonical(F.col("s")).alias("url"), F.lit(1).alias("_k")))
    return own.filter("url <> ''").groupBy("url").agg(F.min("_k").alias("_k")).select("url", (F.col("_k") == 1).alias("from_robots"))


def sitemap_pages(starts: DataFrame, bodies: DataFrame, levels: int | None = None) -> DataFrame:
    """loc, sitemap, level: addresses of pages that sitemaps list, through indexes of sitemaps.

    ``starts(url)`` are sitemaps to begin with, ``bodies(url, body)`` the stored
    ones, one row an address.  A round reads what the one before named; each
    sitemap is read once, at its smallest level, so indexes that name each other
    end.  With ``levels``, deeper sitemaps are left unread and come back
    themselves, with a null ``loc``; so do those that are not stored.
    """
    once = starts.select("url").distinct()
    wave, rounds, found, level = stored(once), [], [], 0
    while wave.limit(1).count():
        rounds.append(wave)
        here = wave.join(bodies, "url", "left")
        if levels is not None and level > levels:
            here = here.withColumn("body", F.lit(None).cast("string"))
        rows = stored(handlers.sitemap_urls(here.filter("body is not null"), "url", "body").select(F.col("url").alias("sitemap"), "loc"))
        index = here.select("url", F.lower(F.col("body")).contains("<sitemapindex").alias("index"))
        rows = rows.join(index.select(F.col("url").alias("sitemap"), "index"), "sitemap")
        found.append(rows.filter("not index").select("loc", "sitemap", F.lit(level).alias("level")))
        found.append(here.filter("body is null").select(F.lit(None).cast("string").alias("loc"), F.col("url").alias("sitemap"), F.lit(level).alias("level")))
        read_ = rounds[0]
        for r in rounds[1:]:
            read_ = read_.unionByName(r)
        wave = stored(rows.filter("index").select(F.col("loc").alias("url")).distinct().join(read_, "url", "left_anti"))
        level += 1
    out = found[0] if found else once.select(F.col("url").alias("loc"), F.col("url").alias("sitemap"), F.lit(0).alias("level")).limit(0)
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def in_scope(entries: DataFrame, scope: scopes.Scope, url: str = "url") -> DataFrame:
    """Entries of sitemaps and feeds that a crawl may take, as if found at depth 0."""
    c = urls.canonical(F.col(url))
    return entries.withColumn(url, c).filter((F.col(url) != "") & (scopes.classify(F.col(url), F.lit(0), scope)["verdict"] != "skip"))


def step(links: DataFrame, scope: scopes.Scope, depth: Column, page: str = "page_id", meta_robots: Column | None = None) -> DataFrame:
    """page, url, verdict, reason of the links(page, url, rel) of fetched pages, each canonical address once a page.

    ``meta_robots``: a page's own directive; nofollow or none holds for all of its links.
    """
    rows = links.select(page, urls.canonical(F.col("url")).alias("url"), F.coalesce(F.col("rel"), F.lit("")).alias("rel"), depth.alias("_depth"), (F.coalesce(F.lower(meta_robots), F.lit("")) if meta_robots is not None else F.lit("")).alias("_meta"))
    once = rows.filter("url <> ''").groupBy(page, "url").agg(F.min(F.struct(F.col("rel").contains("nofollow").alias("rel"), "_depth", "_meta")).alias("m"))
    nofollow = F.col("m.rel") | F.col("m._meta").contains("nofollow") | F.col("m._meta").contains("none")
    d = scopes.classify(F.col("url"), F.col("m._depth"), scope, nofollow=nofollow)
    return once.select(page, "url", d.alias("d")).select(page, "url", "d.verdict", "d.reason")


def harvest(steps: DataFrame, page: str = "page_id") -> DataFrame:
    """Per page: how many links to follow, to collect and skipped, and why."""
    reasons = steps.filter("verdict = 'skip'").groupBy(page, "reason").agg(F.count(F.lit(1)).alias("n")).groupBy(page).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("skipped"))
    counts = steps.groupBy(page).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("follow", "collect")])
    return counts.join(reasons, page, "left")


def fan_out(steps: DataFrame, page: str = "page_id", most: int | None = None) -> DataFrame:
    """Tasks that a step starts: an address to crawl or to collect, once over all pages, from the page with the smallest key.

    ``most``: of each page and verdict, in order of addresses; all of them by default.  ``dropped`` tells how many a page left out.
    """
    wanted = steps.filter("verdict <> 'skip'")
    if most is not None:
        by = Window.partitionBy(page, "verdict")
        wanted = wanted.withColumn("_k", F.row_number().over(by.orderBy("url"))).withColumn("dropped", F.greatest(F.lit(0), F.count(F.lit(1)).over(by) - most)).filter(F.col("_k") <= most)
    else:
        wanted = wanted.withColumn("dropped", F.lit(0).cast("long"))
    return wanted.groupBy("url", F.when(F.col("verdict") == "follow", "crawl").otherwise("collect").alias("task")).agg(F.min(page).alias("found_on"), F.sum("dropped").alias("dropped"))


def describe(scope: scopes.Scope) -> str:
    """One line on what a crawl will do."""
    what = "files: " + ", ".join(f".{x}" for x in scope.collect) if scope.collect else "every page in scope"
    where = ", ".join(scope.hosts) if scope.hosts else "any host"
    return f"crawl {scope.start_url or 'from the seeds'} on {where}, to depth {scope.max_depth}, at most {scope.max_pages} pages; collect {what}"


def status(claimed: DataFrame, done: DataFrame, scope: scopes.Scope, job: str = "job", stopped: DataFrame | None = None) -> DataFrame:
    """Per crawl: claimed, fetched, failed, left, and its state (stopped, over budget, finished, running).

    ``claimed(job, url)``, ``done(job, url, ok)``, ``stopped(job)``.
    """
    n = claimed.groupBy(job).agg(F.count(F.lit(1)).alias("claimed"))
    d = done.groupBy(job).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(~F.col("ok")).alias("failed"))
    out = n.join(d, job, "left").fillna(0, ["fetched", "failed"]).withColumn("left", F.col("claimed") - F.col("fetched"))
    out = out.join(stopped.select(job, F.lit(True).alias("_stop")), job, "left") if stopped is not None else out.withColumn("_stop", F.lit(False))
    state = F.when(F.col("_stop"), "stopped").when(F.col("left") == 0, "finished").when(F.col("claimed") >= scope.max_pages, "at its budget").otherwise("running")
    return out.withColumn("state", state).drop("_stop")
