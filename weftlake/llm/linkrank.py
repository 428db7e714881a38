"""URL filters: rules first, then trust and distrust spread over the host graph.

Hosts are linked where a page of one has an absolute link to the other; an edge
weighs its share of the host's outgoing links.  Trust starts at hosts with
pages that the rules allow and follows links (personalised PageRank); distrust
starts at hosts with pages that the rules block and goes against the links, to
those that link to them.  Both start with a host's number of such pages and are
scaled by 1 / (1 - damping), so a host has its own number and what reaches it:
rank = seed + damping * (shares of linking hosts' ranks).  A host is blocked
when its distrust exceeds its trust by more than ``THRESHOLD`` of its pages;
pages that no rule fits take their host's verdict.

Links are counted per pair of hosts before anything is shuffled twice, ranks are
one row per host, and every iteration is a join and a pre-aggregated sum.  Only
what a host got last is passed on, which shrinks by ``DAMPING`` at least every
round, so the sum of all that can still come is known: without ``rounds`` the
iterations end when it is below ``TOLERANCE``, under the slack at a threshold.
With ``rounds`` they stop early.  A host with very many links is split over
tasks where its rank is passed on, and so is one with very many pages.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged as the host '' (no rule, no links: allowed); null
html has no links; repeated rows count each; an empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, materialize, salted_join

DAMPING = 0.85
ROUNDS = 12
#: Iterations between stored ranks.
STORE_EVERY = 4
THRESHOLD = 0.3
#: Slack against rounding at the threshold.
SLACK = 1e-9
#: Rank that may be undelivered, over all hosts, where no number of rounds is given.
TOLERANCE = SLACK / 4


#: What a page does not show: its links are none.
HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|$)"
#: An absolute link of an ``a`` element: attributes before it are read whole, quoted values included.
LINK = r"""(?i)<a(?:\s+(?!href\s*=)[^\s"'>=/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?|/)*+\s+href\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: how many links from pages of one host to another host.

    Links are those of ``a`` elements outside comments, scripts, styles and
    templates; values of other attributes may hold any sign.  A relative link,
    and one that only ``base`` makes absolute, is one to its own host: no edge.
    """
    shown = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, " ")
    links = F.regexp_extract_all(shown, F.lit(LINK), 1)
    rows = pages.select(host_of(F.col(url)).alias("src"), F.explode(links).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    rows = rows.select("src", host_of(full).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, rounds: int | None = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``seeds(host, seed)`` over ``edges(src, dst, n)`` -> host, rank (personalised PageRank, scaled).

    Hosts that are only linked to need a row in ``seeds`` with 0.  ``rounds``:
    None until ranks are settled.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("_all"), F.ceil(F.count(F.lit(1)) / F.lit(float(HOT))).cast("int").alias("_tasks"))
    out = materialize(out, "out")
    shares = salted_join(edges, out, "src", salt="dst").select("src", "dst", (F.col("n") / F.col("_all")).alias("share"), F.pmod(F.xxhash64("dst"), F.col("_tasks")).cast("int").alias("_at"))
    shares = materialize(shares, "shares")
    hot = out.filter("_tasks > 1").select(F.col("src").alias("host"), "_tasks")
    split = hot.limit(1).count() > 0

    def givers(ranks: DataFrame) -> DataFrame:
        """What is passed on; of a host with very many links once for each task that has some of them."""
        rows = ranks.filter("_new > 0").select("host", "_new")
        if not split:
            return rows.select(F.col("host").alias("src"), "_new", F.lit(0).alias("_at"))
        tasks = F.coalesce("_tasks", F.lit(1))
        return rows.join(hot, "host", "left").select(F.col("host").alias("src"), "_new", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("_at"))

    ranks = seeds.select("host", F.col("seed").alias("rank"), F.col("seed").alias("_new"))
    k = 0
    while k != rounds:
        k += 1
        given = shares.join(givers(ranks), ["src", "_at"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("_new") * F.col("share")).alias("got"))
        new = F.lit(damping) * F.coalesce("got", F.lit(0.0))
        ranks = ranks.join(given, "host", "left").select("host", (F.col("rank") + new).alias("rank"), new.alias("_new"))
        if k % STORE_EVERY == 0 or k == rounds:
            ranks = materialize(ranks, "ranks")
            left = ranks.agg(F.sum("_new")).first()[0] or 0.0
            if left == 0 or (rounds is None and left * damping / (1 - damping) < TOLERANCE):
                break
    return ranks.select("host", "rank")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD, key: str = "page_id", rounds: int | None = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict (and trust and distrust of the host).

    ``rounds``: of the iterations; None until ranks are settled.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select(key, host.alias("host"), path.alias("path"))
    rule, said = match(F.col("host"), F.col("path"), rules)
    parsed = materialize(parsed.withColumn("rule", rule).withColumn("said", said), "pages")
    edges = materialize(host_edges(pages), "edges")
    own = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("said") == "allow").cast("double").alias("good"), F.count_if(F.col("said") == "block").cast("double").alias("bad"))
    far = edges.select(F.col("dst").alias("host")).distinct().join(own, "host", "left_anti").select("host", F.lit(0).cast("long").alias("pages"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))
    hosts = materialize(own.unionByName(far), "hosts")
    trust = spread(hosts.select("host", F.col("good").alias("seed")), edges, rounds)
    distrust = spread(hosts.select("host", F.col("bad").alias("seed")), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), rounds)
    verdicts = hosts.join(trust.withColumnRenamed("rank", "trust"), "host").join(distrust.withColumnRenamed("rank", "distrust"), "host")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") - F.col("trust") > F.lit(threshold) * F.col("pages") + F.lit(SLACK))
    verdicts = materialize(verdicts.select("host", "trust", "distrust", F.when(bad, F.lit("block")).otherwise(F.lit("allow")).alias("by_host")), "verdicts")
    joined = salted_join(parsed, verdicts, "host", "left", salt=key)
    return joined.select(key, "host", "path", "rule", F.coalesce("said", "by_host").alias("verdict"), "trust", "distrust")


def _spread_sql(name: str, seed: str, src: str, dst: str) -> str:
    """The iterations of one direction as DuckDB CTEs: what a host got in each round, until next to nothing is passed on."""
    return (
        f"{name}_s AS (SELECT {src} AS src, {dst} AS dst, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY {src}) AS share FROM edges),\n"
        f"{name}_r(host, k, new) AS (SELECT host, 0, {seed} FROM hosts WHERE {seed} > 0 UNION ALL SELECT s.dst, r.k + 1, {DAMPING!r}::DOUBLE * sum(r.new * s.share) "
        f"FROM {name}_r r JOIN {name}_s s ON s.src = r.host WHERE r.new > {TOLERANCE * 1e-6} GROUP BY s.dst, r.k),\n"
        f"{name} AS (SELECT h.host, coalesce(sum(r.new), 0) AS rank FROM hosts h LEFT JOIN {name}_r r ON r.host = h.host GROUP BY h.host)"
    )


#: ``HIDDEN`` and ``LINK`` without references and looking ahead, which that engine does not have.
_HIDDEN_SQL = "(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|$)" for t in ("script", "style", "template", "noscript"))
_LINK_SQL = r"""(?i)<a(?:\s+[^\s"'>=/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?|/)*?\s+href\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql() -> tuple[str, str]:
    fits = [(r, f"((host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}'))") for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))]
    return tuple("CASE " + " ".join(f"WHEN {c} THEN '{v(r)}'" for r, c in fits) + " END" for v in (lambda r: r.name, lambda r: r.verdict))


#: The same rows in DuckDB, until ranks are settled.
ORACLE = rf"""
WITH RECURSIVE raw AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS after FROM pages),
cut AS (SELECT page_id, html, coalesce(translate(regexp_extract(after, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
               coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path FROM raw),
parsed AS (SELECT page_id, html, host, path, {_rule_sql()[0]} AS rule, {_rule_sql()[1]} AS said FROM cut),
links AS (SELECT host AS src, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), {_quoted(_HIDDEN_SQL)}, ' ', 'g'), {_quoted(_LINK_SQL)}, 1)) AS link FROM parsed),
ends AS (SELECT src, translate(regexp_extract(link, '//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS dst FROM links),
edges AS (SELECT src, dst, count(*) AS n FROM ends WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
own AS (SELECT host, count(*) AS pages, CAST(count(*) FILTER (said = 'allow') AS DOUBLE) AS good, CAST(count(*) FILTER (said = 'block') AS DOUBLE) AS bad FROM parsed GROUP BY host),
hosts AS (SELECT * FROM own UNION ALL SELECT DISTINCT dst, 0, 0::DOUBLE, 0::DOUBLE FROM edges WHERE dst NOT IN (SELECT host FROM own)),
{_spread_sql("t", "good", "src", "dst")},
{_spread_sql("d", "bad", "dst", "src")},
verdicts AS (SELECT h.host, CASE WHEN d.rank > t.rank AND d.rank - t.rank > {THRESHOLD} * h.pages + {SLACK} THEN 'block' ELSE 'allow' END AS by_host
             FROM hosts h JOIN t ON h.host = t.host JOIN d ON h.host = d.host)
SELECT page_id, p.host, path, rule, coalesce(said, by_host) AS verdict FROM parsed p JOIN verdicts v ON p.host = v.host
"""
