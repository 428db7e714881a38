"""What may be fetched, and what a response asks for: ordered rules as one expression."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from . import blocks, detect, urls

SCHEMES = ("http", "https")
MAX_CRAWL_DELAY = 30.0
MAX_BYTES = 64 << 20
MAX_WAIT, MAX_GAP = 3600.0, 60.0
# Refusals that a browser may pass, and declared types that can be under-rendered.
BROWSER_STATUS = (401, 403, 429, 503)
RENDERED_TYPES = ("text/html", "application/xhtml")


def check(url: Column, deny: Sequence[str] = (), allow: Sequence[str] = (), robots_allowed: Column | None = None, robots_reason: Column | None = None, delay: Column | None = None, max_delay: float = MAX_CRAWL_DELAY) -> Column:
    """STRUCT<allowed,reason,error_type>: scheme, host, private address, deny list, allow list, robots, crawl delay, in this order."""
    verdict = lambda reason, error: F.struct(F.lit(False).alias("allowed"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(error).alias("error_type"))
    scheme, host, short = urls.scheme(url), urls.host(url), urls.registrable_host(url)
    listed = lambda names: host.isin(*names) | short.isin(*names)
    out = F.when(F.coalesce(~scheme.isin(*SCHEMES), F.lit(True)), verdict(F.concat(F.lit("scheme '"), F.coalesce(scheme, F.lit("")), F.lit("' is not fetchable")), "SchemeNotAllowed"))
    out = out.when(host == "", verdict("URL has no host", "HostNotAllowed")).when(urls.is_private(host), verdict("private address", "HostNotAllowed"))
    if deny:
        out = out.when(listed(deny), verdict("host is on the denylist", "HostNotAllowed"))
    if allow:
        out = out.when(~listed(allow), verdict("host is not on the allowlist", "HostNotAllowed"))
    if robots_allowed is not None:
        out = out.when(~robots_allowed, verdict(robots_reason if robots_reason is not None else F.lit("robots"), "RobotsDisallowed"))
    if delay is not None:
        out = out.when(delay > max_delay, verdict(F.concat(F.lit("Crawl-delay of "), F.round(delay).cast("int").cast("string"), F.lit(" s is more than we honour")), "RobotsDisallowed"))
    return out.otherwise(F.struct(F.lit(True).alias("allowed"), F.lit("allowed").alias("reason"), F.lit(None).cast("string").alias("error_type")))


def size_error(raw: Column, cap: int = MAX_BYTES) -> Column:
    """Why a body is not kept: more bytes than the cap; null if it is."""
    n = F.octet_length(raw)
    return F.when(n > cap, F.concat(F.lit("body of "), n.cast("string"), F.lit(f" bytes exceeds {cap}")))


def needs_render(status: Column, body: Column, content_type: Column | None = None) -> Column:
    """Whether a browser is worth its cost: a refusal it may pass, an empty body or an empty shell of HTML."""
    declared = F.coalesce(F.lower(content_type), F.lit("")) if content_type is not None else F.lit("")
    other = (declared != "") & ~(declared.startswith(RENDERED_TYPES[0]) | declared.startswith(RENDERED_TYPES[1]))
    return F.when(status.isin(*BROWSER_STATUS), F.lit(True)).when(F.coalesce(status != 200, F.lit(True)), F.lit(False)).when(F.coalesce(body, F.lit("")) == "", F.lit(True)).when(other, F.lit(False)).otherwise(blocks.is_empty_shell(body))


def retry_wait(attempt: Column, attempts: int = 3) -> Column:
    """Seconds before the next try after a failed one (1, 2, ...; jitter is the fetcher's); null when none is left."""
    return F.when(attempt < attempts, F.pow(F.lit(2.0), attempt - 1))


def rate_gap(headers: Column, as_of: Column) -> Column:
    """Seconds between requests that the quota headers ask for, once a tenth or less is left; null otherwise."""
    number = lambda *names: F.coalesce(*[F.try_element_at(headers, F.lit(n)).try_cast("double") for n in names])
    left, limit, reset = (number(f"ratelimit-{k}", f"x-ratelimit-{k}") for k in ("remaining", "limit", "reset"))
    window = F.when(reset > 1e9, reset - as_of).otherwise(reset)
    return F.when((limit > 0) & (left <= limit * 0.1) & (window > 0), F.least(window / F.greatest(left, F.lit(1.0)), F.lit(MAX_GAP)))


def slowest(*gaps: Column) -> Column:
    """The gap to keep: delays only grow."""
    return F.coalesce(F.greatest(*gaps), F.lit(0.0)) if len(gaps) > 1 else F.coalesce(gaps[0], F.lit(0.0))


def route(found: Column) -> Column:
    """STRUCT<kind,subtype,source,confidence,warning> of a detection; below one half it warns."""
    c = F.round(found["confidence"], 2)
    warning = F.when(found["confidence"] < 0.5, F.concat(F.lit("low-confidence type detection: "), found["kind"]))
    return F.struct(found["kind"].alias("kind"), found["subtype"].alias("subtype"), found["by"].alias("source"), c.alias("confidence"), warning.alias("warning"))


def web_or_media(url: Column, head_type: Column | None = None) -> Column:
    """The older two-way split: media by URL, or by what a HEAD request declared."""
    media = detect.pre_route(url).isin("ytdlp", "livestream")
    if head_type is not None:
        media = media | F.coalesce(F.lower(head_type).rlike("^(?:video|audio)/"), F.lit(False))
    return F.when(media, F.lit("media")).otherwise(F.lit("web"))


_BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def told_by_form(raw: bytes) -> tuple[str | None, str | None]:
    """Text and charset of bytes whose form tells it: a mark, valid UTF-8, zero bytes of UTF-16, UTF-8 with a little damage."""
    for mark, name in _BOMS:
        if raw.startswith(mark):
            return raw.decode(name, "replace"), name
    try:
        return raw.decode(), "utf-8"
    except UnicodeDecodeError:
        pass
    even, odd = raw[0::2].count(0), raw[1::2].count(0)
    if max(even, odd) > len(raw) // 5:
        name = "utf-16-be" if even > odd else "utf-16-le"
        return raw.decode(name, "replace"), name
    if len(raw.decode("utf-8", "ignore").encode()) >= 0.95 * len(raw) and any(b >= 0xC2 for b in raw) and _sequences(raw):
        return raw.decode("utf-8", "replace"), "utf-8"
    return None, None


def _sequences(raw: bytes) -> bool:
    """Whether bytes above 127 mostly stand in valid UTF-8 sequences; code pages have letters from 0x80 on too."""
    good = sum(b > 127 for b in raw.decode("utf-8", "ignore").encode())
    return 4 * good >= 3 * sum(b > 127 for b in raw)


def _decode(raw: bytes | None) -> str | None:
    if not raw:
        return None
    text, _ = told_by_form(raw)
    if text is not None:
        return text
    try:
        return raw.decode("cp1252")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@F.pandas_udf(StringType())
def decode_bytes(raw: pd.Series) -> pd.Series:
    """Text of bytes by byte-order mark, valid UTF-8, zero bytes of UTF-16, then a Western code page; null if empty."""
    return raw.map(lambda x: None if (t := _decode(x)) is None or not t.strip() else t)


@F.pandas_udf(StringType())
def decode_whole(raw: pd.Series) -> pd.Series:
    """As ``decode_bytes``, with white space and empty texts kept as they are."""
    return raw.map(lambda x: None if x is None else _decode(x) or "")


_SIZE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("image_format", StringType())])


def _image_size(raw: bytes | None) -> tuple[int | None, int | None, str | None]:
    """Width, height and format by the header alone."""
    raw = raw or b""
    big, little = (lambda a, n: int.from_bytes(raw[a : a + n], "big")), (lambda a, n: int.from_bytes(raw[a : a + n], "little"))
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[12:16] == b"IHDR" and len(raw) >= 24:
        return big(16, 4), big(20, 4), "PNG"
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return little(6, 2), little(8, 2), "GIF"
    if raw[:2] == b"BM" and len(raw) >= 26:
        return little(18, 4), abs(int.from_bytes(raw[22:26], "little", signed=True)), "BMP"
    if raw[:4] == b"RIFF" and raw[8:16] == b"WEBPVP8X" and len(raw) >= 30:
        return little(24, 3) + 1, little(27, 3) + 1, "WEBP"
    at = 2 if raw[:2] == b"\xff\xd8" else len(raw)
    while at + 9 <= len(raw) and raw[at] == 0xFF:  # JPEG segments up to the frame header
        kind = raw[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return big(at + 7, 2), big(at + 5, 2), "JPEG"
        at += 2 + (0 if kind == 0xFF or 0xD0 <= kind <= 0xD8 else max(2, big(at + 2, 2)))
    return None, None, None


@F.pandas_udf(_SIZE)
def image_size(raw: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([_image_size(x) for x in raw], columns=["width", "height", "image_format"])
    return found.astype({"width": "Int32", "height": "Int32"})


def pipe_table(headers: Column, rows: Column, preview: int = 50) -> Column:
    """A table as lines of cells between bars; how many rows follow after ``preview``."""
    bar = lambda cells: F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")
    more = F.when(F.size(rows) > preview, F.array(F.concat(F.lit("... and "), (F.size(rows) - preview).cast("string"), F.lit(" more rows")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(bar(headers), bar(F.transform(headers, lambda h: F.lit("---")))), F.transform(F.slice(rows, 1, preview), bar), more), "\n")


def feed_text(title: Column, entries: Column) -> Column:
    """A feed's entries (STRUCT<title,author,published,url,summary,content>) as headed sections."""
    line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v))

    def section(e: Column) -> Column:
        body = F.coalesce(F.nullif(e["content"], F.lit("")), F.nullif(e["summary"], F.lit("")))
        shown = [F.concat(F.lit("## "), F.coalesce(e["title"], F.lit("Untitled"))), line("author", e["author"]), line("published", e["published"]), line("url", e["url"]), F.when(body.isNotNull(), F.concat(F.lit("\n"), body)), F.lit("")]
        return F.array_join(F.array(*shown), "\n")

    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Feed"))), F.lit("")), F.transform(entries, section)), "\n")


def mail_text(headers: Column, body: Column, attachments: Column) -> Column:
    """A message's headers by name, its attachments' names and its body."""
    head = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(F.initcap(e["key"]), F.lit(": "), e["value"]))
    names = F.when(F.size(attachments) > 0, F.array(F.concat(F.lit("Attachments: "), F.array_join(attachments, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.trim(F.array_join(F.concat(head, names, F.array(F.lit(""), F.coalesce(body, F.lit("")))), "\n"))
