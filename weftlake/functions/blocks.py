"""Refusal pages: recognised, reported and left alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header, what its value must contain (None: anything), name.
HEADER_SIGNALS = (("cf-mitigated", "challenge", "cloudflare challenge"), ("x-datadome", None, "datadome"), ("x-iinfo", None, "imperva/incapsula"), ("x-sucuri-id", None, "sucuri"), ("x-akamai-bot-manager", None, "akamai bot manager"), ("server", "awselb/2.0-challenge", "aws waf challenge"))
# Marker, name, whether it is believed whatever the status.
BODY_SIGNALS = (
    ("cf-browser-verification", "cloudflare browser check", True), ("cf_chl_opt", "cloudflare challenge", True), ("just a moment...", "cloudflare interstitial", True),
    ("checking your browser before accessing", "browser check interstitial", True), ("attention required! | cloudflare", "cloudflare block page", False), ("_incapsula_resource", "imperva/incapsula", True),
    ("request unsuccessful. incapsula incident", "imperva/incapsula", False), ("/_px/", "perimeterx", False), ("px-captcha", "perimeterx captcha", True), ("g-recaptcha", "recaptcha challenge", False),
    ("h-captcha", "hcaptcha challenge", False), ("please enable js and disable any ad blocker", "js challenge", False), ("enable javascript and cookies to continue", "js challenge", False),
    ("you have been blocked", "generic block page", False), ("unusual traffic from your computer network", "traffic analysis block", False), ("are you a robot", "bot challenge", False),
    ("verifying you are human", "human verification", True),
)
REFUSALS = (401, 403, 405, 406, 409, 418, 429, 503)
RETRYABLE = (408, 425, 429)
MAX_BODY = 256 * 1024


def detect_block(status: Column, body: Column, headers: Column | None = None) -> Column:
    """STRUCT<name,by,confidence> of a wall, or null.

    ``headers``: MAP with lower-cased names.  A vendor's header is conclusive; a
    body marker needs a short body and a refusal status, unless it stands alone.
    """
    out = None
    signal = lambda name, by, c: F.struct(F.lit(name).alias("name"), F.lit(by).alias("by"), F.lit(float(c)).alias("confidence"))
    cases = []
    if headers is not None:
        for header, expected, name in HEADER_SIGNALS:
            value = F.try_element_at(headers, F.lit(header))
            cases.append((value.isNotNull() if expected is None else F.lower(value).contains(expected), signal(name, "header", 1.0)))
    low, short = F.lower(body), F.octet_length(body) <= MAX_BODY
    for marker, name, alone in BODY_SIGNALS:
        believed = F.lit(True) if alone else status.isin(*REFUSALS)
        cases.append((short & low.contains(marker) & believed, signal(name, "body", 1.0 if alone else 0.9)))
    for when, value in cases:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out


def status_class(status: Column) -> Column:
    """What a response status means for a job: ok, unchanged, retry or fail."""
    return F.when(status == 304, "unchanged").when(status.isin(*RETRYABLE) | (status >= 500), "retry").when(status >= 400, "fail").otherwise("ok")


# Marks of an element that an application mounts into.
MOUNTS = ("id=\"root\"", "id='root'", "id=\"app\"", "id='app'", "id=\"__next\"", "id=\"__nuxt\"", "data-reactroot", "ng-app")
SHELL_BYTES = 200


def visible_bytes(html: Column) -> Column:
    """Bytes of text in the first 200,000 characters without scripts, styles and tags."""
    text = F.regexp_replace(F.substring(html, 1, 200_000), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>|<[^>]+>", " ")
    return F.octet_length(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")))


def is_empty_shell(html: Column) -> Column:
    """Little text and either an application's mount point or much markup."""
    head = F.lower(F.substring(html, 1, 200_000))
    mount = F.lit(False)
    for m in MOUNTS:
        mount = mount | head.contains(m)
    return (visible_bytes(html) < SHELL_BYTES) & (mount | (F.octet_length(head) > 2048))
