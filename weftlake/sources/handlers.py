"""Readers of blobs in a table: one row in, child rows out, as UDTF-like Arrow maps.

Line-oriented and tree-shaped text goes through Spark's own parsers; formats with
containers (archives, mail, YAML, open XML) through small Python readers inside
Arrow batches.  Every reader reports a damaged blob in ``error`` and goes on.
"""

from __future__ import annotations

import bz2
import csv
import email
import email.policy
import gzip
import io
import json
import lzma
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Caps of a record view, for the readers' ``most``; without it nothing is left out.
ROWS, ENTRIES, URLS = 10_000, 100, 5_000
#: Limits on what a packed blob may unfold to: a member beyond them is a row with ``error``.
MAX_MEMBERS, MAX_MEMBER, MAX_RATIO, MAX_TOTAL, MAX_ATTACHMENT = 200, 64 << 20, 200, 512 << 20, 32 << 20
#: Blobs read before their rows go on: what a worker holds does not depend on Spark's batches.
SLICE = 256
KEPT_HEADERS = ("from", "to", "cc", "subject", "date", "message-id", "reply-to")


def _children(df: DataFrame, key: str, blob: str, read: Callable[[object], Iterator[tuple]], fields: list[tuple[str, pa.DataType]], most: int | None = None) -> DataFrame:
    """Rows of ``read(blob)`` with their parent's key and place; an exception becomes one row with ``error``.

    ``most``: rows of a blob at most; one more row, at place -1, then says that it is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            keys, places, errors, rows = [], [], [], []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if raw is None:
                    continue
                try:
                    for n, row in enumerate(read(raw)):
                        if most is not None and n >= most:
                            keys.append(k), places.append(-1), errors.append(f"cut after {most} rows"), rows.append((None,) * len(fields))
                            break
                        keys.append(k), places.append(n), errors.append(None), rows.append(row)
                except Exception as why:  # a damaged blob is a result, not the end of a job
                    keys.append(k), places.append(-1), errors.append(f"{type(why).__name__}: {why}"[:300]), rows.append((None,) * len(fields))
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, b.column(0).type), pa.array(places, pa.int32()), *(pa.array(list(c), t) for c, (_, t) in zip(columns, fields)), pa.array(errors, pa.string())], names=[key, "place", *(n for n, _ in fields), "error"]
            )

    kinds = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "long", pa.list_(pa.string()): "array<string>"}
    ddl = ", ".join(f"`{n}` {kinds.get(t, 'map<string,string>')}" for n, t in fields)
    return df.select(key, blob).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, place int, {ddl}, error string")


_MAP = pa.map_(pa.string(), pa.string())


# --- tables and data ---------------------------------------------------------


def _is_number(cell: str) -> bool:
    try:
        float(cell.replace(",", ""))
    except ValueError:
        return False
    return True


def records(rows: list[list[str]]) -> Iterator[dict]:
    """Rows as records: a first row of filled, non-numeric cells names the columns; missing names are col_i."""
    if not rows:
        return
    head = rows[0] if all(c.strip() and not _is_number(c) for c in rows[0]) else None
    width = max(map(len, rows))
    names = [*(c.strip() for c in head or []), *(f"col_{k}" for k in range(len(head or []), width))]
    for r in rows[1 if head else 0 :]:
        if any(c.strip() for c in r):
            yield dict(zip(names, r))


def read_table(text: str) -> Iterator[tuple]:
    lines = [x for x in text.splitlines()[:8] if x.strip()]
    even = [d for d in "\t,;|" if len(lines) > 1 and lines[0].count(d) and len({x.count(d) for x in lines}) == 1]
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=even[0] if even else ",") if r]
    return ((r,) for r in records(rows))


def delimited(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """CSV-like texts -> key, place, record MAP, error."""
    return _children(df, key, text, read_table, [("record", _MAP)], most)


def json_records(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """JSON documents and arrays, or JSON lines -> key, place, value (VARIANT); unreadable lines are left out."""
    head = F.regexp_extract(F.trim(F.col(text)), r"^([^\n]*)\n", 1)
    several = (head != "") & F.try_parse_json(head).isNotNull()  # the parser stops after a first value
    whole = F.when(~several, F.try_parse_json(F.col(text)))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & F.try_parse_json(x).isNotNull())
    values = F.when(whole.isNull(), lines).when(F.trim(F.col(text)).startswith("["), F.transform(F.from_json(F.col(text), "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(F.trim(F.col(text))))
    return df.select(key, F.posexplode(F.slice(values, 1, most) if most else values).alias("place", "raw")).select(key, "place", F.try_parse_json("raw").alias("value"))


def read_yaml(text: str) -> Iterator[tuple]:
    import yaml

    try:
        value = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:  # the slower loader has the last word on what is damaged
        value = yaml.safe_load(text)
    yield (json.dumps(value, default=str, ensure_ascii=False),)


def yaml_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """YAML (safe subset) as JSON text."""
    return _children(df, key, text, read_yaml, [("json", pa.string())])


def _element(e: ElementTree.Element) -> object:
    """Attributes as @name, text as #text, repeated names as lists; nothing is left out (too deep a tree is an error)."""
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    several = set()
    for child in e:
        name, value = child.tag.rsplit("}", 1)[-1], _element(child)
        if name in several:
            out[name].append(value)
        elif name in out:
            out[name] = [out[name], value]
            several.add(name)
        else:
            out[name] = value
    text = (e.text or "").strip()
    return (text or None) if not out else out | ({"#text": text} if text else {})


def _tree(text: str) -> ElementTree.Element:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document types and entities are not read")
    return ElementTree.fromstring(text)


def read_xml(text: str) -> Iterator[tuple]:
    root = _tree(text)
    yield (json.dumps({root.tag.rsplit("}", 1)[-1]: _element(root)}, ensure_ascii=False),)


def xml_values(df: DataFrame, key: str, text: str) -> DataFrame:
    return _children(df, key, text, read_xml, [("json", pa.string())])


# --- feeds and sitemaps ------------------------------------------------------


def _child(e: ElementTree.Element, *names: str) -> str | None:
    for name in names:
        for c in e:
            if c.tag.rsplit("}", 1)[-1].lower() == name and (v := (c.text or c.attrib.get("href") or "".join(c.itertext())).strip()):
                return v
    return None


def read_feed(text: str) -> Iterator[tuple]:
    for e in (e for e in _tree(text).iter() if e.tag.rsplit("}", 1)[-1].lower() in ("item", "entry")):
        tags = [t for c in e if c.tag.rsplit("}", 1)[-1].lower() == "category" and (t := (c.attrib.get("term") or c.text or "").strip())]
        author = next((c for c in e if c.tag.rsplit("}", 1)[-1].lower() == "author"), None)
        yield _child(e, "title"), _child(e, "link", "id", "guid"), (_child(author, "name") if author is not None and len(author) else None) or _child(e, "author", "creator"), _child(e, "pubdate", "published", "updated", "date"), _child(e, "description", "summary"), _child(e, "encoded", "content"), tags


def feed_entries(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """RSS and Atom entries."""
    return _children(df, key, text, read_feed, [*((n, pa.string()) for n in ("title", "url", "author", "published", "summary", "content")), ("tags", pa.list_(pa.string()))], most)


def xml_unescape(c: Column) -> Column:
    """XML's five entities as characters, trimmed."""
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.trim(c)


def sitemap_urls(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """Locations of sitemaps and indexes, by expressions alone: key, place, loc, lastmod, changefreq, priority."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<(?:\w+:)?(?:url|sitemap)\b[^>]*>(.*?)</(?:\w+:)?(?:url|sitemap)>"), 1)
    one = lambda tag: F.nullif(xml_unescape(F.regexp_extract("block", rf"(?is)<(?:\w+:)?{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</", 1)), F.lit("")).alias(tag)
    rows = df.select(key, F.posexplode(F.slice(blocks, 1, most) if most else blocks).alias("place", "block"))
    return rows.select(key, "place", *[one(t) for t in ("loc", "lastmod", "changefreq", "priority")]).filter("loc is not null")


def robots_sitemaps(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)


# --- robots ------------------------------------------------------------------


def read_robots(text: str) -> Iterator[tuple]:
    """Agent, directive (allow, disallow, delay) and value of each rule."""
    agents, in_rules = [], False
    for line in text.splitlines():
        name, sep, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not sep:
            continue
        if name == "user-agent":
            if in_rules:
                agents, in_rules = [], False
            agents.append(value.lower())
        elif name in ("allow", "disallow", "crawl-delay", "request-rate"):
            in_rules = True
            if name == "request-rate":
                n, _, s = value.partition("/")
                value = str(float(s.rstrip("smh") or 1) * {"m": 60, "h": 3600}.get(s[-1:], 1) / float(n or 1))
            kind = name if name in ("allow", "disallow") else "delay"
            for a in agents:
                yield a, kind, value


def robots_rules(df: DataFrame, key: str, body: str) -> DataFrame:
    return _children(df, key, body, read_robots, [("agent", pa.string()), ("directive", pa.string()), ("value", pa.string())])


def fits_rule(value: Column, path: Column) -> Column:
    """Whether a path begins as a rule says: ``*`` stands for anything, a ``$`` at the end for the path's end.

    The texts between stars are looked for one after the other, each where it
    comes first, so no rule takes longer than its length times the path's.
    """
    anchored = value.endswith("$")
    parts = F.split(F.when(anchored, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value), r"\*")
    n = F.size(parts)
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    between = F.slice(parts, F.lit(2), F.greatest(F.when(anchored, n - 2).otherwise(n - 1), F.lit(0)))
    found = lambda at, x: F.call_function("locate", x, path, at)
    after = F.aggregate(between, F.when(path.startswith(first), F.length(first) + 1).otherwise(0), lambda at, x: F.when((at == 0) | (x == ""), at).when(found(at, x) == 0, 0).otherwise(found(at, x) + F.length(x)))
    ends = F.when(n == 1, path == first).otherwise(path.endswith(last) & (F.length(path) - F.length(last) + 1 >= after))
    return F.coalesce((after > 0) & F.when(anchored, ends).otherwise(F.lit(True)), F.lit(False))


def robots_verdict(urls: DataFrame, robots: DataFrame, agent: str, unreachable: str = "allow") -> DataFrame:
    """urls(url, origin, path) with robots(origin, status, body) -> url, allowed, reason.

    No file or another 4xx allows all, 401 and 403 deny all, 5xx is a setting;
    otherwise the longest rule of the agent's group (else of ``*``) decides, and
    allow wins ties.
    """
    rules = robots_rules(robots.filter("status between 200 and 299"), "origin", "body").filter("directive <> 'delay' and value <> ''")
    own = rules.groupBy("origin").agg(F.max(F.contains(F.lit(agent.lower()), F.col("agent")) & (F.col("agent") != "*")).alias("named"))
    rules = rules.join(own, "origin").filter(F.when(F.col("named"), F.contains(F.lit(agent.lower()), F.col("agent")) & (F.col("agent") != "*")).otherwise(F.col("agent") == "*"))
    rules = rules.select("origin", "directive", "value", F.length("value").alias("n"))
    best = urls.join(rules, "origin").filter(fits_rule(F.col("value"), F.col("path"))).groupBy("url").agg(F.max(F.struct("n", (F.col("directive") == "allow").alias("ok"))).alias("best"))
    s = F.col("status")
    blanket = F.when(s.isNull() | (s >= 500), F.lit(unreachable == "allow")).when(s.isin(401, 403), F.lit(False)).when(s >= 400, F.lit(True))
    joined = urls.join(robots.select("origin", "status"), "origin", "left").join(best, "url", "left")
    return joined.select("url", F.coalesce(blanket, F.col("best.ok"), F.lit(True)).alias("allowed"), F.when(blanket.isNotNull(), F.concat(F.lit("status "), F.coalesce(s.cast("string"), F.lit("none")))).otherwise("rules").alias("reason"))


# --- mail and archives -------------------------------------------------------


def read_mail(raw: bytes) -> Iterator[tuple]:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(preferencelist=("plain", "html"))
    yield "message", {k: str(m[k]) for k in KEPT_HEADERS if m[k]}, body.get_content() if body else "", None
    for part in m.iter_attachments():
        data = part.get_payload(decode=True) or b""
        head = {"name": part.get_filename() or "", "type": part.get_content_type()}
        yield "attachment", head | ({"dropped": f"{len(data)} bytes"} if len(data) > MAX_ATTACHMENT else {}), None, data if len(data) <= MAX_ATTACHMENT else None


def mail_parts(df: DataFrame, key: str, raw: str) -> DataFrame:
    """A message's headers and body (plain text preferred), then its attachments."""
    return _children(df, key, raw, read_mail, [("part", pa.string()), ("headers", _MAP), ("body", pa.string()), ("data", pa.binary())])


def safe_name(name: str) -> str | None:
    """A member's relative path; null for absolute paths and those that climb."""
    parts = name.replace("\\", "/").split("/")
    bad = name.startswith(("/", "\\")) or ".." in parts or ":" in parts[0] or not parts[-1]
    return None if bad else "/".join(p for p in parts if p not in ("", "."))


def _packed(raw: bytes, opened: Callable) -> bytes:
    with opened(io.BytesIO(raw)) as f:
        data = f.read(min(MAX_MEMBER, MAX_RATIO * len(raw)) + 1)
    if len(data) > min(MAX_MEMBER, MAX_RATIO * len(raw)):
        raise ValueError("the content is larger than the limits")
    return data


def read_archive(raw: bytes) -> Iterator[tuple]:
    """Members within the limits on number, size, ratio and total."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            total = 0
            for n, i in enumerate(z.infolist()):
                name = safe_name(i.filename)
                if i.is_dir():
                    continue
                if not name or n >= MAX_MEMBERS or i.file_size > MAX_MEMBER or i.file_size > MAX_RATIO * max(1, i.compress_size) or total + i.file_size > MAX_TOTAL:
                    yield i.filename, i.file_size, None, "unsafe name" if not name else "beyond the limits"
                    continue
                total += i.file_size
                yield name, i.file_size, z.read(i), None
        return
    for magic, opened in ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ", lzma.open)):
        if raw.startswith(magic):
            raw = _packed(raw, opened)
            if raw[257:262] != b"ustar":
                yield "content", len(raw), raw, None
                return
    if raw[257:262] != b"ustar":
        raise ValueError("not an archive that can be read")
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        total = n = 0
        for m in t:
            name = safe_name(m.name)
            if not m.isfile():
                continue
            n += 1
            if not name or n > MAX_MEMBERS or m.size > MAX_MEMBER or total + m.size > MAX_TOTAL:
                yield m.name, m.size, None, "unsafe name" if not name else "beyond the limits"
                continue
            total += m.size
            yield name, m.size, t.extractfile(m).read(), None


def archive_members(df: DataFrame, key: str, raw: str) -> DataFrame:
    """Members of zip, tar, gzip, bzip2 and xz blobs: name, size, data; ``dropped`` says why one has no data."""
    return _children(df, key, raw, read_archive, [("name", pa.string()), ("size", pa.int64()), ("data", pa.binary()), ("dropped", pa.string())])




# --- files and plain text ----------------------------------------------------


def files(spark, path: str, glob: str | None = None) -> DataFrame:
    """Uploaded files: path, length, modificationTime, content."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def plain_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text (trimmed), chars, error: what a text of no special form gives."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    return df.select(key, t.alias("text")).withColumn("chars", F.length("text")).withColumn("error", F.when(F.col("text") == "", F.lit("the text is empty")))


#: Names of the columns of readers whose rows are tuples.
NAMED = {
    "feed": (("title", "url", "author", "published", "summary", "content", "tags"), read_feed),
    "mail": (("part", "headers", "body", "data"), read_mail),
    "archive": (("name", "size", "data", "dropped"), read_archive),
}
