"""Pages: one tolerant parse in an Arrow map gives all that plans ask of the markup.

``with_page`` parses each page once, in two walks over its nodes, and gives the
parts that are asked for.  A page that cannot be read becomes a row with
``error``.  Nothing is left out unless ``most`` says so; then ``truncated`` tells.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
# What is not content, where content usually is, links that lead nowhere, fields of a page's head.
NOISE = (
    "script",
    "style",
    "noscript",
    "iframe",
    "svg",
    "canvas",
    "template",
    "header",
    "footer",
    "nav",
    "form",
    "aside",
    "[role=navigation]",
    "[role=banner]",
    "[role=contentinfo]",
    "[aria-hidden=true]",
    ".cookie-banner",
    ".cookie-consent",
    "#cookie-banner",
    ".advertisement",
    ".ad-slot",
)
CONTENT = ("article", "main", "[role=main]", "#content", ".post-content", ".article-body", ".entry-content", "#main-content")
SKIPPED_LINKS = ("#", "javascript:", "mailto:", "tel:", "data:")
HEAD = (("description", "description"), ("author", "author"), ("keywords", "keywords"), ("robots", "meta_robots"))
#: A start tag in the first set ends an open element of the second kind.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "div": ("p",), "ul": ("p",), "ol": ("p",), "table": ("p",), "h1": ("p",), "h2": ("p",), "h3": ("p",), "article": ("p",), "section": ("p",)}
_SCOPES = frozenset("table ul ol div article section body html select td th main nav aside header footer form".split())
#: The record view's caps, for ``most``; without them nothing is cut.
RECORD_CAPS = {"links": 500, "headings": 100, "tables": 20, "rows": 100, "link_text": 200, "heading_text": 300}
PARTS = ("metadata", "text_content", "links", "headings", "tables")


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    items: list = field(default_factory=list)  # nodes and strings

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(x for x in reversed(n.items) if isinstance(x, Node))

    def texts(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            else:
                stack.extend(reversed(n.items))

    def text(self, sep: str = "") -> str:
        return sep.join(x for x in map(str.strip, self.texts()) if x) if sep else "".join(self.texts()).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, n = _ENDS.get(tag, ()), self.at
        while ends and n.parent is not None and (n.tag in ends or n.tag not in _SCOPES):
            if n.tag in ends:
                self.at = n.parent
                if tag != "tr":
                    break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.parent is not None:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


_REFERENCE = re.compile(r"&([A-Za-z][A-Za-z0-9]*)(;?)")
_TITLE = re.compile(r"(?is)<title\b[^>]*>.*?(?=</title|$)")


class _Strict(_Builder):
    """Named references that are unknown or lack their semicolon stay as they are written, also in attributes; in titles all but those named.

    The library reads them in the text that it is given, so their ampersands go
    through it as a character that the page does not hold.
    """

    def __init__(self, html: str, titles: tuple[str, ...] | None = None) -> None:
        super().__init__()
        self.mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in html)
        if titles is not None:
            other = re.compile(rf"&(?!(?:{'|'.join(titles)});)" if titles else "&")
            html = _TITLE.sub(lambda m: other.sub(self.mark, m.group()), html)
        self.feed(_REFERENCE.sub(lambda m: m.group() if m[2] and f"{m[1]};" in html5 else self.mark + m.group()[1:], html))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, [(k, v and v.replace(self.mark, "&")) for k, v in attrs])

    def handle_data(self, data: str) -> None:
        super().handle_data(data.replace(self.mark, "&"))


def parse(html: str, strict: bool = False, titles: tuple[str, ...] | None = None) -> Node:
    """The tree of a page.

    HTML reads some references without their semicolon (``&amp``); ``strict``
    reads whole ones alone, for texts that were cut after they were escaped.
    With it, ``titles`` names the references that titles are read with; any
    other stays as it is written there.
    """
    if strict and "&" in html:
        b = _Strict(html, titles)
    else:
        b = _Builder()
        b.feed(html)
    b.close()
    return b.root


_SIMPLE = re.compile(r"""(\*|[a-zA-Z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]""")


def compile_selector(selector: str) -> list[list[tuple[str, list]]]:
    """Comma lists of compounds joined by descendant or ``>``: tag, #id, .class, [attr], [attr=v] and kin."""
    out = []
    for one in selector.split(","):
        chain, joint = [], " "
        for word in one.replace(">", " > ").split():
            if word == ">":
                joint = ">"
                continue
            tests, at = [], 0
            while at < len(word):
                m = _SIMPLE.match(word, at)
                if not m:
                    raise ValueError(f"cannot read the selector {selector!r}")
                tag, id_, class_, attr, op, *values = m.groups()
                tests.append(("tag", tag.lower()) if tag else ("id", id_) if id_ else ("class", class_) if class_ else ("attr", attr.lower(), op, next((v for v in values if v is not None), "")))
                at = m.end()
            chain.append((joint, tests))
            joint = " "
        out.append(chain)
    return out


def _fits(n: Node, tests: list) -> bool:
    for kind, *x in tests:
        if kind == "tag":
            ok = x[0] in ("*", n.tag)
        elif kind == "id":
            ok = n.attrs.get("id") == x[0]
        elif kind == "class":
            ok = x[0] in n.attrs.get("class", "").split()
        else:
            name, op, v = x
            have = n.attrs.get(name)
            ok = have is not None and (op is None or {"=": have == v, "~=": v in have.split(), "^=": have.startswith(v), "$=": have.endswith(v), "*=": v in have, "|=": have == v or have.startswith(v + "-")}[op])
        if not ok:
            return False
    return True


def _matches(n: Node, chain: list) -> bool:
    if not _fits(n, chain[-1][1]):
        return False
    if len(chain) == 1:
        return True
    up = n.parent
    if chain[-1][0] == ">":
        return up is not None and _matches(up, chain[:-1])
    while up is not None:
        if _matches(up, chain[:-1]):
            return True
        up = up.parent
    return False


def select(root: Node, selector) -> Iterator[Node]:
    chains = compile_selector(selector) if isinstance(selector, str) else selector
    return (n for n in root.walk() if any(_matches(n, c) for c in chains))


def first(root: Node, selector) -> Node | None:
    return next(select(root, selector), None)


class Simple:
    """Selectors of one test each, looked up by tag, id, class and attribute."""

    def __init__(self, selectors: tuple[str, ...]) -> None:
        self.tags, self.ids, self.classes, self.attrs = {}, {}, {}, []
        for k, one in enumerate(selectors):
            (((_, ((kind, *x),)),),) = compile_selector(one)
            if kind == "attr":
                self.attrs.append((x[0], x[2], k))
            else:
                {"tag": self.tags, "id": self.ids, "class": self.classes}[kind][x[0]] = k

    def fits(self, n: Node) -> list[int]:
        """The numbers of the selectors that a node fits."""
        found = [self.tags[n.tag]] if n.tag in self.tags else []
        if n.attrs:
            found += [k for name, v, k in self.attrs if n.attrs.get(name) == v]
            if (i := n.attrs.get("id")) in self.ids:
                found.append(self.ids[i])
            if names := n.attrs.get("class"):
                found += [self.classes[c] for c in names.split() if c in self.classes]
        return found


_NOISE, _CONTENT = Simple(NOISE), Simple(CONTENT)


def drop_noise(root: Node) -> None:
    """Take out what is not content, in one walk."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.items = [x for x in n.items if not (isinstance(x, Node) and _NOISE.fits(x))]
        stack.extend(x for x in n.items if isinstance(x, Node))


def _absolute(base: str, link: str) -> str | None:
    try:
        return urljoin(base, link)
    except ValueError:
        return None


def table_of(t: Node) -> dict | None:
    """Headers and rows of a table; columns without a header are col_i."""
    heads, rows = [], []
    for n in t.walk():
        if n.tag == "th":
            heads.append(n.text())
        elif n.tag == "tr":
            cells = [c.text() for c in n.walk() if c.tag == "td"]
            if cells:
                rows.append(cells)
    width = max(map(len, rows), default=0)
    return {"headers": heads + [f"col_{k}" for k in range(len(heads), width)], "rows": rows} if rows else None


_STRING, _LONG = pa.string(), pa.int32()
_TYPES = {
    "metadata": pa.map_(_STRING, _STRING),
    "text_content": _STRING,
    "links": pa.list_(pa.struct([("url", _STRING), ("text", _STRING), ("rel", _STRING)])),
    "headings": pa.list_(pa.struct([("level", _LONG), ("text", _STRING)])),
    "tables": pa.list_(pa.struct([("headers", pa.list_(_STRING)), ("rows", pa.list_(pa.list_(_STRING)))])),
}
_DDL = {
    "metadata": "map<string,string>",
    "text_content": "string",
    "links": "array<struct<url:string,text:string,rel:string>>",
    "headings": "array<struct<level:int,text:string>>",
    "tables": "array<struct<headers:array<string>,rows:array<array<string>>>>",
}


def page(html: str | None, url: str | None, parts: tuple[str, ...] = PARTS, most: dict[str, int] | None = None, strict: bool = False, titles: tuple[str, ...] | None = None) -> dict:
    """The parts of a page; head and links are read before noise is taken out, the rest after."""
    root, url, out, cut = parse(html or "", strict, titles), url or "", {}, False
    most = most or {}

    def capped(what: list, name: str) -> list:
        nonlocal cut
        limit = most.get(name)
        cut = cut or (limit is not None and len(what) > limit)
        return what if limit is None else what[:limit]

    def short(text: str, name: str) -> str:
        return "".join(capped(list(text), name)) if name in most else text

    if "metadata" in parts or "links" in parts:
        head, seen, wanted = {}, {}, dict(HEAD)
        for n in root.walk():
            tag, attrs = n.tag, n.attrs
            if tag == "a" and "links" in parts and "href" in attrs:
                href = attrs["href"].strip()
                if href and not href.startswith(SKIPPED_LINKS) and (full := _absolute(url, href)) is not None and full not in seen:
                    seen[full] = {"url": full, "text": short(n.text(), "link_text"), "rel": attrs.get("rel", "").lower()}
            elif tag == "title":
                head.setdefault("title", n.text())
            elif tag == "meta" and attrs.get("name") in wanted:
                if text := attrs.get("content", "").strip():
                    head.setdefault(wanted[attrs["name"]], text)
            elif tag == "link" and attrs.get("rel") == "canonical" and attrs.get("href") and (full := _absolute(url, attrs["href"])) is not None:
                head.setdefault("canonical", full)
            elif tag == "html" and (text := attrs.get("lang", "").strip()):
                head.setdefault("language", text)
        if "metadata" in parts:
            out["metadata"] = head
        if "links" in parts:
            out["links"] = capped(list(seen.values()), "links")
    if {"text_content", "headings", "tables"} & set(parts):
        drop_noise(root)
        places: list[Node | None] = [None] * len(CONTENT)
        levels, grids, body = {"h1": [], "h2": [], "h3": []}, [], None
        for n in root.walk():
            if n.tag in levels:
                levels[n.tag].append(n)
            elif n.tag == "table":
                grids.append(n)
            elif n.tag == "body" and body is None:
                body = n
            for k in _CONTENT.fits(n):
                places[k] = places[k] or n
        if "text_content" in parts:
            texts = (n.text("\n") for n in places if n is not None)
            out["text_content"] = next((t for t in texts if len(t) > 200), None) or (body or root).text("\n")
        if "headings" in parts:
            out["headings"] = capped([{"level": int(k[1]), "text": short(t, "heading_text")} for k, found in levels.items() for n in found if (t := n.text())], "headings")
        if "tables" in parts:
            found = [t for t in map(table_of, capped(grids, "tables")) if t]
            out["tables"] = [t | {"rows": capped(t["rows"], "rows")} for t in found]
    return out | {"truncated": cut}


def with_page(df: DataFrame, parts: tuple[str, ...] = PARTS, keep: tuple[str, ...] | None = None, html: str = "html", url: str = "url", most: dict[str, int] | None = None, strict: bool = False, titles: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``page``: a struct of the parts, ``truncated`` and ``error``; ``strict`` and ``titles`` as in ``parse``."""
    keep = tuple(df.columns) if keep is None else keep
    kind = pa.struct([*((p, _TYPES[p]) for p in parts), ("truncated", pa.bool_()), ("error", _STRING)])
    rows = df.select(*keep, F.col(html).alias("_html"), F.col(url).alias("_url"))

    def read(h: str | None, u: str | None) -> dict:
        try:
            return page(h, u, parts, most, strict, titles)
        except Exception as why:  # a page that cannot be read is a result, not the end of a job
            return {"error": f"{type(why).__name__}: {why}"[:300]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                made = [read(h, u) for h, u in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
                for m in made:
                    if "metadata" in m:
                        m["metadata"] = list(m["metadata"].items())
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(made, kind)], names=[*b.schema.names[:-2], "page"])

    inside = ",".join([*(f"{p}:{_DDL[p]}" for p in parts), "truncated:boolean", "error:string"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]), f"page struct<{inside}>"])
    return rows.mapInArrow(run, schema)


def apply_rule(root: Node, rule: dict) -> object:
    """A selector rule's value: text or an attribute, one or all, a pattern's first group."""
    found = []
    for n in select(root, rule["selector"]):
        v = n.attrs.get(rule["attribute"], "").strip() if rule.get("attribute") else n.text()
        if rule.get("pattern"):
            m = re.search(rule["pattern"], v)
            v = (m.group(1) if m.groups() else m.group()) if m else ""
        if v:
            found.append(v)
            if not rule.get("multiple"):
                break
    return found if rule.get("multiple") else (found[0] if found else None)


#: Positions, pseudo-classes of scripts, class names that the next build changes.
UNSTABLE = r"(?i):(?:contains|eq|first|last|gt|lt|has|visible|hidden|parent|header|input|nth-)|\.(?:css|sc|jsx|emotion)-[\w-]{5,}|\.[A-Za-z_-]*[0-9a-f]{6,}|\n"


def selector_is_sane(selector: Column) -> Column:
    """Short, without positions, script pseudo-classes or generated class names."""
    bad = selector.rlike(UNSTABLE)
    return (F.length(F.trim(selector)).between(1, 300)) & ~bad


def replay_specs(pages: DataFrame, specs: DataFrame, fields: list[str]) -> DataFrame:
    """Pages joined with their selector specs (domain, rules as JSON) -> values MAP<STRING,STRING> and fill.

    Specs are one row per domain and schema; the join picks its side by size.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = []
            for html, rules in zip(b["html"], b["rules"]):
                if rules is None:
                    values.append(None)
                    continue
                root, got = parse(html or ""), {}
                for name, rule in json.loads(rules).items():
                    v = apply_rule(root, rule)
                    if v is not None and v != []:
                        got[name] = json.dumps(v) if isinstance(v, list) else v
                values.append(got)
            yield pd.DataFrame({"page_id": b["page_id"], "values": values})

    rows = pages.join(specs, "domain", "left").select("page_id", "html", "rules").mapInPandas(run, "page_id long, values map<string,string>")
    filled = F.aggregate(F.array(*[F.lit(f) for f in fields]), F.lit(0), lambda n, f: n + F.when(F.try_element_at(F.col("values"), f).isNotNull(), 1).otherwise(0))
    return rows.withColumn("fill", F.coalesce(filled, F.lit(0)) / F.lit(float(len(fields))))


def parse_rules(raw: str | None, fields: list[str]) -> dict[str, dict]:
    """Selector rules of a model's JSON answer: bare strings and one envelope are accepted, unusable rules are not."""
    try:
        said = json.loads(raw or "")
    except ValueError:
        return {}
    if isinstance(said, dict) and len(said) == 1:
        (inner,) = said.values()
        if isinstance(inner, dict) and set(inner) & set(fields):
            said = inner
    out = {}
    for name in fields if isinstance(said, dict) else ():
        rule = said.get(name)
        rule = {"selector": rule} if isinstance(rule, str) else rule
        if not isinstance(rule, dict):
            continue
        selector = str(rule.get("selector") or "").strip()
        if not 1 <= len(selector) <= 300 or re.search(UNSTABLE, selector):
            continue
        try:
            compile_selector(selector)
        except ValueError:
            continue
        out[name] = {"selector": selector, "attribute": str(rule.get("attribute") or "").strip() or None, "multiple": bool(rule.get("multiple")), "pattern": str(rule.get("regex") or "") or None}
    return out


def verified_rules(html: str, rules: dict[str, dict]) -> tuple[dict[str, dict], float]:
    """Rules that find something on the page they were made for, and the share of them that do."""
    root, alive = parse(html), {}
    for name, rule in rules.items():
        try:
            found = apply_rule(root, rule)
        except re.error:
            continue
        if found:
            alive[name] = rule
    return alive, len(alive) / len(rules) if rules else 0.0


def learned_specs(answers: DataFrame, fields: list[str], least: float = 0.5) -> DataFrame:
    """answers(domain, html, answer) -> domain, rules (JSON of those that work), fill, accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for html, answer in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                alive, _ = verified_rules(html or "", parse_rules(answer, fields))
                rows.append((json.dumps(alive, sort_keys=True), len(alive) / len(fields)))
            rules, fill = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rules, pa.string()), pa.array(fill, pa.float64())], names=["domain", "rules", "fill"])

    made = answers.select("domain", "html", "answer").mapInArrow(run, "domain string, rules string, fill double")
    return made.withColumn("accepted", F.col("fill") >= least)


SKELETON_NODES, SKELETON_CHARS = 220, 9000
# Elements an outline leaves out, and attributes that are contracts rather than styling.
OUTLINE_DROPS = ("script", "style", "noscript", "svg", "path", "iframe")
OUTLINE_SKIPS = ("body", "html", "head", "br", "hr", "meta", "link", "#root")
STABLE_ATTRIBUTES = ("itemprop", "data-testid", "data-test", "data-qa", "role", "aria-label", "name")
HASHED = re.compile(r"(?:css|sc|jsx|emotion)-[\w-]{5,}|[A-Za-z_-]*[0-9a-f]{6,}")


def _address(n: Node) -> str:
    """Tag, id, up to three lasting classes and one contract attribute."""
    name = n.tag + (f"#{n.attrs['id']}" if n.attrs.get("id") and not HASHED.fullmatch(n.attrs["id"]) else "")
    name += "".join(f".{c}" for c in [c for c in n.attrs.get("class", "").split() if not HASHED.fullmatch(c)][:3])
    mark = next((a for a in STABLE_ATTRIBUTES if n.attrs.get(a)), None)
    return name + (f"[{mark}={n.attrs[mark][:40]}]" if mark else "")


def _gives(n: Node) -> str | None:
    """An attribute that says something, or a leaf's text."""
    a = n.attrs
    if n.tag == "a" and a.get("href"):
        return f'@href="{a["href"][:120]}" text="{n.text()[:80]}"'
    if n.tag == "img":
        return f'@src="{a.get("src", "")[:120]}" @alt="{a.get("alt", "")[:60]}"'
    if n.tag == "time" and a.get("datetime"):
        return f'@datetime="{a["datetime"][:40]}"'
    if n.tag == "input" and a.get("content"):
        return f'@content="{a["content"][:100]}"'
    text = "" if any(isinstance(x, Node) for x in n.items) else re.sub(r"\s+", " ", n.text(" "))
    return f'"{text[:120]}"' if text else None


def skeleton(html: str, nodes: int | None = None, chars: int | None = None) -> str:
    """An outline of a page: where something is and what it is, one line each; a last line ``...`` where a limit cut it."""
    root = parse(html)
    lines, total, stack = [], 0, [first(root, "body") or root]
    while stack:
        n = stack.pop()
        stack.extend(x for x in reversed(n.items) if isinstance(x, Node) and x.tag not in OUTLINE_DROPS)
        if n.tag not in OUTLINE_SKIPS and (value := _gives(n)) is not None:
            if (nodes and len(lines) >= nodes) or (chars and total >= chars):
                lines.append("...")
                break
            lines.append(f"{_address(n)} -> {value}")
            total += len(lines[-1]) + 1
    return "\n".join(lines)


def skeletons(html: Column, nodes: int | None = None, chars: int | None = None) -> Column:
    """Outlines of pages; SKELETON_NODES and SKELETON_CHARS are what a model's prompt has room for."""

    @F.pandas_udf(StringType())
    def outline(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else skeleton(h, nodes, chars))

    return outline(html)


def _property(n: Node, url: str) -> str | None:
    """The value of an element with a property, by the element's kind."""
    for name in ("content", "datetime", "src", "href", "data"):
        if name in n.attrs:
            v = n.attrs[name].strip()
            return _absolute(url, v) if name in ("src", "href", "data") else v
    return n.text() or None


def microdata(html: str | None, url: str | None = None) -> list[dict]:
    """Top-level items of microdata and RDFa: type and properties, nested items inside."""
    if not html or not re.search(r"itemscope|typeof\s*=|vocab\s*=", html):
        return []
    return items_of(parse(html), url)


def items_of(root: Node, url: str | None = None) -> list[dict]:
    found: list[dict] = []
    stack: list[tuple[Node, dict | None]] = [(root, None)]
    while stack:
        n, item = stack.pop()
        names = (n.attrs.get("itemprop") or n.attrs.get("property") or "").split()
        inner = item
        if "itemscope" in n.attrs or "typeof" in n.attrs:
            kind = (n.attrs.get("itemtype") or n.attrs.get("typeof") or "").split()
            inner = {"@type": kind[0].rstrip("/").rsplit("/", 1)[-1].rsplit(":", 1)[-1] if kind else "", "properties": {}}
            if names and item is not None:
                for name in names:
                    item["properties"].setdefault(name, []).append(inner)
            else:
                found.append(inner)
        elif names and item is not None and (v := _property(n, url or "")) is not None:
            for name in names:
                item["properties"].setdefault(name.rsplit(":", 1)[-1], []).append(v)
        stack.extend((x, inner) for x in reversed(n.items) if isinstance(x, Node))
    return found


@F.pandas_udf(StringType())
def microdata_json(html: pd.Series, url: pd.Series) -> pd.Series:
    """A page's items as a JSON array; null without any."""
    made = [microdata(h, u) for h, u in zip(html, url)]
    return pd.Series([json.dumps(m, ensure_ascii=False) if m else None for m in made], dtype=object)
