"""Page evidence from raw HTML: one job that reads each page once, scalar columns derived from its output afterwards."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up

_BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "aside", "main", "table", "tr", "td", "th", "blockquote", "figure", "form", "a", "br", "hr", "dt", "dd"}
_SILENT = {"script", "style", "noscript", "svg", "template"}
_CHROME = {"nav", "header", "footer", "aside"}
SCHEMA = (
    "page_id long, url string, title string, description string, robots string, canonical string, viewport string, lang string, h1 string, headings array<struct<level:int,text:string>>, "
    "links array<string>, images int, images_missing_alt int, json_ld array<string>, item_types array<string>, hreflang array<struct<lang:string,href:string>>, authors array<string>, times array<string>, paragraphs array<string>, text string, prose string, "
    "opening string, quality_text string, breadcrumbs array<string>, breadcrumb_source string, published string, modified string, meta_title string, meta_description string, meta_robots string, meta_canonical string"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_END_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_NOT_QUALITY = {"script", "style", "nav", "footer", "header", "noscript", "iframe"}
#: Dates that text states in full.
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
STATED_DATE = rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|{_MONTH}\.?\s+\d{{1,2}},?\s+(?:19|20)\d{{2}}|\d{{1,2}}\s+{_MONTH}\.?,?\s+(?:19|20)\d{{2}})\b"


class _Page(HTMLParser):
    """Collects what a page says about itself; end tags that a page leaves out do not matter to it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title, self.lang, self.canonical = "", "", ""
        self.headings, self.links, self.json_ld, self.types, self.hreflang, self.authors, self.times = [], [], [], [], [], [], []
        self.images = self.missing = 0
        self.text, self.prose, self.blocks = [], [], []
        self._silent = self._chrome = 0
        self._heading = self._block = None
        self._in_title = self._in_json = False
        self._stack: list[str] = []
        self.opening: list[str] | None = None  # from the end of the first h1 on
        self._opening_depth = -1  # that of the h1's siblings while they are read
        self.quality: list[str] = []
        self._not_quality = 0
        self.trails: list[tuple] = []  # (rank, place, depth, items) of elements that look like breadcrumbs
        self._items: list[tuple[int, list[str]]] = []  # open items and their depth
        self.last: dict[str, str] = {}
        self.breadcrumb_type = False

    def _open(self, tag: str, a: dict) -> None:
        """Keeps the path of open elements; a paragraph or list item that begins ends the one before."""
        ends = "p" if tag in _END_P else "li" if tag == "li" else None
        if ends in self._stack and not {"ul", "ol", "div", "article", "section", "td"} & set(self._stack[len(self._stack) - self._stack[::-1].index(ends) :]):
            self._close(ends)
        if tag in _BLOCKS and self._opening_depth >= 0:
            self.opening.append(" ")
        if self._opening_depth >= 0 and tag in ("h1", "h2") and len(self._stack) == self._opening_depth:
            self._opening_depth = -1
        label, kind = a.get("aria-label", ""), a.get("class", "")
        rank = 0 if tag == "nav" and "readcrumb" in label else 1 if "readcrumb" in label else 2 if tag == "ol" and "breadcrumb" in kind.split() else 3 if "readcrumb" in kind else None
        if rank is not None and tag not in _VOID:
            self.trails.append((rank, len(self.trails), len(self._stack), []))
        if tag not in _VOID:
            self._stack.append(tag)
        open_trails = [t for t in self.trails if t[2] >= 0]
        if open_trails and (tag == "li" or a.get("itemprop") == "name") and tag not in _VOID:
            words: list[str] = []
            self._items.append((len(self._stack), words))
            for t in open_trails:
                t[3].append(words)
        self.breadcrumb_type |= "BreadcrumbList" in a.get("itemtype", "")

    def _close(self, tag: str) -> None:
        if tag not in self._stack:
            return
        while self._stack.pop() != tag:
            pass
        depth = len(self._stack)
        if depth < self._opening_depth:
            self._opening_depth = -1
        if tag == "h1" and self.opening is None:
            self.opening, self._opening_depth = [], depth
        self._items = [(d, words) for d, words in self._items if d <= depth]
        self.trails = [(r, n, d if d < depth else -1, items) for r, n, d, items in self.trails]

    def trail(self) -> list[str]:
        """The first list of two names or more, of the surest kind of element."""
        for _, _, _, items in sorted(self.trails, key=lambda t: t[:2]):
            names: list[str] = []
            for words in items:
                name = " ".join("".join(words).split())
                if name and len(name) <= 80 and names[-1:] != [name]:
                    names.append(name)
            if len(names) >= 2:
                return names[:10]
        return []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self._open(tag, a)
        self._not_quality += tag in _NOT_QUALITY
        if tag == "meta":
            self.last[a.get("name", "").lower()] = a.get("content", "")
        elif tag == "link" and "canonical" in a.get("rel", "").lower():
            self.last["canonical"] = a.get("href", "")
        if tag in _BLOCKS:
            self.text.append(" ")
            self.prose.append(" ")
        if tag in ("p", "li"):
            self._end_block()
            self._block = []
        if tag in _SILENT:
            self._silent += 1
            self._in_json = tag == "script" and "ld+json" in a.get("type", "").lower()
            if self._in_json:
                self.json_ld.append("")
        elif tag in _CHROME:
            self._chrome += 1
        elif tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "title" and not self.title:
            self._in_title = True
        elif tag == "meta":
            self.meta.setdefault((a.get("name") or a.get("property") or "").lower(), a.get("content", ""))
        elif tag == "link":
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel and not self.canonical:
                self.canonical = a.get("href", "")
            if "alternate" in rel and a.get("hreflang"):
                self.hreflang.append({"lang": a["hreflang"], "href": a.get("href", "")})
        elif tag == "a" and "href" in a:
            self.links.append(a["href"])
        elif tag == "img":
            self.images += 1
            self.missing += "alt" not in a
        elif tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        elif re.fullmatch("h[1-6]", tag):
            self._heading = (int(tag[1]), [])
        if a.get("itemtype"):
            self.types.append(a["itemtype"].rstrip("/").rsplit("/", 1)[-1])

    def handle_endtag(self, tag):
        self._close(tag)
        if tag in _NOT_QUALITY:
            self._not_quality = max(0, self._not_quality - 1)
        if tag in _BLOCKS and self._opening_depth >= 0:
            self.opening.append(" ")
        if tag in _BLOCKS:
            self.text.append(" ")
            self.prose.append(" ")
        if tag in _SILENT:
            self._silent, self._in_json = max(0, self._silent - 1), False
        elif tag in _CHROME:
            self._chrome = max(0, self._chrome - 1)
        elif tag == "title":
            self._in_title = False
        elif self._heading and tag == f"h{self._heading[0]}":
            words = " ".join("".join(self._heading[1]).split())
            if words:
                self.headings.append({"level": self._heading[0], "text": words})
            self._heading = None
        elif tag in ("p", "li", "ul", "ol", "article", "body"):
            self._end_block()

    def _end_block(self):
        if self._block:
            words = " ".join("".join(self._block).split())
            if words:
                self.blocks.append(words)
        self._block = None

    def handle_data(self, data):
        if not self._not_quality and data.strip():
            self.quality.append(data.strip())
        if self._in_json:
            self.json_ld[-1] += data
        if self._silent:
            return
        if self._in_title:
            self.title += data
            return
        self.text.append(data)
        if self._opening_depth >= 0:
            self.opening.append(data)
        for _, words in self._items:
            words.append(data)
        if not self._chrome:
            self.prose.append(data)
        for part in (self._heading and self._heading[1], self._block):
            if part is not None:
                part.append(data)


def _ld_authors(blocks: list[str]) -> tuple[list[str], list[str]]:
    """Types and authors of all nodes of JSON-LD blocks, lists and graphs down to depth 4; blocks that do not parse are left out."""
    types, authors = [], []

    def walk(node, depth):
        if depth > 4:
            return
        if isinstance(node, list):
            for x in node:
                walk(x, depth + 1)
        elif isinstance(node, dict):
            kinds = node.get("@type", [])
            types.extend(str(k) for k in (kinds if isinstance(kinds, list) else [kinds]))
            for key in ("author", "creator"):
                for a in node.get(key, []) if isinstance(node.get(key), list) else [node.get(key)]:
                    name = a.get("name") if isinstance(a, dict) else a
                    if isinstance(name, str) and 0 < len(name) <= 120:
                        authors.append(name)
            walk(node.get("@graph", []), depth + 1)

    for block in blocks:
        try:
            walk(json.loads(block), 0)
        except ValueError:
            continue
    return types, authors


def _ld_nodes(blocks: list[str]) -> list[dict]:
    """The objects of JSON-LD blocks, those of their graphs after each, down to depth 4; blocks that do not parse are left out."""
    found: list[dict] = []

    def add(nodes, depth):
        for node in nodes:
            if isinstance(node, dict):
                found.append(node)
                if depth < 4 and isinstance(node.get("@graph"), list):
                    add(node["@graph"], depth + 1)

    for block in blocks:
        try:
            parsed = json.loads(block)
        except ValueError:
            continue
        add(parsed if isinstance(parsed, list) else [parsed], 0)
    return found


def _ld_trail(node: dict) -> list[str]:
    items = node.get("itemListElement", [])
    names = []
    for item in items if isinstance(items, list) else [items]:
        if isinstance(item, dict):
            inner = item.get("item")
            name = item.get("name") if item.get("name") is not None else inner.get("name") if isinstance(inner, dict) else None
            name = " ".join(name.split()) if isinstance(name, str) else ""
            if name and len(name) <= 80:
                names.append(name)
    return names


def _ld_breadcrumbs(nodes: list[dict]) -> list[str]:
    """The trail of a breadcrumb list, else of any node that has one; two names at least, ten at most."""
    is_list = lambda n: "BreadcrumbList" in (n.get("@type") if isinstance(n.get("@type"), list) else [n.get("@type")])
    return next((t[:10] for t in map(_ld_trail, [*filter(is_list, nodes), *nodes]) if len(t) >= 2), [])


def _ld_text(nodes: list[dict], key: str) -> str:
    """The first text of a property: itself, one of a list, or its ``@value``."""
    for node in nodes:
        raw = node.get(key)
        for value in [raw] if isinstance(raw, str) else raw if isinstance(raw, list) else [raw.get("@value")] if isinstance(raw, dict) else []:
            if isinstance(value, str) and value.strip():
                return value.strip()
    return ""


def evidence(url: str | None, html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._end_block()
    clean = lambda parts: " ".join("".join(parts).split())
    types, authors = _ld_authors(page.json_ld)
    kept = {}
    for b in page.blocks:
        if 120 <= len(b) <= 900:
            kept.setdefault(b[:80], b)
    meta = page.meta
    nodes = _ld_nodes(page.json_ld)
    told, shown = _ld_breadcrumbs(nodes), page.trail()
    one_of = lambda *names: next((v for v in (" ".join(meta.get(n, "").split()) for n in names) if v), "")
    return {
        "title": " ".join(page.title.split()), "description": meta.get("description") or meta.get("og:description", ""), "robots": meta.get("robots", ""), "canonical": page.canonical,
        "viewport": meta.get("viewport", ""), "lang": page.lang, "h1": next((h["text"] for h in page.headings if h["level"] == 1), ""), "headings": page.headings[:60], "links": page.links,
        "images": page.images, "images_missing_alt": page.missing, "json_ld": page.json_ld, "item_types": list(dict.fromkeys([*types, *page.types])), "hreflang": page.hreflang,
        "authors": list(dict.fromkeys([*authors, *filter(None, [meta.get("author"), meta.get("article:author")])]))[:8], "times": list(dict.fromkeys(page.times))[:6],
        "paragraphs": list(kept.values())[:12], "text": clean(page.text), "prose": clean(page.prose) or clean(page.text),
        "opening": clean(page.text if page.opening is None else page.opening)[:600], "quality_text": " ".join(page.quality),
        "breadcrumbs": told or shown, "breadcrumb_source": "json-ld" if told else "markup" if shown else "microdata" if page.breadcrumb_type else "none",
        "published": _ld_text(nodes, "datePublished") or one_of("article:published_time", "publish_date"), "modified": _ld_text(nodes, "dateModified") or one_of("article:modified_time", "lastmod", "revised"),
        "meta_title": page.title.strip() or None, "meta_description": page.last.get("description"), "meta_robots": page.last.get("robots"), "meta_canonical": page.last.get("canonical"),
    }


def read_pages(raw: DataFrame) -> DataFrame:
    """Fetched documents (url, html, headers map, ...) that are pages: those whose content type names HTML, whatever the case of the header."""
    lower = F.map_from_entries(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return raw.filter(F.contains(F.coalesce(F.try_element_at(lower, F.lit("content-type")), F.lit("")), F.lit("html")))


def _pieces(batch: pa.RecordBatch, at_once: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``at_once`` bytes of html, one row at least."""
    sizes, start, held = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > at_once:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 1
    if start < len(sizes):
        yield batch.slice(start)


def extract_pages(pages: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """Page evidence of (page_id, url, html): what the job reads, and the columns that follow from it.

    A task holds what it made of about ``at_once`` bytes of html at a time, however many rows Spark hands it together.
    Links are resolved and classified after the job: internal ones have the page's host, ``www.`` apart.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, at_once):
                rows = [{"page_id": i, "url": u, **evidence(u, h)} for i, u, h in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)]
                for row in rows:
                    resolved = []
                    for link in row["links"]:
                        if not re.match(r"\s*(#|mailto:|tel:|javascript:)", link, re.I):
                            try:
                                resolved.append(urljoin(row["url"] or "", link.strip()))
                                urlsplit(resolved[-1])
                            except ValueError:
                                continue
                    row["links"] = resolved
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
            pa.default_memory_pool().release_unused()

    text, struct, strings = pa.string(), lambda **f: pa.list_(pa.struct(list(f.items()))), pa.list_(pa.string())
    kinds = {"headings": struct(level=pa.int32(), text=text), "hreflang": struct(lang=text, href=text), "page_id": pa.int64(), "images": pa.int32(), "images_missing_alt": pa.int32()}
    names = re.findall(r"(?:^|, )(\w+) (?=long|string|int|array)", SCHEMA)
    ARROW = pa.schema([(n, kinds.get(n, strings if n in ("links", "json_ld", "item_types", "authors", "times", "paragraphs", "breadcrumbs") else text)) for n in names])
    out = pages.select("page_id", "url", "html").mapInArrow(read, SCHEMA)
    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#:]*)", 1)), r"^www\.", "")
    own = host(F.coalesce("url", F.lit("")))
    words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))
    n_links = F.size("links")
    out = out.withColumns({"site": own, "internal": F.filter("links", lambda x: host(x) == own), "external": F.filter("links", lambda x: (host(x) != own) & (host(x) != "")), "words": words})
    return out.withColumns({
        "internal_links": F.size("internal"), "external_links": F.size("external"),
        "internal_targets": F.slice(F.array_distinct(F.transform("internal", lambda x: F.regexp_extract(x, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))), 1, 150),
        "alt_ratio": F.when(F.col("images") == 0, 1.0).otherwise(half_up((F.col("images") - F.col("images_missing_alt")) / F.col("images"), 3)),
        "link_density": F.when(n_links + F.col("words") == 0, 0.0).otherwise(half_up(n_links / F.greatest(F.lit(1), n_links + F.col("words")), 3)),
        "stated_dates": F.slice(F.array_distinct(F.filter(F.concat(F.transform("times", F.trim), F.regexp_extract_all("text", F.lit(STATED_DATE), F.lit(0))), lambda d: d != "")), 1, 6),
        "noindex": F.lower("robots").contains("noindex"), "has_viewport": F.col("viewport") != "", "has_https": F.coalesce(F.col("url").startswith("https:"), F.lit(False)), "has_schema": F.size("item_types") > 0,
    }).drop("internal", "external")


def meta_tags(evidence: DataFrame) -> DataFrame:
    """(page_id, url, title, description, robots, canonical, viewport, lang, hreflang) of evidence rows, for audits: the last of
    repeated tags counts, what a page does not have is null."""
    return evidence.select("page_id", "url", F.col("meta_title").alias("title"), F.col("meta_description").alias("description"), F.col("meta_robots").alias("robots"), F.col("meta_canonical").alias("canonical"), *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("viewport", "lang")], "hreflang")
