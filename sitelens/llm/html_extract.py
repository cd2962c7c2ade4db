"""Main text of web pages by wrappers: union-free regular expressions over the tokens of a host's pages.

A page is a stream of tags and texts, nested by its tags; texts with inline markup are one token. What follows itself in a
page becomes a repeated group. Pages of a host are aligned one after another, in tasks first and then task by task, with
what was inferred so far: where texts differ, the place becomes a slot, and what only some pages have becomes optional.
Every page is then walked along its host's wrapper: text that is the same on the host's pages is the site's, slots are the page's.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import saved

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "table", "tbody", "thead", "tr", "td", "th", "figure", "figcaption"}
#: Which open element ends where one of these begins.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_APART = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "menu", "dialog", "head", "title", "textarea", "object", "canvas", "audio", "video", "map"}
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: A class or id that is made of these words alone, at least one of the first list, says that its element is not the article.
_APART_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices comment comments commentlist disqus replies respond share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay widget widgets login signup toolbar masthead".split())
_PLAIN_WORDS = set("area articles bar block bottom box buttons container content form global header icons inner left link links list main media outer page posts primary right row secondary section site slot sticky text top unit wrap wrapper".split())
_CONTENT = {"article", "main"}
_CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body-text|article-body)(?:$|[\s_-])", re.I)
_DEPTH = 64  # levels of blocks that a wrapper tells apart; what is nested more deeply is text of the last
_WIDE = 64  # parts of an element that are kept in order


class Node:
    """An element of a page, or a text; ``apart``: 2 if it is by its tag no part of an article, 1 if its class or id says so."""

    __slots__ = ("tag", "sig", "apart", "kids", "text", "at", "block")

    def __init__(self, tag: str, sig: str, apart: int, text: str | None, at: int):
        self.tag, self.sig, self.apart, self.kids, self.text, self.at, self.block = tag, sig, apart, [], text, at, tag in _BLOCK or apart > 0


def _says_apart(label: str) -> int:
    """2 if a whole class or id is a name of what is not the article, 1 if one is made of such names, else 0."""
    found = 0
    for token in label.lower().split():
        if token in _APART_WORDS:
            return 2
        words = [x for x in re.split(r"[-_0-9]+", token) if x]
        if words and any(x in _APART_WORDS for x in words) and all(x in _APART_WORDS or x in _PLAIN_WORDS for x in words):
            found = 1
    return found


def parse(text: str) -> Node:
    """The root of a page's elements and decoded texts.

    Class and id alone don't say that an element is apart if it holds the page's main element, or most text of its articles,
    or, unless a whole class or id is such a name, most text of the page. A header is apart unless it holds the title. End
    tags that HTML implies are put in; a tag cut off by the end of the page is dropped.
    """
    root = Node("", "", 0, None, 0)
    root.block = True
    stack, at, n = [root], 0, 0
    open_ = Counter()
    by_name: list[tuple[Node, bool]] = []
    headers: list[tuple[Node, bool]] = []

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    while True:
        m = _TOKEN.search(text, at)
        piece = text[at : m.start() if m else len(text)]
        if piece:
            n += 1
            stack[-1].kids.append(Node("#text", "#text", 0, html.unescape(piece) if "&" in piece else piece, n))
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag or not m[4]:
            continue
        if m[1]:
            if open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in ("article", "main", "body") and tag not in _BLOCK:
                        break
            continue
        if tag in _BLOCK and open_["p"]:  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _CLOSES and any(open_[x] for x in _CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        names = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[3])} if m[3] and "=" in m[3] else {}
        label = " ".join(filter(None, (names.get("class"), names.get("id"))))
        apart = 2 if tag in _APART or names.get("role", "").lower() in _ROLES or "hidden" in m[3].lower().split() else 0
        said = _says_apart(label) if label and not apart and tag not in ("html", "body", "article", "main") else 0
        n += 1
        node = Node(tag, f"{tag}.{re.sub(r'[0-9]+', '#', label)}" if label else tag, apart or min(said, 1), None, n)
        stack[-1].kids.append(node)
        if said:
            by_name.append((node, said == 2))
        if tag == "header" and not apart:
            headers.append((node, open_["article"] + open_["main"] > 0))
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            stop = text.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else len(text)
            continue
        open_[tag] += 1
        stack.append(node)
    for node, inside in headers:
        wanted = {"h1", "h2", "h3", "h4", "h5", "h6", "article", "main"} if inside else {"h1", "article", "main"}
        if not any(x.tag in wanted for x in _below(node)):
            node.apart = 2
    if by_name:
        _keep_large(root, by_name)
    return root


def _below(node: Node) -> Iterator[Node]:
    """The elements inside an element, in page order."""
    todo = node.kids[::-1]
    while todo:
        n = todo.pop()
        if n.text is None:
            yield n
            todo.extend(reversed(n.kids))


def _keep_large(root: Node, by_name: list[tuple[Node, bool]]) -> None:
    """Takes back that an element is apart by its class or id where the article is inside."""
    sizes: dict[int, tuple[int, int, bool]] = {}  # characters, those in articles below, whether a main element is inside
    todo = [(root, False)]
    while todo:
        n, done = todo.pop()
        if n.apart == 2:
            sizes[n.at] = 0, 0, False
        elif not done:
            todo.append((n, True))
            todo.extend((c, False) for c in n.kids if c.text is None)
        else:
            below = [sizes[c.at] for c in n.kids if c.text is None]
            chars = sum(len(c.text.strip()) for c in n.kids if c.text is not None) + sum(x[0] for x in below)
            sizes[n.at] = chars, chars if n.tag in _CONTENT else sum(x[1] for x in below), n.tag == "main" or any(x[2] for x in below)
    chars, articles, _ = sizes[root.at]
    for n, whole in by_name:
        a, b, c = sizes.get(n.at, (0, 0, False))  # nothing is known of what stands in an element apart by its tag
        if c or 2 * b > articles or not whole and 2 * a > chars:
            n.apart = 0


# ---- wrappers --------------------------------------------------------------------------------------------------------


class Part:
    """A part of a wrapper: an element, or a text (one that differs from page to page is None: a slot).

    ``n``: on how many pages it is; fewer than its parent make it optional. ``members``: what of one page it stands for.
    """

    __slots__ = ("sig", "name", "apart", "repeat", "n", "text", "chars", "links", "parts", "members", "const", "mass")

    def __init__(self, sig, name, apart, repeat, n, text, chars, links, parts, members=()):
        self.sig, self.name, self.apart, self.repeat, self.n, self.text = sig, name, apart, repeat, n, text
        self.chars, self.links, self.parts, self.members, self.const, self.mass = chars, links, parts, list(members), False, 0.0

    def dump(self) -> list:
        return [self.sig, self.name, self.apart, self.repeat, self.n, self.text, self.chars, self.links, [p.dump() for p in self.parts]]

    @staticmethod
    def load(x: list) -> Part:
        return Part(*x[:8], [Part.load(p) for p in x[8]])


def _alike(p: Part, q: Part) -> float:
    """How many of the kinds of parts of two parts they share: 0 to 1."""
    a, b = {x.sig for x in p.parts}, {x.sig for x in q.parts}
    return len(a & b) / len(a | b) if a or b else 1.0


def _aligned(xs: list[Part], ys: list[Part]) -> list[tuple[Part | None, Part | None]]:
    """Two lists of parts side by side, in order: as many of equal kind as can be, of equally many those whose own parts are most alike."""
    a, b = [p.sig for p in xs], [p.sig for p in ys]
    if a == b:
        return list(zip(xs, ys, strict=True))
    n, m = len(a), len(b)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    gain = {}
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            top = below[j] if below[j] >= row[j + 1] else row[j + 1]
            if a[i] == b[j]:
                gain[i, j] = g = 1 + _alike(xs[i], ys[j]) / 2 + below[j + 1]
                top = max(top, g)
            row[j] = top
    out, i, j = [], 0, 0
    while i < n and j < m:
        if gain.get((i, j)) == best[i][j]:
            out.append((xs[i], ys[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] == best[i][j]:
            out.append((xs[i], None))
            i += 1
        else:
            out.append((None, ys[j]))
            j += 1
    return out + [(x, None) for x in xs[i:]] + [(None, y) for y in ys[j:]]


def _absorb(x: Part, y: Part, pages: bool) -> None:
    """Makes ``x`` stand for both; ``pages``: whether they are of different pages."""
    x.n = x.n + y.n if pages else max(x.n, y.n)
    x.chars, x.links, x.repeat = x.chars + y.chars, x.links + y.links, x.repeat or y.repeat
    x.members += y.members
    if x.text != y.text:
        x.text = None
    if not x.parts or not y.parts:
        x.parts = x.parts or y.parts
        return
    merged = []
    for p, q in _aligned(x.parts, y.parts):
        if p is not None and q is not None:
            _absorb(p, q, pages)
        merged.append(p if p is not None else q)
    x.parts = _grouped(merged)


def _follows(p: Part, q: Part) -> bool:
    """Whether ``q`` repeats ``p``: the same kind, and for blocks that hold others, some of the same parts."""
    return p.sig == q.sig and (p.sig == "#text" or p.name in _LEAF or _alike(p, q) > 0)


def _grouped(parts: list[Part]) -> list[Part]:
    """What follows itself, alone or in runs of up to four parts, as repeated groups.

    More than a fixed number of parts become one repeated group of optional parts, each kind once, by tag alone if kinds are as many.
    """
    out: list[Part] = []
    for p in parts:
        out.append(p)
        for k in (1, 2, 3, 4):
            if len(out) < 2 * k or k == 1 and p.sig == "#text":
                continue
            if all(_follows(out[i - k], out[i]) for i in range(-k, 0)):
                for i in range(-k, 0):
                    _absorb(out[i - k], out[i], False)
                    out[i - k].repeat = True
                del out[-k:]
                break
    if len(out) <= _WIDE:
        return out
    by_sig = len({p.sig for p in out}) <= _WIDE
    kinds: dict[str, Part] = {}
    for p in out:
        key = p.sig if by_sig else p.name
        if key in kinds:
            _absorb(kinds[key], p, False)
        else:
            kinds[key] = p
            p.sig, p.repeat = key, True
    return list(kinds.values())


def fold(root: Node) -> Part:
    """The wrapper of one page."""
    order: list[tuple[Node, int]] = []
    todo = [(root, 0)]
    while todo:
        n, depth = todo.pop()
        order.append((n, depth))
        if n.apart < 2:
            todo.extend((c, depth + (c.tag in _BLOCK)) for c in reversed(n.kids) if c.text is None)
    for n, _ in reversed(order):  # an inline element with a block inside is structure as well
        n.block = n.block or n.apart < 2 and any(c.block for c in n.kids)
    for n, depth in order:
        n.block = n.block and depth <= _DEPTH
    made: dict[int, Part] = {}
    for n, _ in reversed(order):
        if not n.block:
            continue
        parts: list[Part] = []
        run: list[Node] = []
        links = 0

        def end() -> None:
            nonlocal links
            text = " ".join("".join(c.text for c in run).split())
            if text:
                key = text if len(text) <= 80 else f"{text[:60]}…{len(text)}…{text[-12:]}"
                parts.append(Part("#text", "#text", 0, False, 1, key, len(text), links, [], [list(run)]))
            run.clear()
            links = 0

        inner = [(c, False) for c in reversed(n.kids)] if n.apart < 2 else []
        while inner:
            c, link = inner.pop()
            if c.text is not None:
                run.append(c)
                links += len(c.text) if link else 0
            elif c.block:
                end()
                parts.append(made.pop(c.at))
            elif c.apart < 2:
                inner.extend((x, link or c.tag == "a") for x in reversed(c.kids))
        end()
        made[n.at] = Part(n.sig, n.tag, n.apart, False, 1, None, 0, 0, _grouped(parts), [n])
    return made[root.at]


def _pruned(wrapper: Part, most: int) -> Part:
    """At most ``most`` parts: those on the most pages, outer ones first. What is left out aligns with nothing, and so counts as a slot."""
    every, level = [], [wrapper]
    while level:
        every += level
        level = [p for x in level for p in x.parts]
    if len(every) > most:
        kept = {id(p) for p in sorted(every, key=lambda p: -p.n)[:most]}
        for p in every:
            p.parts = [x for x in p.parts if id(x) in kept]
    return wrapper


def infer_wrapper(pages: list[str]) -> Part:
    """Aligns the pages one after another."""
    wrapper = None
    for page in pages:
        own = fold(parse(page))
        if wrapper is None:
            wrapper = own
        else:
            _absorb(wrapper, own, True)
    return wrapper


def expression(part: Part, of: int = 0) -> str:
    """The wrapper as text: (…)+ repeats, (…)? may be absent, #SLOT is a text that changes."""
    body = ("#SLOT" if part.text is None else part.text) if part.sig == "#text" else "".join(expression(p, part.n) for p in part.parts)
    body = body if part.sig in ("#text", "") else f"<{part.sig}>{body}"
    body = f"({body})+" if part.repeat else body
    return f"({body})?" if part.n < of else body


# ---- extraction ------------------------------------------------------------------------------------------------------


def _weigh(part: Part, own: Part | None, pages: int) -> None:
    """Sets how much text of its page each part holds: that of its place on the host's pages, a tenth of it if it is the same on all."""
    if part.sig == "#text":
        part.const = own is not None and own.n >= 3 and 2 * own.n >= pages and own.text is not None and own.text == part.text
        part.mass = (own.chars / own.n if own is not None else part.chars) * (0.1 if part.const else 1.0)
        return
    for p, q in _aligned(own.parts if own is not None else [], part.parts):
        if q is not None:
            _weigh(q, p, pages)
    part.mass = 0.0 if part.apart else sum(p.mass for p in part.parts)


def _place(page: Part, share: float = 0.6) -> list[Part]:
    """The parts that are the article: article or main elements with enough of the text, else the smallest block with most of it."""
    found, todo = [], [(page, 0)]
    while todo:
        p, depth = todo.pop()
        for name in ("article", "main"):
            own = [x for x in p.parts if x.name == name and not x.apart]
            if own:
                found.append((sum(x.mass for x in own), depth, own))
        todo.extend((x, depth + 1) for x in reversed(p.parts) if not x.apart)
    found = [x for x in found if x[0] >= 0.3 * page.mass]
    if found:
        most = max(x[0] for x in found)
        return max((x for x in found if x[0] >= share * most), key=lambda x: x[1])[2]
    while True:
        inner = [x for x in page.parts if x.name in _BLOCK and x.name not in _LEAF and not x.apart]
        big = max(inner, key=lambda x: x.mass * (1.5 if _CONTENT_NAME.search(x.sig.partition(".")[2]) else 1), default=None)
        if big is None or big.mass < share * page.mass or big.mass == 0:
            return [page]
        page = big


def _site_texts(place: list[Part]) -> set[int]:
    """Of the texts of a place, those that the host's pages share: before the first and after the last of the page's own, and lists of links."""
    runs, todo = [], list(place)
    while todo:
        p = todo.pop()
        if p.sig == "#text":
            runs += [(run[0].at, p.const, p.links >= 0.8 * p.chars, run) for run in p.members]
        todo.extend(x for x in p.parts if not x.apart)
    runs.sort(key=lambda x: x[0])
    own = [i for i, x in enumerate(runs) if not x[1]]
    if not own:
        return set()
    return {c.at for i, (_, const, links, run) in enumerate(runs) if const and (i < own[0] or i > own[-1] or links) for c in run}


def main_text(page: str, wrapper: Part | None = None) -> str:
    """The blocks of a page's article, one a line, found along the wrapper of its host."""
    root = parse(page)
    folded = fold(root)
    _weigh(folded, wrapper, wrapper.n if wrapper is not None else 1)
    place = _place(folded)
    left_out = _site_texts(place) if place[0].name != "article" else set()
    tops = sorted((n for p in place for n in p.members), key=lambda n: n.at)
    blocks, part = [], []

    def end() -> None:
        text = " ".join("".join(part).split())
        part.clear()
        if text:
            blocks.append(text)

    todo: list = tops[::-1]
    while todo:  # no recursion: pages may be nested deeply
        n = todo.pop()
        if n is None:
            end()
        elif n.text is not None:
            if n.at not in left_out:
                part.append(n.text)
        elif not n.apart:
            if n.tag in ("br", "td", "th"):
                part.append(" ")
            if n.tag in _BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(n.kids))
    end()
    return "\n".join(blocks)


def _host(url) -> str:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))


def infer_wrappers(pages: DataFrame, *, most_parts: int = 2000, salts: int = 32, held_parts: int = 200_000) -> DataFrame:
    """(host, pages, wrapper) from all rows of ``pages`` (url, html); ``wrapper`` is JSON for ``Part.load``, and ``expression`` shows it.

    A task aligns the pages of each host that it reads; what the tasks found of a host is then aligned in ``salts`` groups and
    these with one another, so that no task meets all pages of a host. A wrapper has at most ``most_parts`` parts, those on most pages.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Part] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(h, w.n, json.dumps(_pruned(w, most_parts).dump())) for h, w in held.items()]
            held.clear()
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "pages", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own = fold(parse(page))
                own.n = 1
                if host not in held:
                    held[host] = _bare(own)
                else:
                    _absorb(held[host], _bare(own), True)
                    if held[host].n % 64 == 0:
                        _pruned(held[host], most_parts)
                size += 1
                if size * 16 > held_parts:
                    yield flush()
                    size = 0
        yield flush()

    def merge(key, table):
        rows = sorted(zip(table["pages"].to_pylist(), table["wrapper"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        wrapper = Part.load(json.loads(rows[0][1]))
        for _, text in rows[1:]:
            _absorb(wrapper, Part.load(json.loads(text)), True)
            _pruned(wrapper, most_parts)
        return pa.table({"host": [key[0].as_py()], "pages": [wrapper.n], "wrapper": [json.dumps(wrapper.dump())]})

    kind = "host string, pages long, wrapper string"
    found = pages.filter("html is not null").select(_host("url").alias("host"), "html").mapInArrow(read, kind)
    some = found.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt").applyInArrow(merge, kind)
    return some.groupBy("host").applyInArrow(merge, kind)


def _bare(part: Part) -> Part:
    """A page's wrapper without what it holds of the page."""
    todo = [part]
    while todo:
        p = todo.pop()
        p.members = []
        todo += p.parts
    return part


def extract_text(pages: DataFrame, *, most_parts: int = 2000, broadcast_bytes: int = 32 << 20, salts: int = 64) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Menus, headers without the title, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out, and
    around the article what is the same on most of the host's pages (of three or more). Blocks are in page order, one a line,
    white space in them is one space. A null or empty html gives an empty text; pages of a null url, or one without ``://``,
    make one host. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    Wrappers of up to ``broadcast_bytes`` in all are sent to all tasks; more meet the pages by host and one of ``salts``
    salts, so that a host with many pages has many tasks.
    """
    pages = pages.select("page_id", "url", "html").withColumn("host", _host("url"))
    wrappers = saved(infer_wrappers(pages, most_parts=most_parts).select("host", "wrapper"), "wrappers")
    if (wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= broadcast_bytes:
        joined = pages.join(F.broadcast(wrappers), "host", "left")
    else:
        salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Part] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper"), strict=True):
                if not page:
                    texts.append("")
                    continue
                wrapper = wrapper.as_py()
                if wrapper not in known:
                    if len(known) > 500:
                        known.clear()
                    known[wrapper] = Part.load(json.loads(wrapper)) if wrapper else None
                texts.append(main_text(page, known[wrapper]))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
