"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text of their paragraphs, less what is
in links. They vote, with their share of the page's score, for a generalised
path: the tags from the root with their classes, digits masked. Spark adds the
votes up by host; the path with most votes is the host's (ties: the first by
digest). A container inside an article or main stands for the nearest of them,
so that what is beside it there is kept. Every page is then extracted again from
the containers on its host's path. A page that has none on it, or none with
text, falls back on its own best container, and without any on all its text;
`path` is that of the container really used (null: none).

Left out: menus, headers and footers of the page, sidebars, notices, adverts,
forms, scripts, styles and reader comments, told by tag, role and hidden state,
and by name: a class, id or label all of whose parts say so or say nothing. Names of
headings and the ids of sections, which are slugs of their titles, count only if
they are plain. A block told by name alone is kept if it has a main element or a
first heading in it; one whose name also has other uses, if it has half of the
article's text (outside articles: of the page's). A header inside an article
keeps its headings. Character references are decoded, white space in a block
(line breaks included) becomes one space, blocks are trimmed and joined by a
line feed. A null or empty html gives an empty text; a null or odd url belongs
to the host ''. Repeated pages are extracted each. Very long pages are parsed
whole, in time that grows with their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialise

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title|canvas|audio|video|annotation|annotation-xml)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|style|aria-hidden|aria-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that start and end a block; all others are part of a line.
_BLOCK = frozenset(
    "html head body main article section nav aside header footer hgroup address div p pre blockquote center dialog dir menu ul ol li dl dt dd figure figcaption fieldset legend form details summary "
    "h1 h2 h3 h4 h5 h6 table caption colgroup thead tbody tfoot tr td th optgroup option datalist frameset noframes search".split()
)
_CONTAINER = frozenset("article body div main section td html center".split())
_NOISE_TAG = frozenset("nav footer aside form button dialog menu head fieldset input option datalist search".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
#: Parts of names: what is plainly not of the article; what is mostly not; and what says nothing about it.
_PLAIN = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars "
    "footer masthead topbar toolbar cookie cookies consent gdpr popup modal newsletter newsletters subscribe signup comment comments commentlist disqus respond pagination pager searchbox searchform outbrain taboola".split()
)
_MOSTLY = frozenset(
    "discussion discussions related recommended recommendations trending share sharing social widget widgets notice notices notification notifications disclaimer banner banners alert alerts toast overlay login "
    "search skip reply replies rail promotion promotions subscription teaser teasers".split()
)
_NEUTRAL = frozenset(
    "a and area article articles bar block blog body bottom box btn button buttons center col column container content cta entry external fixed floating footer form global grid group header icons in inner item items "
    "js large left link links list local main message mobile module more news of on outer page panel post posts primary right row secondary section site slot small stack sticky story stories text the thread to top "
    "unit user users view wide wrap wrapper".split()
)
_GOOD_WORD = frozenset("article content post entry story body text main page blog news".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_SELF_CLOSE = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose ids are slugs of titles.
_TITLED = _HEADING | {"section"}
#: Parts of a name: camel case and punctuation end one.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BODY = frozenset(("html", "body"))


class Node:
    __slots__ = ("tag", "key", "noise", "soft", "parent", "score", "first", "last", "article", "container", "heading", "link", "name", "named", "kept", "plain", "whole")

    def path(self) -> str:
        names, n = [], self
        while n.parent is not None:
            names.append(n.name)
            n = n.parent.container
        return ">".join(reversed(names))


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(raw)} if "=" in raw or "hidden" in raw.lower() else {}


def _parts(name: str) -> set[str]:
    return {p.lower() for p in _PART.findall(name)}


def _says(names: list[str]) -> str:
    """plain or mostly, if one of the names says so all through, or ''."""
    out = ""
    for x in names:
        p = _parts(x)
        if p & _PLAIN and p <= _PLAIN | _MOSTLY | _NEUTRAL:
            return "plain"
        if p & _MOSTLY and p <= _MOSTLY | _NEUTRAL:
            out = "mostly"
    return out


class Page:
    """Blocks of text in order, and containers with the range of blocks that each spans."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, Node]] = []  # text, characters in links, the node open at its end
        self.containers: list[Node] = []
        self._names: list[Node] = []  # nodes that their names tell to be of no article
        self._text: list[str] = []
        self._linked = 0
        root = Node()
        root.tag, root.key, root.noise, root.soft, root.parent, root.score = "", b"", False, False, None, 0.0
        root.first, root.last, root.article, root.container, root.heading, root.link, root.name = 0, 0, None, root, False, False, ""
        root.named, root.kept, root.plain, root.whole = None, True, False, False
        self.root = root
        self.stack = [root]
        self.containers.append(root)
        self._open_tags: Counter = Counter()
        at, m, end = 0, None, html.rfind(">") + 1
        for m in _TAG.finditer(html, 0, end):  # no tag ends later; looking for one at each < would take the square of what is left
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            name = m[3]
            if name is None:
                if m[1] and m[1].lower() not in ("noscript", "svg", "annotation", "annotation-xml", "select", "textarea"):
                    self._flush()
                continue
            name = name.lower()
            if m[2]:
                self._close(name)
            else:
                self._open(name, m[4])
        if m is not None and at == end and self._unclosed(m):
            at = len(html)
        if at < len(html):
            rest = html[at:]
            # A tag that the end of the page cuts off is no text.
            cut = re.search(r"<[/!a-zA-Z][^>]*\Z", rest)
            self._add(rest[: cut.start()] if cut else rest)
        self._flush()
        for n in self.stack:
            n.last = len(self.blocks)
        self._settle()

    @staticmethod
    def _unclosed(m: re.Match) -> bool:
        """Whether a comment or an element of raw text lasts until the end of the page."""
        if m[1]:
            return not re.fullmatch(rf"</{m[1]}\s*>", m[0][m[0].rfind("<") :], re.I)
        return m[0].startswith("<!--") and not (m[0].endswith("-->") and len(m[0]) > 6)

    def _add(self, raw: str) -> None:
        top = self.stack[-1]
        if top.noise:
            return
        self._text.append(raw)
        if top.link:
            self._linked += len(raw)

    def _flush(self) -> None:
        if not self._text:
            return
        raw = "".join(self._text)
        self._text.clear()
        linked, self._linked = self._linked, 0
        top = self.stack[-1]
        if not raw.isspace() and not (top.soft and not top.heading):
            text = " ".join(unescape(raw).split())
            if text:
                self.blocks.append((text, linked, top))

    def _settle(self) -> None:
        """Tells which of the named nodes are of the article after all, drops the blocks of the others, and scores the containers."""
        before = [0]
        for text, _, _ in self.blocks:
            before.append(before[-1] + len(text))
        for n in reversed(self._names):  # inner ones first
            if n.whole and n.parent.named is not None:
                n.parent.named.whole = True
        for n in self._names:
            room, outer = n.article or self.root, n.parent.named
            n.kept = n.whole or not n.plain and 2 * (before[n.last] - before[n.first]) >= before[room.last] - before[room.first] > 0
            n.kept = n.kept and (outer is None or outer.kept)
        self.noise = []
        for text, linked, top in self.blocks:
            noise = top.named is not None and not top.named.kept
            self.noise.append(noise)
            weight = max(len(text) - linked, 0)
            if not noise and weight >= 20:
                weight *= 1.0 if len(text) >= 60 else 0.5
                c = top.container
                c.score += weight
                if c.parent is not None:
                    c.parent.container.score += weight / 2
        self._like = Counter((n.parent.container, n.key) for n in self.containers if n.parent is not None and n.score > 0)

    def _open(self, name: str, raw: str) -> None:
        if name == "br" or name == "wbr":
            self._add(" " if name == "br" else "")
            return
        if name in _VOID:
            if name == "hr":
                self._flush()
            return
        block = name in _BLOCK
        if block:
            self._flush()
            if name in _CLOSES_P:
                self._pop_to({"p"}, _CONTAINER | {"li", "blockquote", "table"})
            if name in _SELF_CLOSE:
                ends, stop = _SELF_CLOSE[name]
                self._pop_to(set(ends.split()), stop)
        up = self.stack[-1]
        n = Node()
        n.tag, n.parent, n.score, n.first, n.last, n.name = name, up, 0.0, len(self.blocks), None, name
        n.noise, n.soft, n.article, n.heading, n.link, n.named = up.noise, up.soft, up.article, up.heading or name in _HEADING, up.link or name == "a", up.named
        n.kept, n.plain, n.whole = True, False, False
        own = name in ("article", "main")
        if name in ("main", "h1") and up.named is not None:
            up.named.whole = True
        a = _attributes(raw) if raw else {}
        classes = a["class"].split() if "class" in a else []
        if a:
            role = a.get("role", "").lower()
            own = own or role in ("main", "article") or "articlebody" in a.get("itemprop", "").lower()
            if role in _NOISE_ROLE or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
                n.noise = True
            if name not in _BODY and not own and not n.noise:
                ids = [*a.get("id", "").split(), *([a["aria-label"]] if "aria-label" in a else [])]
                says = _says(classes if name in _HEADING else classes + ids)
                if says == "mostly" and (name in _HEADING or name in _TITLED and _says(classes) != "mostly"):
                    says = ""
                if says and not block:
                    n.noise = n.noise or says == "plain"
                elif says:
                    n.named, n.kept, n.plain = n, False, says == "plain"
                    self._names.append(n)
                if block and name not in _HEADING and any("header" in (p := _parts(x)) and p <= _NEUTRAL for x in classes + ids):
                    n.soft, n.noise = True, n.noise or up.article is None
        if own and up.article is None:
            n.article = n
        if name in _NOISE_TAG:
            n.noise = True
        elif name == "header":
            n.soft, n.noise = True, n.noise or up.article is None
        if name in _CONTAINER and not n.noise:
            n.container = n
            n.name = ".".join([name, *sorted({re.sub(r"\d+", "#", c) for c in classes})])
            self.containers.append(n)
            n.key = md5(up.container.key + n.name.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        else:
            n.container, n.key = up.container, up.key
        self.stack.append(n)
        self._open_tags[name] += 1

    def _pop_to(self, names: set[str], stop: frozenset[str] | set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in names:
                self._drop(i)
                return
            if self.stack[i].tag in stop:
                return

    def _drop(self, i: int) -> None:
        for n in self.stack[i:]:
            n.last = len(self.blocks)
            self._open_tags[n.tag] -= 1
        del self.stack[i:]

    def _close(self, name: str) -> None:
        if name in _BLOCK:
            self._flush()
        if not self._open_tags[name]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == name:
                if name not in _BLOCK and any(n.tag in _BLOCK for n in self.stack[i + 1 :]):
                    return  # an inline end does not close blocks
                self._drop(i)
                return
            if name not in _CONTAINER and self.stack[i].tag in ("article", "main", "body") and name != "html":
                return

    def _worth(self, n: Node) -> float:
        words = _parts(n.name)
        return n.score * (2.0 if n.tag in ("article", "main") else 1.25 if words & _GOOD_WORD and n.tag != "body" else 1.0)

    def best(self) -> list[tuple[Node, float]]:
        """The containers that have text with their shares of worth, the largest first; of equals the first by order."""
        ranked = sorted(((n, self._worth(n)) for n in self.containers if n.score > 0), key=lambda x: -x[1])
        total = sum(w for _, w in ranked)
        return [(self._article(self._whole(n)), w / total) for n, w in ranked]

    def _article(self, n: Node) -> Node:
        """The article or main (by tag or role) that has the container, for headings and leads beside it: the nearest by tag, else the outermost by role; else itself."""
        if n.article is None:
            return n
        up = n
        while up is not None and up.tag not in ("article", "main") and up is not n.article:
            up = up.parent.container if up.parent is not None else None
        return n if up is None else up

    def _whole(self, n: Node) -> Node:
        """Like siblings with text (sections of one text) stand for their parent."""
        up = n.parent.container if n.parent is not None else None
        if up is None or n.tag in ("article", "main", "body") or up.tag in ("", "html"):
            return n
        return up if self._like[up, n.key] > 1 else n

    def texts(self, nodes: list[Node]) -> list[str]:
        out, end = [], 0
        for n in nodes:  # in order of their starts; what an outer one has, an inner one doesn't repeat
            out += [self.blocks[i][0] for i in range(max(n.first, end), n.last) if not self.noise[i]]
            end = max(end, n.last)
        return out

    def extract(self, key: bytes | None) -> tuple[str, str | None]:
        """The text and the path of the container used; key: that of the host's path."""
        if key is not None and (nodes := [n for n in self.containers if n.key == key and n.parent is not None]) and (got := self.texts(nodes)):
            return "\n".join(got), nodes[0].path()
        top = self.best()
        if top and top[0][0].parent is not None and (got := self.texts([top[0][0]])):
            return "\n".join(got), top[0][0].path()
        return "\n".join(b[0] for b, noise in zip(self.blocks, self.noise, strict=True) if not noise), None  # no paragraph of any length


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """host, path (its digest), votes: added up in each task first, so that a large host sends little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: Counter = Counter()
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, share in Page(html).best() if html else ():
                    held[host, n.key] += round(share * 1e6)  # whole numbers add up alike in any order
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held]), pa.array([p for _, p in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["host", "path", "votes"])

    found = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path binary, votes bigint")
    return found.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path of most votes; of equals the first by digest."""
    top = votes(pages).groupBy("host").agg(F.min(F.struct(-F.col("votes"), "path")).alias("t"))
    return top.select("host", F.col("t.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used for each row of pages; other columns are left out."""
    winners = materialise(host_paths(pages), "html-paths").toDF("winner", "key")
    # Its files' size tells Spark whether the paths of all hosts can be broadcast.
    both = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")).join(winners, F.col("host") == F.col("winner"), "left")

    def run(htmls: list[str | None], keys: list[bytes | None]) -> list[pa.Array]:
        got = [Page(h).extract(k) if h else ("", None) for h, k in zip(htmls, keys, strict=True)]
        return [pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string())]

    return map_columns(both, ["html", "key"], "text string, n_chars bigint, path string", run, ["page_id", "url"])
