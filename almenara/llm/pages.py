"""HTML extraction with site template removal.

A page is read into elements by a forgiving parser (elements that are never closed, stray end tags, raw text). Every
block element's subtree, its tag, the structure below it and its text, has a hash. Spark counts on how many pages of
a host, told apart by their main text, each hash stands; subtrees that recur on ``MIN_PAGES`` of them and on a share
of at least ``SHARE`` are the site's template and are deleted. A host has no more of them than elements per page
divided by that share, so its list is small; the lists are broadcast only below ``BROADCAST_HASHES`` hashes in all.
Copies of one article under several addresses count once, so copying a page does not make its text a template.

Besides, what names itself as no part of the article goes: menus, page headers, footers, sidebars, notices, adverts,
forms, reader comments, scripts and styles, by element, role, class or id. A name with has, no or with says nothing of
the element itself. Inside article or main an id whose words the first heading repeats is an anchor and does not count,
save for a few words such as comments; an id of several words on a section counts only as a whole; on headings,
paragraphs and parts of tables only a class that is such a word. Names of what holds main, or most of the text with a
title or article, do not count, nor do any if they leave nothing. The main text is that of the article elements (several
of them beside a main that holds text are teasers and go), else of main, else of the largest container called content
and its siblings of that name, if they hold most of the text that is left; else all of it.

Character references are decoded, white space within a block becomes one space, blocks are joined in page order by an
empty line. Null html gives an empty text. A url without a host belongs to no site: no template is sought there.
Repeated rows are extracted alike; columns ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator, Set
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.llm.columns import small
from almenara.session import pin

MIN_PAGES = 5
SHARE = 0.3
BROADCAST_HASHES = 300_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: The same where quotes never close, so that no tag is read to the end of the page again and again.
PLAIN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|(?!)()()|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
BROKEN_TAGS = 20
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements of HTML by their kind, and names by which pages call what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg annotation annotation-xml canvas select xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup html body".split())
DROPPED = frozenset("nav footer aside form button dialog menu head search fieldset label input".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
NOT_ARTICLE = frozenset(
    "nav navbar navigation navigator menu menubar breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer foot masthead topbar banner ad ads advert adverts advertisement "
    "advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing sharebar related recommended recommendations comment comments commentlist disqus respond replies pagination pager toolbar "
    "search form forms".split()
)
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p table caption thead tbody tfoot tr td th pre blockquote figcaption dl dt dd hgroup math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ALWAYS = frozenset(
    "comment comments commentlist commentsarea disqus respond replies ad ads advert adverts advertisement advertising sponsor sponsored promo promoted related recommended "
    "relatedarticles relatedposts relatedstories relatedcontent relatedpages newsletter newslettersignup subscribe subscription signup login share sharing social cookie cookies "
    "consent gdpr pagination pager breadcrumb breadcrumbs sidebar widget".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies ad ads advert advertisement sponsored promo related recommended widget sidebar".split())
HEADERS = frozenset("header head".split())
MODIFIERS = frozenset("has no not with without".split())
CONTAINERS = frozenset("div section td center".split())
CONTENT = frozenset("content article post entry story maincontent".split())


class Names(NamedTuple):
    """Words of class, id and role, whether the element is hidden, the words that the id alone gives, the letters of
    the id, and the classes as they stand."""

    words: Set[str]
    hidden: bool
    by_id: Set[str]
    anchor: str
    tokens: Set[str]


NAMELESS = Names(frozenset(), False, frozenset(), "", frozenset())


def names_of(tag: str, attributes: str) -> Names:
    words: set[str] = set()
    classes: set[str] = set()
    by_id: set[str] = set()
    tokens: set[str] = set()
    anchor = ""
    hidden = False
    for name, a, b, c in NAMES.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            own: set[str] = set()
            for one in value.split():
                whole = re.sub(r"[^A-Za-z]+", "", one).lower()  # side-bar
                own.add(whole)
                for part in re.split(r"[^A-Za-z]+", one):
                    pieces = [w.lower() for w in PIECE.findall(part)]
                    stop = next((k for k, w in enumerate(pieces) if w in MODIFIERS), None)
                    own.update(pieces[:stop])
                    if stop is not None:  # no-sidebar, content-with-sidebar, hasComments: not what it is
                        break
                    own.add(part.lower())
                if name == "id":
                    anchor = whole
                    by_id |= own
                else:
                    tokens.add(one.lower())
                    classes |= own
            words |= own
        elif name == "role":
            words.update("role:" + w for w in value.lower().split())
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":  # hides from screen readers; closed dialogs and menus use it as well
            hidden |= value.lower() == "true" and tag in BLOCK
        elif re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return Names(words, hidden, by_id - classes, anchor, tokens)


class Page:
    """Elements in page order (parent first) and text segments (block number, element, text)."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.words = ["#page"], [0], [NAMELESS]
        self.parts: list[list] = [[]]
        self.segments: list[tuple[int, int, str]] = []
        self.block = 0
        self.anchored: set[int] = set()
        stack, at, n = [0], 0, len(source)
        last, broken = source.rfind(">") + 1, 0  # nothing after the last > is a tag
        while at < n:
            m = (TAG if broken < BROKEN_TAGS else PLAIN).search(source, at, last)
            end = m.start() if m else n
            if end > at:
                self.text(stack[-1], source[at:end])
            if not m:
                break
            at = m.end()
            broken += m.group(4) is not None
            if at == last and source.startswith("<!--", m.start()) and not source.endswith("-->", 0, at):
                break  # a comment that never ends
            closing, opening, attributes = m.group(1), m.group(2) or m.group(4), m.group(3) or m.group(5) or ""
            if closing:
                self.close(stack, closing.lower())
            elif opening:
                tag = opening.lower()
                if tag in RAW:
                    if not attributes.endswith("/") or tag != "svg":
                        stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at, last)
                        at = stop.end() if stop else n
                    continue
                self.open(stack, tag, attributes)

        self.anchored = self.anchors()
        self.in_main: set[int] = set()
        self.beside_main = 0  # outermost articles outside main
        within: set[int] = set()
        for k in range(1, len(self.tag)):
            if self.parent[k] in self.in_main or self.tag[k] == "main" or "role:main" in self.words[k][0]:
                self.in_main.add(k)
            elif self.parent[k] in within or self.tag[k] == "article":
                self.beside_main += self.parent[k] not in within
                within.add(k)

    def text(self, node: int, raw: str) -> None:
        self.segments.append((self.block, node, raw))
        self.parts[node].append(raw)

    def open(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(stack[-1], " ")
            return
        if tag in VOID:
            self.block += tag == "hr"
            return
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == "p":
                    del stack[k:]
                    break
                if self.tag[stack[k]] in BLOCK:
                    break
        if tag in SAME:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in SAME[tag]:
                    del stack[k:]
                    if tag != "tr" or self.tag[stack[-1]] != "tr":
                        break
                elif self.tag[stack[k]] in ("ul", "ol", "dl", "table", "select", "menu") or tag != "tr" and self.tag[stack[k]] in BLOCK:
                    break
        if tag in BLOCK:  # no block stands in the head
            for k in range(1, min(3, len(stack))):
                if self.tag[stack[k]] == "head":
                    del stack[k:]
                    break
        above = stack[-1]
        self.words.append(names_of(tag, attributes) if attributes else NAMELESS)
        self.parts[above].append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(above)
        self.parts.append([])
        self.block += tag in BLOCK
        if not attributes.endswith("/"):
            stack.append(len(self.tag) - 1)

    def close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                self.block += tag in BLOCK or any(self.tag[s] in BLOCK for s in stack[k:])
                del stack[k:]
                return
            if tag not in BLOCK and self.tag[stack[k]] in BLOCK:
                return
        self.block += tag in BLOCK

    def hashes(self) -> list[int]:
        """A number for each element's subtree; 0 for inline elements, empty ones and the page itself."""
        digest: list[bytes] = [b""] * len(self.tag)
        out = [0] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            text = [digest[x] if isinstance(x, int) else " ".join(x.split()).encode("utf-8", "surrogatepass") for x in self.parts[k]]
            text = [t for t in text if t]
            if text:
                digest[k] = blake2b(b"\x00".join([self.tag[k].encode("utf-8", "surrogatepass"), *text]), digest_size=8).digest()
                if self.tag[k] in BLOCK:
                    out[k] = int.from_bytes(digest[k], "little", signed=True) or 1
        return out

    def anchors(self) -> set[int]:
        """Elements whose id repeats the words of their first heading: an anchor, not a name."""
        out = set()
        for k in range(1, len(self.tag)):
            if self.words[k].anchor:
                head = k if self.tag[k] in HEADINGS else next((x for x in self.parts[k] if isinstance(x, int)), 0)
                if self.tag[head] in HEADINGS:
                    said = re.sub(r"[^A-Za-z]+", "", entities.unescape(self.inner(head))).lower()
                    if said == self.words[k].anchor:
                        out.add(k)
        return out

    def inner(self, node: int) -> str:
        todo, out = [node], []
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                todo.extend(reversed(self.parts[x]))
            else:
                out.append(x)
        return "".join(out)

    def judged(self, names: bool, spared: frozenset[int] = frozenset()) -> tuple[list[bool], list[int], list[int]]:
        """For each element whether it is dropped, its kind of root (2 article, 1 main, negative: the number of an
        element called content) and the outermost element whose name dropped it; ``spared`` ignore their names."""
        dropped, kinds, named, inside = [False], [0], [0], [False]
        for k in range(1, len(self.tag)):
            tag, above, (words, hidden, by_id, anchor, tokens) = self.tag[k], self.parent[k], self.words[k]
            body = inside[above]
            inside.append(body or tag in ("article", "main") or "role:main" in words)
            drop, kind, by = dropped[above], kinds[above], named[above]
            roles = {w[5:] for w in words if w.startswith("role:")} if words else words
            main = tag == "main" or "main" in roles
            hard = hidden and tag != "html"
            if tag not in ("html", "body") and not main and tag != "article":
                hard |= tag in DROPPED or bool(roles & ROLES) or kind != 2 and tag == "header"
            if hard:
                drop, by = True, 0
            elif not drop and names and k not in spared and tag not in ("html", "body") and not main:
                if body and tag in TEXT_TAGS:
                    words = tokens & ALWAYS
                elif body and k in self.anchored and anchor not in ALWAYS:
                    words = words - by_id
                elif body and tag == "section":
                    words = words - by_id | ({anchor} & by_id)
                called = words & COMMENTS if tag == "article" else words & NOT_ARTICLE or kind != 2 and words & HEADERS
                if called:
                    drop, by = True, k
            if not drop and kind < 2:
                kind = 2 if tag == "article" else 1 if kind == 1 or main else kind
            if not drop and kind == 0 and tag in CONTAINERS and words & CONTENT:
                kind = -k
            dropped.append(drop)
            kinds.append(kind)
            named.append(by)
        return dropped, kinds, named

    def spared(self) -> frozenset[int]:
        """Elements whose names do not count: they hold main, or a title or article and most of the page's text."""
        out: set[int] = set()
        while True:
            dropped, _, named = self.judged(True, frozenset(out))
            held: dict[int, int] = {}
            total = 0
            for _, node, text in self.segments:
                if named[node] or not dropped[node]:
                    n = len(text.strip())
                    total += n
                    held[named[node]] = held.get(named[node], 0) + n
            new = set()
            for k, by in enumerate(named):
                if by and (self.tag[k] == "main" or "role:main" in self.words[k][0]):
                    new.add(by)
                elif by and 2 * held.get(by, 0) > total and (self.tag[k] == "h1" or self.tag[k] == "article" and not self.words[k][0] & COMMENTS):
                    new.add(by)
            if not new:
                return frozenset(out)
            out |= new

    def main_text(self, template: set[int] | None = None) -> str:
        """The text of the narrowest root that holds most of what is left without dropped elements and templates.

        If names leave nothing, they do not count."""
        recurring = self.hashes() if template else []
        for names in (True, False):
            gone, kinds, _ = self.judged(names, self.spared() if names else frozenset())
            if template:
                for k, h in enumerate(recurring):
                    gone[k] = gone[k] or gone[self.parent[k]] or h in template
            kept = [s for s in self.segments if not gone[s[1]]]
            size: dict[int, int] = {}
            for _, node, text in kept:
                size[kinds[node]] = size.get(kinds[node], 0) + len(text.strip())
            # Several articles beside a main that holds text are teasers of others, kind 3; a single one stays.
            whole = sum(size.values())
            if self.in_main and any(text.strip() for _, node, text in kept if node in self.in_main):
                beside = {}
                for _, node, text in kept:
                    if kinds[node] == 2 and node not in self.in_main:
                        beside[node] = beside.get(node, 0) + len(text.strip())
                for node, n in beside.items() if self.beside_main > 1 else ():
                    kinds[node] = 3
                    size[2] -= n
                    whole -= n
            roots = [{2}, {1, 2}]
            called = [k for k in size if k < 0]
            if called:
                largest = max(called, key=lambda k: (size[k], k))
                roots.append({k for k in called if self.parent[-k] == self.parent[-largest]})
            for root in roots:
                if 2 * sum(size.get(k, 0) for k in root) > whole:
                    text = joined([s for s in kept if kinds[s[1]] in root])
                    if text:
                        return text
            text = joined(kept)
            if text:
                return text
        return ""


def joined(segments: list[tuple[int, int, str]]) -> str:
    blocks: list[list[str]] = []
    last = None
    for block, _, text in segments:
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(text)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(x for x in lines if x)


def host(url: Column) -> Column:
    """The host of a url in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(site, hashes)``: for each site with a template the hashes of its subtrees; ``site`` is a hash of the host."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            site, out_site, out_hash, out_print = np.asarray(batch.column(0)), [], [], []
            for k, source in enumerate(batch.column(1)):
                page = Page(source.as_py())
                own = {h for h in page.hashes() if h} | {0}
                out_site += [int(site[k])] * len(own)
                out_hash += own
                out_print += [int.from_bytes(blake2b(page.main_text().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_site, out_hash, out_print)], names=["site", "hash", "print"])

    named = pages.filter((host(F.col(url)) != "") & F.col(html).isNotNull()).select(F.xxhash64(host(F.col(url))).alias("site"), F.col(html).alias("html"))
    seen = named.mapInArrow(run, "site long, hash long, print long").distinct()
    counts = pin(seen.groupBy("site", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAGES))
    whole = counts.filter("hash = 0").select(F.col("site").alias("_site"), F.col("n").alias("_n"))
    often = counts.filter("hash <> 0").join(whole, F.col("site") == F.col("_site")).filter(F.col("n") >= SHARE * F.col("_n"))
    return often.groupBy("site").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points."""
    pages = pages.drop("text", "n_chars")
    kept = pages.columns
    lists = pin(templates(pages, url, html).select(F.col("site").alias("_site"), F.col("hashes").alias("_hashes")))
    total = lists.agg(F.coalesce(F.sum(F.size("_hashes")), F.lit(0))).first()[0]
    joined_pages = pages.withColumn("_own", F.xxhash64(host(F.col(url)))).join(small(lists, total, BROADCAST_HASHES), F.col("_own") == F.col("_site"), "left").drop("_own", "_site")
    at = kept.index(html)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, hashes in zip(batch.column(at), batch.column(len(kept))):
                texts.append(Page(source.as_py()).main_text(set(hashes.as_py()) if hashes.is_valid else None) if source.is_valid else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return joined_pages.mapInArrow(run, f"{fields}, text string, n_chars long")
